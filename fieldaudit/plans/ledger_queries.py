"""Queries on the ledger: joins, set operations, summaries, windows, gates, repair metrics and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldaudit.operators import ledger as L
from fieldaudit.operators import metrics
from fieldaudit.plans.tables import CATEGORIES, LEDGER, categories, ledger, read

QUERIES, ORACLE = {}, {}
KEY = ["dataset_id", "mechanism", "strength", "model", "seed"]
_K = ", ".join(KEY)


def add(name, run, sql):
    QUERIES[name], ORACLE[name] = run, LEDGER + "\n" + sql


def rounded(df, keep, *cols):
    return df.select(*keep, *(F.round(F.col(c).cast("double"), 6).alias(c) for c in cols))


led = ledger
_r = lambda *cols: ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)

add("j1_one_to_one", lambda s, d: L.one_to_one(led(s, d).select(*KEY, "clean_auc"), led(s, d).select(*KEY, "full_auc"), KEY), f"SELECT {_K}, clean_auc, full_auc FROM ledger")
add("j2_complete_left", lambda s, d: L.complete_left(led(s, d).select(*KEY, "paired_harm"), led(s, d).groupBy("mechanism").agg(F.round(F.max("diagnostic_ap"), 6).alias("best_ap")), ["mechanism"]),
    f"SELECT {_K}, paired_harm, best_ap FROM ledger JOIN (SELECT mechanism, round(max(diagnostic_ap), 6) AS best_ap FROM ledger GROUP BY 1) USING (mechanism)")


def _precedence(s, d):
    base = led(s, d).select(*KEY, "paired_harm")
    news = base.where("mechanism = 'M02'").withColumn("paired_harm", F.round(F.col("paired_harm") + 1, 9))
    last = base.where("mechanism = 'M02' AND seed = 1").withColumn("paired_harm", F.round(F.col("paired_harm") + 2, 9))
    return L.precedence([("amendment", last), ("replacement", news), ("base", base)], KEY)


add("j3_precedence", _precedence, f"""SELECT {_K}, round(CASE WHEN mechanism <> 'M02' THEN paired_harm WHEN seed = 1 THEN paired_harm + 2 ELSE paired_harm + 1 END, 9) AS paired_harm,
    CASE WHEN mechanism <> 'M02' THEN 'base' WHEN seed = 1 THEN 'amendment' ELSE 'replacement' END AS provenance FROM ledger""")  # fmt: skip
add("j4_overwrite", lambda s, d: L.overwrite(led(s, d).select(*KEY, "diagnostic_ap"), led(s, d).where("seed = 1").select(*KEY, F.lit(0.5).alias("diagnostic_ap")), KEY, "diagnostic_ap", F.col("model") == "rf"),
    f"SELECT {_K}, CASE WHEN model = 'rf' AND seed = 1 THEN 0.5 ELSE diagnostic_ap END AS diagnostic_ap FROM ledger")
add("j5_missing_keys", lambda s, d: L.missing_keys(led(s, d).where("NOT (model = 'lr' AND seed = 2)"), led(s, d).where("mechanism <> 'M03'"), KEY),
    f"""SELECT {_K}, CASE WHEN mechanism = 'M03' THEN 'left' ELSE 'right' END AS side FROM ledger WHERE (mechanism = 'M03') <> (model = 'lr' AND seed = 2)""")
add("j6_paired_controls", lambda s, d: rounded(L.paired_controls(led(s, d), ["dataset_id", "mechanism", "strength"], F.col("model") == "gbt", F.col("model") != "gbt", "full_auc"), ["dataset_id", "mechanism", "strength", "n_controls"], "effect"),
    """SELECT dataset_id, mechanism, strength, count(*) FILTER (model <> 'gbt') AS n_controls, round(avg(full_auc) FILTER (model = 'gbt') - avg(full_auc) FILTER (model <> 'gbt'), 6) AS effect FROM ledger GROUP BY ALL
    HAVING count(*) FILTER (model = 'gbt') > 0 AND count(*) FILTER (model <> 'gbt') > 0""")  # fmt: skip
add("j7_category_lookup", lambda s, d: led(s, d).select(*KEY).join(F.broadcast(categories(s)), "mechanism"), f"SELECT {_K}, category FROM ledger JOIN {CATEGORIES} USING (mechanism)")


def _plan(s, d):
    """Every combination of the levels that occur, with a run id: dimension tables of a few rows each."""
    level = lambda c: led(s, d).select(c).distinct()
    out = level(KEY[0])
    for c in KEY[1:]:
        out = out.crossJoin(F.broadcast(level(c)))
    return out.withColumn("run_id", L.run_id(*KEY))


_PLAN = ", plan AS (SELECT * FROM " + ", ".join(f"(SELECT DISTINCT {c} FROM ledger)" for c in KEY) + ")"
add("j8_full_plan", _plan, _PLAN + " SELECT *, substr(sha256(concat_ws('|', dataset_id, mechanism, strength, model, seed)), 1, 20) AS run_id FROM plan")
add("j9_unfinished", lambda s, d: _plan(s, d).join(led(s, d).where("seed = 1 OR dataset_id < 10"), KEY, "left_anti").select(*KEY), _PLAN + f" SELECT {_K} FROM plan ANTI JOIN (SELECT * FROM ledger WHERE seed = 1 OR dataset_id < 10) USING ({_K})")
add("j10_model_pairs", lambda s, d: rounded(L.pairs(led(s, d), "model", ["dataset_id", "mechanism", "strength", "seed"], "paired_harm").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(F.col("value_a") - F.col("value_b")).alias("difference")), ["a", "b", "n"], "difference"),
    """SELECT x.model AS a, y.model AS b, count(*) AS n, round(avg(x.paired_harm - y.paired_harm), 6) AS difference FROM ledger x JOIN ledger y USING (dataset_id, mechanism, strength, seed) WHERE x.model < y.model GROUP BY ALL""")  # fmt: skip
add("u1_union_by_name", lambda s, d: led(s, d).where("seed = 1").select("dataset_id", "model", "clean_auc").unionByName(led(s, d).where("seed = 2").select("dataset_id", "model", "full_auc"), allowMissingColumns=True),
    "SELECT dataset_id, model, CASE WHEN seed = 1 THEN clean_auc END AS clean_auc, CASE WHEN seed = 2 THEN full_auc END AS full_auc FROM ledger")
add("u2_keep_last", lambda s, d: L.keep_last(led(s, d), ["dataset_id", "mechanism"], [(F.col("model") == "rf").desc(), F.col("full_auc").desc(), F.col("strength"), F.col("model"), F.col("seed")]).select("dataset_id", "mechanism", "model", "strength", "seed"),
    """SELECT dataset_id, mechanism, model, strength, seed FROM ledger QUALIFY row_number() OVER (PARTITION BY dataset_id, mechanism ORDER BY model = 'rf' DESC, full_auc DESC, strength, model, seed) = 1""")  # fmt: skip
add("u4_distinct_tasks", lambda s, d: led(s, d).select("dataset_id", "mechanism").distinct(), "SELECT DISTINCT dataset_id, mechanism FROM ledger")
add("u5_recomposed", lambda s, d: led(s, d).where("mechanism <> 'M05'").select(*KEY, "paired_harm").unionByName(led(s, d).where("mechanism = 'M04'").select(*KEY, "paired_harm").withColumn("mechanism", F.lit("M05"))),
    f"SELECT {_K}, paired_harm FROM ledger WHERE mechanism <> 'M05' UNION ALL SELECT dataset_id, 'M05', strength, model, seed, paired_harm FROM ledger WHERE mechanism = 'M04'")
add("u6_superseded", lambda s, d: led(s, d).join(led(s, d).where("paired_harm > 0.2").select("dataset_id", "mechanism").distinct(), ["dataset_id", "mechanism"], "left_anti").select(*KEY),
    f"SELECT {_K} FROM ledger ANTI JOIN (SELECT DISTINCT dataset_id, mechanism FROM ledger WHERE paired_harm > 0.2) USING (dataset_id, mechanism)")
_SUM = ["mean", "median", "q1", "q3", "low", "high", "std", "iqr"]
add("a1_summary", lambda s, d: rounded(L.summary(led(s, d), ["mechanism", "model"], "paired_harm"), ["mechanism", "model", "n"], *_SUM),
    """, a AS (SELECT mechanism, model, count(*) AS n, avg(paired_harm) AS mean, quantile_cont(paired_harm, 0.5) AS median, quantile_cont(paired_harm, 0.25) AS q1, quantile_cont(paired_harm, 0.75) AS q3,
    min(paired_harm) AS low, max(paired_harm) AS high, stddev_samp(paired_harm) AS std, quantile_cont(paired_harm, 0.75) - quantile_cont(paired_harm, 0.25) AS iqr FROM ledger GROUP BY ALL) SELECT mechanism, model, n, """ + _r(*_SUM) + " FROM a")  # fmt: skip
add("a2_invariant_range", lambda s, d: rounded(led(s, d).groupBy("dataset_id", "mechanism").agg((F.max("diagnostic_ap") - F.min("diagnostic_ap")).alias("spread")).withColumn("varies", F.col("spread") > 0.5), ["dataset_id", "mechanism", "varies"], "spread"),
    "SELECT dataset_id, mechanism, round(max(diagnostic_ap) - min(diagnostic_ap), 6) AS spread, max(diagnostic_ap) - min(diagnostic_ap) > 0.5 AS varies FROM ledger GROUP BY ALL")
_CUTS = {"over_010": "> 0.01", "over_020": "> 0.02", "over_005": "> 0.005", "under_005": "< -0.005"}
add("a3_threshold_rates", lambda s, d: rounded(led(s, d).groupBy("mechanism").agg(*(F.avg(F.expr(f"CAST(paired_harm {c} AS INT)")).alias(k) for k, c in _CUTS.items())), ["mechanism"], *_CUTS),
    "SELECT mechanism, " + ", ".join(f"round(avg(CAST(paired_harm {c} AS INT)), 6) AS {k}" for k, c in _CUTS.items()) + " FROM ledger GROUP BY mechanism")
add("a4_effect_size", lambda s, d: rounded(L.pairs(led(s, d), "model", ["dataset_id", "mechanism", "strength", "seed"], "full_auc").withColumn("v", F.col("value_a") - F.col("value_b")).groupBy("a", "b").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), (F.avg("v") / F.stddev_samp("v")).alias("cohen_d")), ["a", "b"], "mean", "median", "cohen_d"),
    """, v AS (SELECT x.model AS a, y.model AS b, x.full_auc - y.full_auc AS v FROM ledger x JOIN ledger y USING (dataset_id, mechanism, strength, seed) WHERE x.model < y.model)
    SELECT a, b, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v) / stddev_samp(v), 6) AS cohen_d FROM v GROUP BY ALL""")  # fmt: skip
_MODELS = ["gbt", "lr", "rf"]
add("a5_pivot", lambda s, d: rounded(led(s, d).groupBy("mechanism").pivot("model", _MODELS).agg(F.avg("paired_harm")), ["mechanism"], *_MODELS),
    "SELECT mechanism, " + ", ".join(f"round(avg(paired_harm) FILTER (model = '{m}'), 6) AS {m}" for m in _MODELS) + " FROM ledger GROUP BY mechanism")
add("a6_coverage", lambda s, d: _plan(s, d).join(led(s, d).where("paired_harm < 0.3").select(*KEY, F.lit(1).alias("have")), KEY, "left").groupBy("mechanism", "model").agg(F.count("*").alias("expected"), F.count("have").alias("found")).withColumn("missing", F.col("expected") - F.col("found")),
    _PLAN + f" SELECT mechanism, model, count(*) AS expected, count(h) AS found, count(*) - count(h) AS missing FROM plan LEFT JOIN (SELECT {_K}, 1 AS h FROM ledger WHERE paired_harm < 0.3) USING ({_K}) GROUP BY ALL")
add("a6_missing_cells", lambda s, d: L.missing_keys(_plan(s, d), led(s, d).where("paired_harm < 0.3"), KEY),
    _PLAN + f", have AS (SELECT {_K} FROM ledger WHERE paired_harm < 0.3) SELECT {_K}, 'left' AS side FROM (SELECT DISTINCT {_K} FROM plan EXCEPT SELECT {_K} FROM have) UNION ALL SELECT {_K}, 'right' FROM (SELECT {_K} FROM have EXCEPT SELECT {_K} FROM plan)")
add("a7_two_stage_mean", lambda s, d: rounded(L.two_stage_mean(led(s, d), ["dataset_id"], ["mechanism"], "paired_harm"), ["mechanism", "units"], "mean"),
    "SELECT mechanism, count(*) AS units, round(avg(m), 6) AS mean FROM (SELECT mechanism, dataset_id, avg(paired_harm) AS m FROM ledger GROUP BY ALL) GROUP BY mechanism")
add("a8_seed_coverage", lambda s, d: led(s, d).groupBy("dataset_id").agg(F.countDistinct("mechanism", "model", "seed").alias("n_combinations")), "SELECT dataset_id, count(DISTINCT (mechanism, model, seed)) AS n_combinations FROM ledger GROUP BY 1")
add("a9_extreme_labels", lambda s, d: led(s, d).groupBy("mechanism", "model").agg(F.round(F.avg("paired_harm"), 6).alias("m")).groupBy("mechanism").agg(F.max_by("model", F.struct("m", "model")).alias("worst"), F.min_by("model", F.struct("m", "model")).alias("best")),
    """, m AS (SELECT mechanism, model, round(avg(paired_harm), 6) AS m FROM ledger GROUP BY ALL) SELECT mechanism, arg_max(model, (m, model)) AS worst, arg_min(model, (m, model)) AS best FROM m GROUP BY mechanism""")  # fmt: skip
add("a11_scopes", lambda s, d: L.scopes(led(s, d), ["mechanism", "model", "strength"], {"mean": F.col("paired_harm")}).withColumn("mean", F.round(F.col("mean") / F.col("n"), 6)),
    "SELECT 'overall' AS scope, 'all' AS level, count(*) AS n, round(avg(paired_harm), 6) AS mean FROM ledger " + " ".join(f"UNION ALL SELECT '{c}', CAST({c} AS VARCHAR), count(*), round(avg(paired_harm), 6) FROM ledger GROUP BY {c}" for c in ("mechanism", "model", "strength")))
add("a12_leave_one_out", lambda s, d: rounded(L.leave_one_out(led(s, d), "dataset_id", "paired_harm"), ["left_out", "n"], "mean"),
    "SELECT l.left_out, count(*) AS n, round(avg(paired_harm), 6) AS mean FROM ledger, (SELECT DISTINCT dataset_id AS left_out FROM ledger) l WHERE dataset_id <> l.left_out GROUP BY 1")
_LEVELS = ["mechanism", "model", "strength", "dataset_id"]
add("a12_leave_levels_out", lambda s, d: rounded(L.leave_levels_out(led(s, d), _LEVELS, "paired_harm"), ["scope", "level", "n"], "mean"),
    " UNION ALL ".join(f"SELECT '{f}' AS scope, CAST(l.v AS VARCHAR) AS level, count(*) AS n, round(avg(paired_harm), 6) AS mean FROM ledger, (SELECT DISTINCT {f} AS v FROM ledger) l WHERE {f} <> l.v GROUP BY l.v" for f in _LEVELS))
add("a13_value_counts", lambda s, d: led(s, d).groupBy("mechanism", "model").agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows")), "SELECT mechanism, model, count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ledger GROUP BY ALL")
add("w2_average_rank", lambda s, d: led(s, d).select(*KEY, L.average_rank(["dataset_id"], "n_rows").alias("rank")),
    f"SELECT {_K}, rank() OVER (PARTITION BY dataset_id ORDER BY n_rows) + (count(*) OVER (PARTITION BY dataset_id, n_rows) - 1) / CAST(2 AS DOUBLE) AS rank FROM ledger")
add("w4_quartile_bins", lambda s, d: rounded(L.quantile_bin(led(s, d), "paired_harm").groupBy("bin").agg(F.count("*").alias("n"), F.avg("paired_harm").alias("mean")), ["bin", "n"], "mean"),
    """, e AS (SELECT quantile_cont(paired_harm, [0.25, 0.5, 0.75]) AS e FROM ledger) SELECT CAST(len(list_filter(e, lambda x: x < paired_harm)) AS INT) AS bin, count(*) AS n, round(avg(paired_harm), 6) AS mean FROM ledger, e GROUP BY 1""")  # fmt: skip


def _steps(s, d):
    m = led(s, d).groupBy("mechanism", "strength").agg(F.avg("paired_harm").alias("m"))
    step = F.col("m") - F.lag("m").over(Window.partitionBy("mechanism").orderBy("strength"))
    return m.withColumn("step", step).groupBy("mechanism").agg(F.sum((F.col("step") > 0).cast("int")).alias("positive_steps"), F.min(F.coalesce(F.col("step") >= -0.02, F.lit(True))).alias("monotone"))


add("w5_strength_steps", _steps, """, m AS (SELECT mechanism, strength, avg(paired_harm) AS m FROM ledger GROUP BY ALL), t AS (SELECT *, m - lag(m) OVER (PARTITION BY mechanism ORDER BY strength) AS step FROM m)
    SELECT mechanism, CAST(sum(CAST(step > 0 AS INT)) AS BIGINT) AS positive_steps, bool_and(coalesce(step >= -0.02, true)) AS monotone FROM t GROUP BY mechanism""")  # fmt: skip
_UT = ["residual_inflation", "utility_damage", "delta", "strict_distance_reduction"]
add("e6_paired_harm", lambda s, d: led(s, d).select(*KEY, "clean_auc", "full_auc", "paired_harm"), f"SELECT {_K}, clean_auc, full_auc, paired_harm FROM ledger")
add("e7_exploitation", lambda s, d: rounded(led(s, d).withColumn("ratio", metrics.exploitation_ratio(F.col("full_auc"), F.col("clean_auc"))), KEY, "ratio"), f"SELECT {_K}, round(least(1.0, (full_auc - clean_auc) / greatest(0.001, 1 - clean_auc)), 6) AS ratio FROM ledger")
add("e8_utility", lambda s, d: rounded(metrics.utility(led(s, d), "clean_auc", "full_auc", "governed_auc"), KEY, *_UT),
    f"""SELECT {_K}, round(greatest(0, governed_auc - clean_auc), 6) AS residual_inflation, round(greatest(0, clean_auc - governed_auc), 6) AS utility_damage, round(governed_auc - full_auc, 6) AS delta,
    round(abs(full_auc - clean_auc) - abs(governed_auc - clean_auc), 6) AS strict_distance_reduction FROM ledger""")  # fmt: skip
_DR = ["signed_gap", "same_side_residual", "overcorrection", "directional_repair", "directional_repair_fraction", "introduced_distortion"]
_REPAIR = """, g AS (SELECT *, full_auc - clean_auc AS gap, governed_auc - clean_auc AS off, abs(full_auc - clean_auc) <= 1e-12 AS none, sign(full_auc - clean_auc) AS side FROM ledger),
    h AS (SELECT *, gap AS signed_gap, CASE WHEN none THEN 0 ELSE greatest(side * off, 0) + 0 END AS same_side_residual, CASE WHEN none THEN 0 ELSE greatest(-side * off, 0) + 0 END AS overcorrection, CASE WHEN none THEN abs(off) ELSE 0 END AS introduced_distortion FROM g),
    rep AS (SELECT *, CASE WHEN none THEN 0 ELSE abs(gap) - same_side_residual END AS directional_repair, CASE WHEN NOT none THEN (abs(gap) - same_side_residual) / abs(gap) END AS directional_repair_fraction FROM h)"""
add("e10_directional_repair", lambda s, d: rounded(metrics.directional_repair(led(s, d), "clean_auc", "full_auc", "governed_auc"), [*KEY, "opportunity_class"], *_DR),
    _REPAIR + f" SELECT {_K}, CASE WHEN none THEN 'zero' ELSE 'nonzero' END AS opportunity_class, {_r(*_DR)} FROM rep")
add("t11_flag_examples", lambda s, d: metrics.directional_repair(led(s, d), "clean_auc", "full_auc", "governed_auc").where("overcorrection > 0.1").withColumn("rank", F.row_number().over(Window.partitionBy("mechanism").orderBy(F.round("overcorrection", 6).desc(), *KEY))).where("rank <= 20").select(*KEY, "rank"),
    _REPAIR + f" SELECT {_K}, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY round(overcorrection, 6) DESC, {_K}) AS k FROM rep WHERE overcorrection > 0.1) WHERE k <= 20")
# Columns that the panel and the ledger are made from, and one that a later release is to bring
REQUIRED = {"lineitem": ("l_orderkey", "l_returnflag", "l_shipdate", "l_commitdate"), "supplier": ("s_suppkey", "s_nationkey", "s_rating"), "part": ("p_partkey", "p_size", "p_retailprice")}


def _columns(s, d):
    """Required columns that a table lacks, with the table's number of rows."""
    out = None
    for table, need in REQUIRED.items():
        df = read(s, d, table)
        absent = [c for c in need if c not in df.columns]
        rows = df.agg(F.count("*").alias("n_rows")).select(F.lit(table).alias("table_name"), "n_rows", F.explode(F.array(*map(F.lit, absent)).cast("array<string>")).alias("missing"))
        out = rows if out is None else out.union(rows)
    return out


add("q1_required_columns", _columns, "SELECT r.table_name, n_rows, missing FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, need in REQUIRED.items() for c in need) + """) r(table_name, missing)
    JOIN (SELECT 'lineitem' AS table_name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part) USING (table_name)
    WHERE NOT EXISTS (SELECT 1 FROM information_schema.columns i WHERE i.table_name = r.table_name AND i.column_name = r.missing)""")  # fmt: skip


add("q2_not_finite", lambda s, d: L.not_finite(led(s, d).withColumn("diagnostic_ap", F.when(F.col("model") != "rf", F.col("diagnostic_ap"))), ["clean_auc", "full_auc", "diagnostic_ap"]),
    """SELECT 'diagnostic_ap' AS "column", count(*) AS n FROM ledger WHERE model = 'rf'""")  # fmt: skip
add("q3_unique_key", lambda s, d: L.duplicates(led(s, d), ["dataset_id", "mechanism"]), "SELECT dataset_id, mechanism, count(*) AS n FROM ledger GROUP BY ALL HAVING count(*) > 1")
add("q4_single_value", lambda s, d: led(s, d).groupBy("dataset_id").agg(F.countDistinct("strength").alias("n_values")).where("n_values > 1"), "SELECT dataset_id, count(DISTINCT strength) AS n_values FROM ledger GROUP BY 1 HAVING count(DISTINCT strength) > 1")
add("q5_row_invariants", lambda s, d: L.broken_invariants(led(s, d), {"harm": F.abs(F.col("paired_harm") - (F.col("full_auc") - F.col("clean_auc"))) < 1e-8, "rows": F.col("n_rows") >= 60, "name": F.col("mechanism").rlike("^M0[1-4]$")}),
    """SELECT * FROM (SELECT 'rows' AS rule, count(*) FILTER (n_rows < 60) AS n FROM ledger UNION ALL SELECT 'name', count(*) FILTER (mechanism > 'M04') FROM ledger) WHERE n > 0""")  # fmt: skip
add("q6_cross_table", lambda s, d: L.one_to_one(led(s, d).select(*KEY, "paired_harm"), led(s, d).select(*KEY, F.round(F.col("paired_harm"), 3).alias("other")), KEY).where("abs(paired_harm - other) > 0.0004").select(*KEY),
    f"SELECT {_K} FROM ledger WHERE abs(paired_harm - round(paired_harm, 3)) > 0.0004")
add("q7_group_digest", lambda s, d: L.table_digest(led(s, d), ["dataset_id"], ["mechanism", "strength", "model", "seed", "n_rows"]),
    """SELECT dataset_id, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', mechanism, strength, model, seed, n_rows)), 1, 10) AS BIGINT)) AS BIGINT) AS digest FROM ledger GROUP BY 1""")  # fmt: skip
add("s11_table_profile", lambda s, d: led(s, d).agg(F.count("*").alias("n"), F.countDistinct(*KEY).alias("n_keys"), F.array_join(F.sort_array(F.collect_set("mechanism")), ",").alias("mechanisms"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models")),
    f"SELECT count(*) AS n, count(DISTINCT ({_K})) AS n_keys, (SELECT string_agg(DISTINCT mechanism, ',' ORDER BY mechanism) FROM ledger) AS mechanisms, (SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM ledger) AS models FROM ledger")
_D = "CASE WHEN {x} >= 0.80 THEN 'HIGH' WHEN {x} >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END"
_X = "CASE WHEN {h} >= 0.02 AND {r} >= 0.60 THEN 'HIGH' WHEN {h} >= 0.005 OR {r} >= 0.20 THEN 'CONDITIONAL' ELSE 'LOW' END"


def _profiles(s, d):
    """Classes of detectability and, by mean harm and the share of cells harmed by more than 0.01, of exploitability; C1 where a mechanism contaminates."""
    m = led(s, d).groupBy("mechanism", "model").agg(F.avg("diagnostic_ap").alias("x"), F.avg("paired_harm").alias("h"), F.avg((F.col("paired_harm") > 0.01).cast("int")).alias("r"))
    m = m.select("mechanism", "model", F.expr(_D.format(x="x")).alias("detectability"), F.expr(_X.format(h="h", r="r")).alias("exploitability"))
    return m.withColumn("profile", F.concat(F.lit("C1-D"), F.substring("detectability", 1, 1), F.lit("-X"), F.substring("exploitability", 1, 1)))


add("c1_profiles", _profiles, f""", m AS (SELECT mechanism, model, {_D.format(x='avg(diagnostic_ap)')} AS detectability, {_X.format(h='avg(paired_harm)', r='avg(CAST(paired_harm > 0.01 AS INT))')} AS exploitability FROM ledger GROUP BY mechanism, model)
    SELECT *, 'C1-D' || left(detectability, 1) || '-X' || left(exploitability, 1) AS profile FROM m""")  # fmt: skip
add("c2_three_axes", lambda s, d: _axes(s, d), f""", ax AS (SELECT mechanism, category, avg(diagnostic_ap) AS det, stddev_samp(diagnostic_ap) AS det_std, avg(paired_harm) AS harm, avg(directional_repair) AS repair FROM (SELECT * FROM rep) JOIN {CATEGORIES} USING (mechanism) GROUP BY ALL)
    SELECT mechanism, category, {_r('det', 'det_std', 'harm', 'repair')} FROM ax""")  # fmt: skip
ORACLE["c2_three_axes"] = LEDGER + _REPAIR + ORACLE["c2_three_axes"][len(LEDGER) :]


def _axes(s, d):
    df = metrics.directional_repair(led(s, d), "clean_auc", "full_auc", "governed_auc").join(F.broadcast(categories(s)), "mechanism")
    out = df.groupBy("mechanism", "category").agg(F.avg("diagnostic_ap").alias("det"), F.stddev_samp("diagnostic_ap").alias("det_std"), F.avg("paired_harm").alias("harm"), F.avg("directional_repair").alias("repair"))
    return rounded(out, ["mechanism", "category"], "det", "det_std", "harm", "repair")


def _quadrants(s, d):
    m = led(s, d).groupBy("mechanism", "model").agg(F.round(F.avg("diagnostic_ap"), 9).alias("x"), F.round(F.avg("paired_harm"), 9).alias("h"))
    mid = m.groupBy("model").agg(F.percentile("x", F.lit(0.5)).alias("mx"), F.percentile("h", F.lit(0.5)).alias("mh"))
    q = m.join(mid, "model").withColumn("quadrant", F.concat(F.when(F.col("x") >= F.col("mx"), "D").otherwise("d"), F.when(F.col("h") >= F.col("mh"), "H").otherwise("h")))
    return q.groupBy("mechanism").agg(F.array_join(F.sort_array(F.collect_set("quadrant")), ",").alias("quadrants"), (F.countDistinct("quadrant") == 1).alias("agree"))


add("c3_quadrants", _quadrants, """, m AS (SELECT mechanism, model, round(avg(diagnostic_ap), 9) AS x, round(avg(paired_harm), 9) AS h FROM ledger GROUP BY ALL), k AS (SELECT model, quantile_cont(x, 0.5) AS mx, quantile_cont(h, 0.5) AS mh FROM m GROUP BY model),
    q AS (SELECT mechanism, CASE WHEN x >= mx THEN 'D' ELSE 'd' END || CASE WHEN h >= mh THEN 'H' ELSE 'h' END AS q FROM m JOIN k USING (model))
    SELECT mechanism, string_agg(DISTINCT q, ',' ORDER BY q) AS quadrants, count(DISTINCT q) = 1 AS agree FROM q GROUP BY mechanism""")  # fmt: skip
add("c6_negative_means", lambda s, d: rounded(led(s, d).groupBy("dataset_id", "mechanism").agg(F.avg("paired_harm").alias("mean")).where("mean < 0"), ["dataset_id", "mechanism"], "mean"),
    "SELECT dataset_id, mechanism, round(avg(paired_harm), 6) AS mean FROM ledger GROUP BY ALL HAVING avg(paired_harm) < 0")
add("b26_guarded_ratio", lambda s, d: rounded(led(s, d).groupBy("mechanism").pivot("model", _MODELS).agg(F.avg("paired_harm")).withColumn("ratio", F.when(F.abs("lr") > 0.01, F.col("rf") / F.col("lr"))), ["mechanism"], "ratio"),
    """, m AS (SELECT mechanism, avg(paired_harm) FILTER (model = 'rf') AS rf, avg(paired_harm) FILTER (model = 'lr') AS lr FROM ledger GROUP BY 1) SELECT mechanism, round(CASE WHEN abs(lr) > 0.01 THEN rf / lr END, 6) AS ratio FROM m""")  # fmt: skip
