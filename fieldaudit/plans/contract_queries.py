"""Queries of contracts: what a table has to hold before it is scored, views of a panel, and summaries that are read by others."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.operators import columns, contracts, metrics, order, probes, stats
from fieldaudit.plans.column_queries import COLUMNS, LEAKS, PROBED, long, probed, registry, rounded, scores
from fieldaudit.plans.ledger_queries import led
from fieldaudit.plans.panel_queries import S, _noise
from fieldaudit.plans.stats_queries import _MECH, REPS, _mech
from fieldaudit.plans.tables import CATEGORIES, FEATURES, LEDGER, PANEL, categories, panel, read, u_sql

QUERIES, ORACLE = {}, {}


def add(name, run, sql):
    QUERIES[name], ORACLE[name] = run, sql


add("f3_renamed", lambda s, d: columns.renamed(panel(s, d), {"x_quantity": "amount", "x_tax": "tax_rate"}).groupBy("dataset_id").agg(F.round(F.avg("amount"), 6).alias("amount"), F.round(F.avg("tax_rate"), 6).alias("tax_rate")),
    PANEL + " SELECT dataset_id, round(avg(x_quantity), 6) AS amount, round(avg(x_tax), 6) AS tax_rate FROM panel GROUP BY 1")


def _labelled(s, d):
    """Order lines by three rules and the label that any of them sets: shipped within a week of the order, a status by its prefix, returned."""
    line = read(s, d, "lineitem").join(read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderstatus"), "l_orderkey")
    flags = {"near": F.datediff("l_shipdate", "o_orderdate").between(0, 7), "prefix": F.col("o_orderstatus").startswith("P"), "returned": F.col("l_returnflag") == "R"}
    return contracts.any_flag(line.withColumns(flags), list(flags), "y").groupBy(*flags, "y").agg(F.count("*").alias("n"))


add("f6_label_rules", _labelled, """SELECT near, prefix, returned, CAST(near OR prefix OR returned AS INT) AS y, count(*) AS n FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND 7 AS near,
    starts_with(o_orderstatus, 'P') AS prefix, l_returnflag = 'R' AS returned FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY ALL""")  # fmt: skip
add("f12_without_dates", lambda s, d: contracts.without(read(s, d, "orders"), ["o_orderdate"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")


def _views(s, d):
    """Rows, columns and means of the strict, full, governed and contaminated-only views of the probed panel."""
    kept = contracts.views(registry(s), set(LEAKS), ["m02", "x_tax"])
    means = {name: F.avg(sum((F.col(c) for c in names[1:]), F.col(names[0]))) for name, names in kept.items()}
    row = probed(s, d).groupBy("dataset_id").agg(F.count("*").alias("n_rows"), *(m.alias(f"_{name}") for name, m in means.items()))  # one pass for all views
    each = F.explode(F.array(*(F.struct(F.lit(len(names)).alias("n_columns"), F.round(f"_{name}", 6).alias("mean_sum"), F.lit(name).alias("view")) for name, names in kept.items()))).alias("_v")
    return row.select("dataset_id", "n_rows", each).select("dataset_id", "n_rows", "_v.*")


_VIEW = {"strict": [c for c in COLUMNS if c not in LEAKS], "full": COLUMNS, "governed": [c for c in COLUMNS if c not in ("m02", "x_tax")], "contaminated": list(LEAKS)}
add("f15_t7_views", _views, PROBED + " " + " UNION ALL ".join(f"SELECT dataset_id, count(*) AS n_rows, {len(c)} AS n_columns, round(avg({' + '.join(c)}), 6) AS mean_sum, '{n}' AS view FROM probed GROUP BY dataset_id" for n, c in _VIEW.items()))
_due = lambda df: df.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_shipdate")).alias("ts"))
add("t10_nulls_last", lambda s, d: contracts.ordered(_due(read(s, d, "lineitem")), "ts", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "pos"),
    """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY CASE WHEN l_linenumber % 3 > 0 THEN l_shipdate END NULLS LAST, l_orderkey, l_linenumber) AS pos FROM lineitem""")  # fmt: skip


def _strengths(s, d):
    """Severity (standardised difference) of a proxy at each strength that the protocol table gives, and whether it grows."""
    p = panel(s, d)
    steps = contracts.STRENGTHS["M02"]
    for name, w in steps.items():
        p = probes.noisy_proxy(p, w, S, f"w_{name}")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("strength"), F.lit(w).alias("parameter"), F.col(f"w_{n}").alias("value")) for n, w in steps.items()))).alias("_s")
    return rounded(metrics.mean_difference(p.select("y", each).select("y", "_s.*"), ["strength", "parameter"], "value"), ["strength", "parameter"], "smd")


add("m13_strength_table", _strengths, PANEL + ", v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strength, CAST({w} AS DOUBLE) AS parameter, y, {w} * (y - prior) + {_noise(f'w_{n}')} AS v FROM placed" for n, w in (("S1", 0.1), ("S2", 0.3), ("S3", 0.5), ("S4", 0.7), ("S5", 1.0))) + """)
    SELECT strength, parameter, round((avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / sqrt((var_samp(v) FILTER (y = 1) + var_samp(v) FILTER (y = 0)) / 2), 6) AS smd FROM v GROUP BY ALL""")  # fmt: skip


def _recomputed(s, d):
    """Cells whose recorded area under the curve (rounded to three places here) is more than 0.0004 from the one that their rows give."""
    found = metrics.auroc(long(s, d).where("split = 'test'"), ["dataset_id", "feature_id"], "value").select("dataset_id", "feature_id", "auroc")
    recorded = found.select("dataset_id", "feature_id", F.round("auroc", 3).alias("recorded"))
    return rounded(contracts.differing(recorded, found, ["dataset_id", "feature_id"], "recorded", "auroc", 0.0004), ["dataset_id", "feature_id"], "recorded", "auroc")


add("q8_recomputed_metric", _recomputed, PROBED + """, f AS (SELECT dataset_id, feature_id, value, sum(y) AS p, sum(1 - y) AS q FROM ml WHERE split = 'test' GROUP BY ALL),
    g AS (SELECT *, sum(q) OVER (PARTITION BY dataset_id, feature_id ORDER BY value ROWS UNBOUNDED PRECEDING) - q / 2.0 AS below FROM f),
    a AS (SELECT dataset_id, feature_id, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * below) / CAST(sum(p) * sum(q) AS DOUBLE) END AS a FROM g GROUP BY ALL)
    SELECT dataset_id, feature_id, round(round(a, 3), 6) AS recorded, round(a, 6) AS auroc FROM a WHERE abs(round(a, 3) - a) > 0.0004""")  # fmt: skip


def _base(s, d):
    """Rows before and after three probes: base columns and split that changed, and rows by split, which have to agree."""
    before = order.time_split(panel(s, d))
    after = probes.compose(before, lambda p: probes.noisy_proxy(p, 0.8, S), lambda p: probes.projections(p, 0.8, S), lambda p: probes.mixed_group(p, 0.5, S, "x_tax"))
    keep = ["row_id", "y", "split", *FEATURES]
    changed = probes.same_base(before, after, keep).groupBy("split").agg(F.count("*").alias("n_changed"))
    return after.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("y").alias("n_pos")).join(changed, "split", "left").fillna(0, ["n_changed"])


add("q9_base_unchanged", _base, PANEL + " SELECT split, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos, CAST(0 AS BIGINT) AS n_changed FROM splitted GROUP BY 1")
_words = lambda: F.element_at(F.array(*map(F.lit, ("true", " False ", "1", "0", "YES", "no", "maybe", ""))), (F.pmod(F.col("l_orderkey"), F.lit(8)) + 1).cast("int"))
add("q10_strict_booleans", lambda s, d: contracts.strict_boolean(read(s, d, "lineitem").withColumn("word", _words()), "word").groupBy("word", "parsed", "valid").agg(F.count("*").alias("n")),
    """WITH w AS (SELECT ['true', ' False ', '1', '0', 'YES', 'no', 'maybe', ''][l_orderkey % 8 + 1] AS word FROM lineitem), t AS (SELECT word, lower(trim(word)) AS t FROM w)
    SELECT word, CASE t WHEN 'true' THEN true WHEN 'false' THEN false END AS parsed, t IN ('true', 'false') AS valid, count(*) AS n FROM t GROUP BY ALL""")  # fmt: skip
add("q11_input_contract", lambda s, d: contracts.input_contract(order.time_split(panel(s, d)).withColumn("x_tax", F.when(F.col("x_tax") > 0, 1 / F.col("x_tax")).otherwise(F.lit(float("inf")))), FEATURES, ["dataset_id"]),
    PANEL + """ SELECT dataset_id, split, count(*) AS n_rows, count(*) FILTER (x_tax = 0) AS n_not_finite, CAST(0 AS BIGINT) AS n_not_binary, count(DISTINCT y) AS n_classes,
    NOT (count(*) FILTER (x_tax = 0) > 0 OR (split IN ('train', 'validation') AND count(DISTINCT y) < 2)) AS fit FROM splitted GROUP BY dataset_id, split""")  # fmt: skip


def _permutation(s, d):
    m = _mech(s, d).join(F.broadcast(categories(s)), "mechanism")
    return rounded(stats.permuted_increment(m, "category", "item", "x", "h", REPS, S), ["n_reps"], "r2_increment", "p")


add("b12_within_category_permutation", _permutation, LEDGER + _MECH + f""", c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY item) AS k, x - avg(x) OVER w AS u, h - avg(h) OVER w AS v FROM mm JOIN {CATEGORIES} USING (mechanism) WINDOW w AS (PARTITION BY category)),
    sh AS (SELECT rep, category, u, row_number() OVER (PARTITION BY rep, category ORDER BY {u_sql(f"'{S}|perm|' || rep || '|' || item")}, item) AS k FROM c, range({REPS}) r(rep)),
    nl AS (SELECT rep, sum(sh.u * c.v) AS uv FROM sh JOIN c USING (category, k) GROUP BY rep), ob AS (SELECT sum(u * v) AS uv, sum(u * u) AS uu, var_pop(h) * count(*) AS al FROM c)
    SELECT CAST(count(*) AS BIGINT) AS n_reps, round(any_value(ob.uv * ob.uv / uu / al), 6) AS r2_increment, round((1 + count(*) FILTER (nl.uv * nl.uv >= ob.uv * ob.uv - 1e-12)) / CAST(count(*) + 1 AS DOUBLE), 6) AS p FROM nl, ob""")  # fmt: skip


def _sensitivity(s, d):
    """A document for each mechanism: every method's value and interval, the range of values, and whether all intervals agree on the sign."""
    st = stats.unit_bootstrap(led(s, d), "dataset_id", "paired_harm", ["mechanism", "model"], REPS, S)
    figures = stats.interval(st, ["mechanism", "model"], "stat").select("mechanism", "model", F.col("boot_mean").alias("value"), F.col("low").alias("ci_low"), F.col("high").alias("ci_high"))
    shape = "map<string,struct<value:double,ci_low:double,ci_high:double>>"  # read back, so that the document is held against SQL by its figures
    told = contracts.nested_document(figures, "mechanism", "model", ["value", "ci_low", "ci_high"])
    entries = told.select("mechanism", "spread", "robust", F.explode(F.from_json("document", shape)).alias("model", "f"))
    return entries.select("mechanism", "spread", "robust", "model", "f.value", "f.ci_low", "f.ci_high")


add("c7_sensitivity_document", _sensitivity, LEDGER + f""", un AS (SELECT dataset_id, row_number() OVER (ORDER BY dataset_id) - 1 AS unit FROM (SELECT DISTINCT dataset_id FROM ledger)), nu AS (SELECT count(*) AS n FROM un),
    dr AS (SELECT rep, slot, CAST(floor({u_sql(f"'{S}|' || rep || '|' || slot")} * n) AS BIGINT) AS unit FROM nu, range({REPS}) r(rep), range(1000) s(slot) WHERE slot < n),
    um AS (SELECT dataset_id, mechanism, model, avg(paired_harm) AS m FROM ledger GROUP BY ALL), st AS (SELECT rep, mechanism, model, avg(m) AS stat FROM dr JOIN un USING (unit) JOIN um USING (dataset_id) GROUP BY ALL),
    iv AS (SELECT mechanism, model, round(avg(stat), 4) AS v, round(quantile_cont(stat, 0.025), 4) AS l, round(quantile_cont(stat, 0.975), 4) AS h FROM st GROUP BY ALL)
    SELECT mechanism, model, v AS value, l AS ci_low, h AS ci_high, round(max(v) OVER w - min(v) OVER w, 4) AS spread, bool_and(l > 0) OVER w OR bool_and(h < 0) OVER w AS robust FROM iv WINDOW w AS (PARTITION BY mechanism)""")  # fmt: skip


def _lineages(s, d):
    """Lineage documents of customers, with keys in one of two orders and a private path, rewritten: what is left tells who and what only."""
    c = read(s, d, "customer")
    path = F.concat(F.lit("/home/u"), F.col("c_nationkey"), F.lit("/raw/"), F.lower("c_mktsegment"), F.lit(".csv"))
    a, b = F.struct("c_custkey", path.alias("source_path"), "c_name"), F.struct("c_name", path.alias("source_path"), "c_custkey")
    text = F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.to_json(a)).otherwise(F.to_json(b))
    docs = c.select("c_custkey", text.alias("lineage"), contracts.public_path(F.lit("customers"), path).alias("public"))
    return contracts.canonical_lineage(docs, "lineage", {"source_path": "<SOURCE_PATH>"})


add("s15_public_lineage", _lineages, """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","source_path":"<SOURCE_PATH>"}' AS lineage, 'external_sources/customers/' || lower(c_mktsegment) || '.csv' AS public FROM customer""")
_WORDS = ("m02", "m10", "price")
add("f13_availability", lambda s, d: columns.availability(scores(s, d), s.createDataFrame([(w,) for w in _WORDS], "pattern string")).select("dataset_id", "feature_id", "available", F.round("score", 6).alias("score")),
    PROBED + f" SELECT dataset_id, feature_id, NOT ({' OR '.join(f"contains(feature_id, '{w}')" for w in _WORDS)}) AS available, round(score, 6) AS score FROM sc")
_SHOWN = {"mechanism": ["mechanism"], "governance": ["mechanism", "model"], "natural": ["dataset_id"]}
add("s14_reporting_tables", lambda s, d: contracts.reporting(led(s, d), _SHOWN, "paired_harm"),
    LEDGER + " " + " UNION ALL ".join(f"SELECT '{n}' AS report, {k} AS unit, count(*) AS n, round(avg(paired_harm), 6) AS mean, round(min(paired_harm), 6) AS low, round(max(paired_harm), 6) AS high FROM ledger GROUP BY {k}" for n, k in (("mechanism", "mechanism"), ("governance", "mechanism || '/' || model"), ("natural", "CAST(dataset_id AS VARCHAR)"))))
