"""Queries of resampling statistics, tests, regressions and decisions over the ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldaudit.operators import ledger as L
from fieldaudit.operators import metrics, order, stats
from fieldaudit.plans.ledger_queries import rounded
from fieldaudit.plans.panel_queries import S
from fieldaudit.plans.tables import CATEGORIES, LEDGER, PANEL, categories, ledger, panel, u_sql

QUERIES, ORACLE = {}, {}
REPS = 200
IV = ["boot_mean", "low", "high", "p_positive", "p_two_sided"]


def add(name, run, sql):
    QUERIES[name], ORACLE[name] = run, LEDGER + "\n" + sql


led = ledger
_DRAW = f""", un AS (SELECT dataset_id, row_number() OVER (ORDER BY dataset_id) - 1 AS unit FROM (SELECT DISTINCT dataset_id FROM ledger)), nu AS (SELECT count(*) AS n FROM un),
    dr AS (SELECT rep, slot, CAST(floor({u_sql(f"'{S}|' || rep || '|' || slot")} * n) AS BIGINT) AS unit FROM nu, range({REPS}) r(rep), range(1000) s(slot) WHERE slot < n)"""


def _iv(source, by=""):
    keep, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {keep}round(avg(stat), 6) AS boot_mean, round(quantile_cont(stat, 0.025), 6) AS low, round(quantile_cont(stat, 0.975), 6) AS high, round(avg(CAST(stat > 0 AS INT)), 6) AS p_positive,
    round(least(1.0, 2 * least(avg(CAST(stat > 0 AS INT)), 1 - avg(CAST(stat > 0 AS INT)))), 6) AS p_two_sided FROM {source} {group}"""


_diff = lambda df: L.pairs(df, "model", ["dataset_id", "mechanism", "strength", "seed"], "full_auc").withColumn("v", F.col("value_a") - F.col("value_b"))
_DIFF = """, df AS (SELECT x.dataset_id, x.mechanism, x.strength, x.seed, x.model AS a, y.model AS b, x.full_auc - y.full_auc AS v FROM ledger x JOIN ledger y USING (dataset_id, mechanism, strength, seed) WHERE x.model < y.model)"""
add("b1_cluster_bootstrap", lambda s, d: rounded(stats.interval(stats.cluster_bootstrap(led(s, d), "dataset_id", "paired_harm", REPS, S), [], "stat"), [], *IV),
    _DRAW + ", u AS (SELECT dataset_id, sum(paired_harm) AS s, count(*) AS n FROM ledger GROUP BY 1), st AS (SELECT rep, sum(s) / sum(u.n) AS stat FROM dr JOIN un USING (unit) JOIN u USING (dataset_id) GROUP BY rep) " + _iv("st"))
_UNIT = ", um AS (SELECT dataset_id, {by}, avg({v}) AS m FROM {t} GROUP BY ALL), st AS (SELECT rep, {by}, avg(m) AS stat FROM dr JOIN un USING (unit) JOIN um USING (dataset_id) GROUP BY ALL) "
add("b2_paired_bootstrap", lambda s, d: rounded(stats.interval(stats.unit_bootstrap(_diff(led(s, d)), "dataset_id", "v", ["a", "b"], REPS, S), ["a", "b"], "stat"), ["a", "b"], *IV),
    _DIFF + _DRAW + _UNIT.format(by="a, b", v="v", t="df") + _iv("st", "a, b"))


def _group_difference(s, d):
    st = stats.unit_bootstrap(led(s, d).join(F.broadcast(categories(s)), "mechanism"), "dataset_id", "paired_harm", ["category"], REPS, S)
    wide = st.groupBy("rep").pivot("category", ["simple", "structured"]).agg(F.first("stat"))
    return rounded(stats.interval(wide.withColumn("stat", F.col("simple") - F.col("structured")), [], "stat"), [], *IV)


_CAT = f"(SELECT * FROM ledger JOIN {CATEGORIES} USING (mechanism))"
add("b3_group_difference", _group_difference, _DRAW + _UNIT.format(by="category", v="paired_harm", t=_CAT) + ", df2 AS (SELECT rep, max(stat) FILTER (category = 'simple') - max(stat) FILTER (category = 'structured') AS stat FROM st GROUP BY rep) " + _iv("df2"))
_NEST = f""", ce AS (SELECT dataset_id, seed, mechanism, avg(paired_harm) AS m FROM ledger GROUP BY ALL),
    inn AS (SELECT dataset_id, seed, row_number() OVER (PARTITION BY dataset_id ORDER BY seed) - 1 AS k, count(*) OVER (PARTITION BY dataset_id) AS o FROM (SELECT DISTINCT dataset_id, seed FROM ledger)),
    d2 AS (SELECT rep, slot, dataset_id, o, j FROM dr JOIN un USING (unit) JOIN (SELECT DISTINCT dataset_id, o FROM inn) USING (dataset_id), range(10) t(j) WHERE j < o),
    d3 AS (SELECT rep, dataset_id, CAST(floor({u_sql(f"'{S}|in|' || rep || '|' || slot || '|' || j")} * o) AS BIGINT) AS k FROM d2),
    st AS (SELECT rep, mechanism, avg(m) AS stat FROM d3 JOIN inn USING (dataset_id, k) JOIN ce USING (dataset_id, seed) GROUP BY ALL) """
add("b4_nested_bootstrap", lambda s, d: rounded(stats.interval(stats.nested_bootstrap(led(s, d), "dataset_id", "seed", "paired_harm", ["mechanism"], REPS, S), ["mechanism"], "stat"), ["mechanism"], *IV), _DRAW + _NEST + _iv("st", "mechanism"))
add("b5_category_interval", lambda s, d: rounded(stats.interval(stats.nested_bootstrap(led(s, d), "dataset_id", "seed", "paired_harm", ["mechanism"], REPS, S).join(F.broadcast(categories(s)), "mechanism").groupBy("category", "rep").agg(F.avg("stat").alias("stat")), ["category"], "stat"), ["category"], *IV),
    _DRAW + _NEST + f", sc AS (SELECT rep, category, avg(stat) AS stat FROM st JOIN {CATEGORIES} USING (mechanism) GROUP BY ALL) " + _iv("sc", "category"))


def _method_range(s, d):
    """Best and worst method of each mechanism, their range, and whether even the best is low: its bootstrap interval ends below 0.30."""
    point = led(s, d).groupBy("mechanism", "model").agg(F.avg("diagnostic_ap").alias("m")).groupBy("mechanism").agg(F.max("m").alias("best"), F.min("m").alias("worst"))
    drawn = stats.unit_bootstrap(led(s, d), "dataset_id", "diagnostic_ap", ["mechanism", "model"], REPS, S).groupBy("mechanism", "rep").agg(F.max("stat").alias("best"))
    high = drawn.groupBy("mechanism").agg(F.percentile("best", F.lit(0.975)).alias("best_high"))
    out = point.join(high, "mechanism").withColumn("spread", F.col("best") - F.col("worst"))
    return out.select("mechanism", (F.col("best_high") < 0.30).alias("low_everywhere"), *(F.round(c, 6).alias(c) for c in ("best", "worst", "spread", "best_high")))


add("a10_method_range", _method_range, _DRAW + _UNIT.format(by="mechanism, model", v="diagnostic_ap", t="ledger") + """, mx AS (SELECT rep, mechanism, max(stat) AS b FROM st GROUP BY ALL), hi AS (SELECT mechanism, quantile_cont(b, 0.975) AS best_high FROM mx GROUP BY 1),
    m AS (SELECT mechanism, model, avg(diagnostic_ap) AS m FROM ledger GROUP BY ALL), p AS (SELECT mechanism, max(m) AS best, min(m) AS worst FROM m GROUP BY 1)
    SELECT mechanism, best_high < 0.30 AS low_everywhere, round(best, 6) AS best, round(worst, 6) AS worst, round(best - worst, 6) AS spread, round(best_high, 6) AS best_high FROM p JOIN hi USING (mechanism)""")  # fmt: skip


def _task_matrix(s, d):
    df = led(s, d).join(F.broadcast(categories(s)), "mechanism").groupBy("dataset_id").pivot("category", ["boundary", "simple", "structured"]).agg(F.avg("paired_harm"))
    pair = lambda n, a, b: F.struct(F.lit(n).alias("contrast"), F.round(F.col(a) - F.col(b), 9).alias("v"))
    each = F.explode(F.array(pair("boundary_structured", "boundary", "structured"), pair("simple_boundary", "simple", "boundary"), pair("simple_structured", "simple", "structured")))
    return df.select("dataset_id", each.alias("_c")).select("dataset_id", "_c.contrast", "_c.v")


# the sums of all sign patterns of either half of a group's values, and how many of their pairs are as far from 0 as the observed sum
_HALF = """{n} AS (SELECT g, list_sum([0.0] || list_transform(range({low}, {high}), lambda i: CASE WHEN (bits >> (i - {low})) & 1 = 1 THEN v[i + 1] ELSE -v[i + 1] END)) AS x FROM gv, range(8192) b(bits) WHERE bits < (1 << ({high} - ({low}))))"""
_FLIP = ", " + _HALF.format(n="lf", low="0", high="len(v) // 2") + ", " + _HALF.format(n="rf", low="len(v) // 2", high="len(v)") + """,
    tt AS (SELECT g, abs(list_sum(v)) - 1e-12 AS t FROM gv), qs AS (SELECT g, x AS v, 1 AS k FROM rf UNION ALL SELECT g, t - x, 0 FROM lf JOIN tt USING (g) UNION ALL SELECT g, -t - x, 2 FROM lf JOIN tt USING (g)),
    cn AS (SELECT g, k, sum(CAST(k = 1 AS INT)) OVER (PARTITION BY g ORDER BY v, k ROWS UNBOUNDED PRECEDING) AS n, sum(CAST(k = 1 AS INT)) OVER (PARTITION BY g) AS nr FROM qs),
    far AS (SELECT g, sum(CASE k WHEN 0 THEN nr - n WHEN 2 THEN n ELSE 0 END) / CAST(any_value(nr) * count(*) FILTER (k = 0) AS DOUBLE) AS p FROM cn GROUP BY g),
    sf AS (SELECT g, len(v) AS n, list_sum(v) / len(v) AS mean, CASE WHEN t <= 0 THEN 1 ELSE p END AS p FROM gv JOIN tt USING (g) JOIN far USING (g))"""
_MATRIX = f""", mx AS (SELECT dataset_id, avg(paired_harm) FILTER (category = 'boundary') AS b, avg(paired_harm) FILTER (category = 'simple') AS s, avg(paired_harm) FILTER (category = 'structured') AS t FROM {_CAT} GROUP BY 1),
    ct AS (SELECT dataset_id, 'boundary_structured' AS contrast, round(b - t, 9) AS v FROM mx UNION ALL SELECT dataset_id, 'simple_boundary', round(s - b, 9) FROM mx UNION ALL SELECT dataset_id, 'simple_structured', round(s - t, 9) FROM mx),
    gv AS (SELECT contrast AS g, list(v ORDER BY dataset_id) AS v FROM ct WHERE v IS NOT NULL GROUP BY 1)""" + _FLIP
add("b9_exact_sign_flip", lambda s, d: rounded(stats.halved_sign_flip(_task_matrix(s, d), ["contrast"], "v"), ["contrast", "n"], "mean", "p"), _MATRIX + " SELECT g AS contrast, CAST(n AS INT) AS n, round(mean, 6) AS mean, round(p, 6) AS p FROM sf")
_HOLM = ", hl AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS a FROM sf), hm AS (SELECT *, least(1.0, max(a) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)) AS p_holm FROM hl)"
add("b6_category_contrasts", lambda s, d: rounded(stats.holm(stats.halved_sign_flip(_task_matrix(s, d), ["contrast"], "v"), "p"), ["contrast"], "mean", "p", "p_holm"), _MATRIX + _HOLM + " SELECT g AS contrast, round(mean, 6) AS mean, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM hm")
add("b11_holm", lambda s, d: rounded(stats.holm(led(s, d).groupBy("mechanism").agg(F.round(F.avg(F.abs("paired_harm")) / 4, 9).alias("p")), "p"), ["mechanism"], "p", "p_holm"),
    """, sf AS (SELECT mechanism, round(avg(abs(paired_harm)) / 4, 9) AS p FROM ledger GROUP BY 1)""" + _HOLM + " SELECT mechanism, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM hm")  # fmt: skip
add("b10_sampled_sign_flip", lambda s, d: rounded(stats.sampled_sign_flip(led(s, d).groupBy("dataset_id").agg(F.round(F.avg("paired_harm"), 9).alias("v")), "dataset_id", "v", 500, S), [], "mean", "p"),
    f""", u AS (SELECT dataset_id, round(avg(paired_harm), 9) AS v FROM ledger GROUP BY 1), fl AS (SELECT rep, avg(CASE WHEN {u_sql(f"'{S}|' || rep || '|' || dataset_id")} < 0.5 THEN v ELSE -v END) AS s FROM u, range(500) r(rep) GROUP BY rep),
    ob AS (SELECT avg(v) AS mean FROM u) SELECT round(mean, 6) AS mean, round((sum(CAST(abs(s) >= abs(mean) - 1e-12 AS INT)) + 1) / CAST(501 AS DOUBLE), 6) AS p FROM fl, ob GROUP BY mean""")  # fmt: skip


def _joint(s, d):
    """Correlation of detectability and harm over mechanisms, both from the same draws."""
    both = None
    for c in ("diagnostic_ap", "paired_harm"):
        st = stats.nested_bootstrap(led(s, d), "dataset_id", "seed", c, ["mechanism"], REPS, S).withColumnRenamed("stat", c)
        both = st if both is None else both.join(st, ["mechanism", "rep"])
    c = stats.correlations(both.withColumns({"diagnostic_ap": F.round("diagnostic_ap", 9), "paired_harm": F.round("paired_harm", 9)}), "diagnostic_ap", "paired_harm", ["rep"])
    return c.agg(*(F.round(F.percentile(k, F.lit(q)), 6).alias(f"{k}_{n}") for k in ("pearson", "spearman") for q, n in ((0.025, "low"), (0.975, "high"))))


add("b7_joint_bootstrap", _joint, _DRAW + _NEST.replace("avg(paired_harm) AS m FROM", "avg(paired_harm) AS m, avg(diagnostic_ap) AS m2 FROM").replace("avg(m) AS stat FROM", "round(avg(m), 9) AS h, round(avg(m2), 9) AS x FROM") + """,
    rk AS (SELECT *, rank() OVER (PARTITION BY rep ORDER BY x) + (count(*) OVER (PARTITION BY rep, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY rep ORDER BY h) + (count(*) OVER (PARTITION BY rep, h) - 1) / 2.0 AS rh FROM st),
    cr AS (SELECT rep, corr(x, h) AS p, corr(rx, rh) AS s FROM rk GROUP BY rep)
    SELECT round(quantile_cont(p, 0.025), 6) AS pearson_low, round(quantile_cont(p, 0.975), 6) AS pearson_high, round(quantile_cont(s, 0.025), 6) AS spearman_low, round(quantile_cont(s, 0.975), 6) AS spearman_high FROM cr""")  # fmt: skip
_mech = lambda s, d: led(s, d).groupBy("mechanism", "model").agg(F.round(F.avg("diagnostic_ap"), 9).alias("x"), F.round(F.avg("paired_harm"), 9).alias("h")).withColumn("item", F.concat("mechanism", "model"))
_MECH = ", mm AS (SELECT mechanism, model, mechanism || model AS item, round(avg(diagnostic_ap), 9) AS x, round(avg(paired_harm), 9) AS h FROM ledger GROUP BY mechanism, model)"
add("b18_correlations", lambda s, d: rounded(stats.correlations(_mech(s, d), "x", "h"), [], "pearson", "spearman", "cosine"),
    _MECH + """, r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0 AS rh FROM mm)
    SELECT round(corr(x, h), 6) AS pearson, round(corr(rx, rh), 6) AS spearman, round(sum(x * h) / sqrt(sum(x * x) * sum(h * h)), 6) AS cosine FROM r""")  # fmt: skip
add("b18_kendall", lambda s, d: rounded(stats.kendall(_mech(s, d), "item", "x", "h"), [], "tau_b"),
    _MECH + " SELECT round(sum(sign(a.x - b.x) * sign(a.h - b.h)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.h - b.h)))), 6) AS tau_b FROM mm a JOIN mm b ON a.item < b.item")
add("b19_concordance", lambda s, d: rounded(stats.concordance(_mech(s, d), "model", "mechanism", "h"), ["n_raters", "n_items"], "kendall_w"),
    _MECH + """, r AS (SELECT mechanism, rank() OVER (PARTITION BY model ORDER BY h) + (count(*) OVER (PARTITION BY model, h) - 1) / 2.0 AS r FROM mm), t AS (SELECT mechanism, sum(r) AS t, count(*) AS m FROM r GROUP BY 1)
    SELECT any_value(m) AS n_raters, count(*) AS n_items, round(12 * var_pop(t) * count(*) / (any_value(m) * any_value(m) * (count(*) * count(*) * count(*) - count(*))), 6) AS kendall_w FROM t""")  # fmt: skip
add("b15_regression", lambda s, d: rounded(stats.regression(led(s, d), "diagnostic_ap", "paired_harm", ["model"]), ["model"], "slope", "intercept", "r2"),
    "SELECT model, round(regr_slope(paired_harm, diagnostic_ap), 6) AS slope, round(regr_intercept(paired_harm, diagnostic_ap), 6) AS intercept, round(regr_r2(paired_harm, diagnostic_ap), 6) AS r2 FROM ledger GROUP BY model")
_R2 = ["r2_category", "r2_both", "r2_increment", "partial_correlation"]
add("b15_category_r2", lambda s, d: rounded(stats.category_r2(led(s, d).join(F.broadcast(categories(s)), "mechanism"), "category", "diagnostic_ap", "paired_harm"), [], *_R2),
    f""", c AS (SELECT paired_harm AS h, diagnostic_ap - avg(diagnostic_ap) OVER w AS x, paired_harm - avg(paired_harm) OVER w AS y FROM {_CAT} WINDOW w AS (PARTITION BY category)),
    s AS (SELECT sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, var_pop(h) * count(*) AS al FROM c)
    SELECT round(1 - yy / al, 6) AS r2_category, round(1 - (yy - xy * xy / xx) / al, 6) AS r2_both, round(xy * xy / xx / al, 6) AS r2_increment, round(xy / sqrt(xx * yy), 6) AS partial_correlation FROM s""")  # fmt: skip
add("b17_cooks_distance", lambda s, d: rounded(stats.cooks_distance(_mech(s, d), "x", "h"), ["mechanism", "model"], "cook"),
    _MECH + """, s AS (SELECT regr_slope(h, x) AS b, regr_intercept(h, x) AS a, avg(x) AS m, var_pop(x) * count(*) AS sxx, count(*) AS n FROM mm), e AS (SELECT mm.*, s.*, h - a - b * x AS e FROM mm, s),
    v AS (SELECT sum(e * e) / (count(*) - 2) AS s2 FROM e), w AS (SELECT *, 1.0 / n + (x - m) * (x - m) / sxx AS lev FROM e, v)
    SELECT mechanism, model, round(e * e / (2 * s2) * lev / ((1 - lev) * (1 - lev)), 6) AS cook FROM w""")  # fmt: skip


def _two_way(s, d):
    """Share of the cell means' variation that main effects of mechanism and model explain, and what interaction adds."""
    m = _mech(s, d).withColumns({"a": F.avg("h").over(Window.partitionBy("mechanism")), "b": F.avg("h").over(Window.partitionBy("model"))})
    m = m.crossJoin(F.broadcast(m.agg(F.avg("h").alias("g"))))
    fit = F.col("a") + F.col("b") - F.col("g")
    ss = lambda c: F.sum((c - F.col("g")) * (c - F.col("g")))
    return m.agg(F.round(ss(fit) / ss(F.col("h")), 6).alias("r2_main"), F.round(1 - ss(fit) / ss(F.col("h")), 6).alias("r2_interaction"))


add("b20_two_way", _two_way, _MECH + """, w AS (SELECT h, avg(h) OVER (PARTITION BY mechanism) AS a, avg(h) OVER (PARTITION BY model) AS b, (SELECT avg(h) FROM mm) AS g FROM mm)
    SELECT round(sum((a + b - 2 * g) * (a + b - 2 * g)) / sum((h - g) * (h - g)), 6) AS r2_main, round(1 - sum((a + b - 2 * g) * (a + b - 2 * g)) / sum((h - g) * (h - g)), 6) AS r2_interaction FROM w""")  # fmt: skip
add("b21_dose_response", lambda s, d: rounded(stats.dose_slope(led(s, d).groupBy("mechanism", "strength").agg(F.avg("paired_harm").alias("m")), ["mechanism"], "strength", "m"), ["mechanism"], "slope"),
    """, m AS (SELECT mechanism, strength, avg(paired_harm) AS m FROM ledger GROUP BY ALL), z AS (SELECT mechanism, m, (strength - avg(strength) OVER w) / stddev_pop(strength) OVER w AS z FROM m WINDOW w AS (PARTITION BY mechanism))
    SELECT mechanism, round(avg(z * m), 6) AS slope FROM z GROUP BY mechanism""")  # fmt: skip


def _dose(s, d):
    """Means over learners in each task, then slopes over strengths with replicates of datasets and of seeds within them."""
    task = led(s, d).groupBy("dataset_id", "seed", "mechanism", "strength").agg(F.avg("paired_harm").alias("m"))
    point = task.groupBy("mechanism", "strength").agg(F.avg("m").alias("m"))
    drawn = stats.nested_bootstrap(task, "dataset_id", "seed", "m", ["mechanism", "strength"], REPS, S)
    return rounded(stats.dose_response(point, drawn, ["mechanism"], "strength", "m"), ["mechanism", "positive_steps", "steps"], "slope", "low", "high", "p", "p_holm")


add("b21_dose_effects", _dose, _DRAW + _NEST.replace("seed, mechanism, avg", "seed, mechanism, strength, avg").replace("rep, mechanism, avg", "rep, mechanism, strength, avg") + """,
    pt AS (SELECT mechanism, strength, avg(m) AS m FROM ce GROUP BY ALL), zp AS (SELECT mechanism, m, (strength - avg(strength) OVER w) / stddev_pop(strength) OVER w AS z, m - lag(m) OVER (PARTITION BY mechanism ORDER BY strength) AS up FROM pt WINDOW w AS (PARTITION BY mechanism)),
    sl AS (SELECT mechanism, avg(z * m) AS slope, coalesce(sum(CAST(up > 0 AS INT)), 0) AS positive_steps, count(up) AS steps FROM zp GROUP BY 1),
    zr AS (SELECT mechanism, rep, stat, (strength - avg(strength) OVER w) / stddev_pop(strength) OVER w AS z FROM st WINDOW w AS (PARTITION BY mechanism, rep)), rs AS (SELECT mechanism, rep, avg(z * stat) AS slope FROM zr GROUP BY ALL),
    sf AS (SELECT mechanism, quantile_cont(slope, 0.025) AS low, quantile_cont(slope, 0.975) AS high, least(1.0, 2 * least(avg(CAST(slope <= 0 AS INT)), avg(CAST(slope >= 0 AS INT)))) AS p FROM rs GROUP BY 1)""" + _HOLM + """
    SELECT mechanism, CAST(positive_steps AS BIGINT) AS positive_steps, steps, round(slope, 6) AS slope, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM hm JOIN sl USING (mechanism)""")  # fmt: skip
add("b22_model_dispersion", lambda s, d: _mech(s, d).groupBy("mechanism").agg(F.round(F.stddev_pop("h"), 6).alias("dispersion"), F.max_by("model", F.struct("h", "model")).alias("highest"), F.min_by("model", F.struct("h", "model")).alias("lowest")),
    _MECH + " SELECT mechanism, round(stddev_pop(h), 6) AS dispersion, arg_max(model, (h, model)) AS highest, arg_min(model, (h, model)) AS lowest FROM mm GROUP BY mechanism")


def _contrasts(s, d):
    """Every model less lr, by replicates of datasets."""
    st = stats.unit_bootstrap(led(s, d), "dataset_id", "paired_harm", ["model"], REPS, S)
    base = st.where("model = 'lr'").select("rep", F.col("stat").alias("base"))
    return rounded(stats.interval(st.where("model <> 'lr'").join(base, "rep").withColumn("stat", F.col("stat") - F.col("base")), ["model"], "stat"), ["model"], *IV)


add("b23_model_contrasts", _contrasts, _DRAW + _UNIT.format(by="model", v="paired_harm", t="ledger") + ", df3 AS (SELECT a.rep, a.model, a.stat - b.stat AS stat FROM st a JOIN st b ON a.rep = b.rep AND b.model = 'lr' WHERE a.model <> 'lr') " + _iv("df3", "model"))
add("b24_learner_interaction", lambda s, d: rounded(stats.interval(stats.unit_bootstrap(_diff(led(s, d)).where("a = 'gbt' AND b = 'rf'").withColumn("w", F.when(F.col("seed") == 1, F.col("v")).otherwise(-F.col("v"))), "dataset_id", "w", ["strength"], REPS, S), ["strength"], "stat"), ["strength"], *IV),
    _DIFF + _DRAW + _UNIT.format(by="strength", v="CASE WHEN seed = 1 THEN v ELSE -v END", t="(SELECT * FROM df WHERE a = 'gbt' AND b = 'rf')") + _iv("st", "strength"))
add("b25_stratified", lambda s, d: rounded(L.quantile_bin(led(s, d), "paired_harm").groupBy("bin", "model").agg(F.count("*").alias("n"), F.avg("diagnostic_ap").alias("mean_ap"), F.avg((F.col("governed_auc") > F.col("clean_auc")).cast("int")).alias("positive_share")), ["bin", "model", "n"], "mean_ap", "positive_share"),
    """, e AS (SELECT quantile_cont(paired_harm, [0.25, 0.5, 0.75]) AS e FROM ledger) SELECT CAST(len(list_filter(e, lambda x: x < paired_harm)) AS INT) AS bin, model, count(*) AS n, round(avg(diagnostic_ap), 6) AS mean_ap,
    round(avg(CAST(governed_auc > clean_auc AS INT)), 6) AS positive_share FROM ledger, e GROUP BY ALL""")  # fmt: skip
add("b27_detectability_intervals", lambda s, d: rounded(stats.interval(stats.nested_bootstrap(led(s, d), "dataset_id", "seed", "diagnostic_ap", ["mechanism"], REPS, S), ["mechanism"], "stat"), ["mechanism"], *IV), _DRAW + _NEST.replace("paired_harm", "diagnostic_ap") + _iv("st", "mechanism"))
def _all_cases(s, d):
    t = led(s, d).groupBy("mechanism", "dataset_id").agg(F.round(F.avg("paired_harm"), 9).alias("v"))
    return rounded(stats.halved_sign_flip(t, ["mechanism"], "v").join(t.groupBy("mechanism").agg(F.min(F.col("v") > 0).alias("all_positive")), "mechanism"), ["mechanism", "all_positive"], "mean", "p")


add("b28_case_studies", _all_cases, ", gv AS (SELECT mechanism AS g, list(v ORDER BY dataset_id) AS v FROM (SELECT mechanism, dataset_id, round(avg(paired_harm), 9) AS v FROM ledger GROUP BY ALL) GROUP BY 1)" + _FLIP + """
    SELECT g AS mechanism, (SELECT bool_and(x > 0) FROM (SELECT unnest(v) AS x)) AS all_positive, round(mean, 6) AS mean, round(p, 6) AS p FROM sf JOIN gv USING (g)""")  # fmt: skip


def _auc_bootstrap(s, d):
    """Difference of two columns' areas under the curve over drawn entities of each dataset: weights by cluster, both from one draw."""
    p = panel(s, d)
    return rounded(auc_effects(p, entity_weights(p, INNER)), ["dataset_id", "rep"], "effect")


INNER = 20  # inner draws that the outer interval draws from
_AUC = ", " + ", ".join(f"""f_{c} AS (SELECT dataset_id, rep, {c} AS v, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM rw GROUP BY ALL),
    a_{c} AS (SELECT dataset_id, rep, sum(p * (below - q / 2)) / (sum(p) * sum(q)) AS a FROM (SELECT *, sum(q) OVER (PARTITION BY dataset_id, rep ORDER BY v ROWS UNBOUNDED PRECEDING) AS below FROM f_{c}) GROUP BY ALL)""" for c in ("x_quantity", "x_discount"))  # fmt: skip
QUERIES["b13_auc_bootstrap"], ORACLE["b13_auc_bootstrap"] = _auc_bootstrap, PANEL + f""",
    pp AS (SELECT * FROM panel), un AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS unit FROM (SELECT DISTINCT entity_id FROM pp)), nu AS (SELECT count(*) AS n FROM un),
    dr AS (SELECT rep, CAST(floor({u_sql(f"'{S}|' || rep || '|' || slot")} * n) AS BIGINT) AS unit FROM nu, range(20) r(rep), range(100000) s(slot) WHERE slot < n),
    wt AS (SELECT rep, entity_id, CAST(count(*) AS DOUBLE) AS w FROM dr JOIN un USING (unit) GROUP BY ALL), rw AS (SELECT pp.*, rep, w FROM pp JOIN wt USING (entity_id)){_AUC}
    SELECT dataset_id, rep, round(x.a - z.a, 6) AS effect FROM a_x_quantity x JOIN a_x_discount z USING (dataset_id, rep) WHERE x.a IS NOT NULL AND z.a IS NOT NULL AND NOT isnan(x.a)"""  # fmt: skip
add("c5_before_after", lambda s, d: L.one_to_one(led(s, d).groupBy("mechanism").agg(F.avg("paired_harm").alias("before")), led(s, d).where("model <> 'gbt'").groupBy("mechanism").agg(F.avg("paired_harm").alias("after")), ["mechanism"]).withColumn("moved", F.abs(F.col("after") - F.col("before")) > 0.001).select("mechanism", "moved", F.round(F.col("after") - F.col("before"), 6).alias("change")),
    "SELECT mechanism, abs(avg(paired_harm) FILTER (model <> 'gbt') - avg(paired_harm)) > 0.001 AS moved, round(avg(paired_harm) FILTER (model <> 'gbt') - avg(paired_harm), 6) AS change FROM ledger GROUP BY mechanism")
def _rest_r2(s, d):
    m = _mech(s, d).join(F.broadcast(categories(s)), "mechanism")
    return rounded(stats.left_out_r2(m, "category", "x", "h"), ["n"], "r2_category", "r2_both")


add("b16_leave_one_out_r2", _rest_r2, _MECH + f""", c AS (SELECT * FROM mm JOIN {CATEGORIES} USING (mechanism)), l AS (SELECT a.item AS out, b.* FROM c a JOIN c b ON a.item <> b.item),
    k AS (SELECT out, category, avg(x) AS mx, avg(h) AS mh FROM l GROUP BY ALL), b AS (SELECT out, sum((x - mx) * (h - mh)) / sum((x - mx) * (x - mx)) AS b FROM l JOIN k USING (out, category) GROUP BY out),
    p AS (SELECT c.h, mh AS pc, mh + b * (x - mx) AS pf FROM c JOIN k ON k.out = c.item AND k.category = c.category JOIN b ON b.out = c.item)
    SELECT count(*) AS n, round(1 - sum((h - pc) * (h - pc)) / (var_pop(h) * count(*)), 6) AS r2_category, round(1 - sum((h - pf) * (h - pf)) / (var_pop(h) * count(*)), 6) AS r2_both FROM p""")  # fmt: skip


def _pearson_bootstrap(s, d):
    """Interval of the correlation over drawn cells of mechanism and model; draws without spread are skipped."""
    units = stats.numbered(_mech(s, d), "item")
    n = units.count()
    c = stats.draws(s, REPS, n, S).join(F.broadcast(units), "unit").groupBy("rep").agg(metrics.pearson("x", "h").alias("r")).where("r IS NOT NULL AND NOT isnan(r)")
    return c.agg(F.round(F.percentile("r", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("r", F.lit(0.975)), 6).alias("high"))


add("b8_correlation_bootstrap", _pearson_bootstrap, _MECH + f""", un AS (SELECT *, row_number() OVER (ORDER BY item) - 1 AS unit FROM mm), nu AS (SELECT count(*) AS n FROM un),
    dr AS (SELECT rep, CAST(floor({u_sql(f"'{S}|' || rep || '|' || slot")} * n) AS BIGINT) AS unit FROM nu, range({REPS}) r(rep), range(1000) s(slot) WHERE slot < n),
    c AS (SELECT rep, corr(x, h) AS r FROM dr JOIN un USING (unit) GROUP BY rep) SELECT round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM c WHERE NOT isnan(r)""")  # fmt: skip


def _whole_auc_bootstrap(s, d):
    """As _auc_bootstrap, over all datasets and REPS replicates: rows are collapsed to entity, label and score before they are drawn."""
    p = panel(s, d)
    return rounded(auc_effects(p, entity_weights(p, REPS)), ["dataset_id", "rep"], "effect")


def entity_weights(p, reps, seed=S):
    """rep, entity_id, w: how often each entity is drawn, if at all. Entities are numbered by their key, through ranges."""
    units = order.ranked(p.select("entity_id").distinct(), [], [F.col("entity_id")]).select("entity_id", (F.col("pos") - 1).alias("unit")).checkpoint()
    n = units.count()
    drawn = units.select(F.col("unit").alias("slot")).crossJoin(F.broadcast(p.sparkSession.range(reps).withColumnRenamed("id", "rep")))
    drawn = drawn.select("rep", stats.pick(n, str(seed), F.col("rep"), F.col("slot")).alias("unit")).groupBy("rep", "unit").agg(F.count("*").cast("double").alias("w"))
    return drawn.join(units, "unit").drop("unit")


def auc_effects(p, weights):
    """dataset_id, rep, effect of x_quantity less x_discount; draws that leave a dataset without a class have none."""
    columns = ("x_quantity", "x_discount")
    score = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("score")) for c in columns))).alias("_c")
    cells = p.select("dataset_id", "entity_id", "y", score).groupBy("dataset_id", "entity_id", "y", "_c.column", "_c.score").agg(F.count("*").alias("n"))
    rows = cells.join(weights, "entity_id").withColumn("w", F.col("w") * F.col("n"))
    area = metrics.auroc(rows, ["dataset_id", "rep", "column"], "score", weight="w")
    wide = area.groupBy("dataset_id", "rep").pivot("column", list(columns)).agg(F.first("auroc"))
    return wide.withColumn("effect", F.col(columns[0]) - F.col(columns[1])).where("effect IS NOT NULL").select("dataset_id", "rep", "effect")


QUERIES["b13_auc_bootstrap_whole"] = _whole_auc_bootstrap


def _outer(s, d):
    """Interval of the mean effect when datasets and seeds are drawn, and within each drawn pair one of the inner draws of entities that it stored."""
    p = panel(s, d)
    store = None
    for seed in SEEDS:
        own = auc_effects(p, entity_weights(p, INNER, seed)).withColumn("seed", F.lit(seed))
        store = own if store is None else store.unionByName(own)
    drawn = stats.outer_bootstrap(store.checkpoint(), "dataset_id", "seed", "rep", "effect", [], REPS, S)
    return rounded(stats.interval(drawn, [], "stat"), [], *IV)


SEEDS = (7, 8)  # of the inner draws
QUERIES["b14_outer_interval"] = _outer
ORACLE["b14_outer_interval"] = PANEL + f""",
    pp AS (SELECT * FROM panel), eu AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS unit FROM (SELECT DISTINCT entity_id FROM pp)), en AS (SELECT count(*) AS n FROM eu),
    dq AS (SELECT seed * 1000 + r AS rep, CAST(floor({u_sql("seed || '|' || r || '|' || slot")} * n) AS BIGINT) AS unit FROM en, range({INNER}) r(r), (VALUES {", ".join(f"({x})" for x in SEEDS)}) v(seed), range(100000) s(slot) WHERE slot < n),
    wt AS (SELECT rep, entity_id, CAST(count(*) AS DOUBLE) AS w FROM dq JOIN eu USING (unit) GROUP BY ALL), rw AS (SELECT pp.*, rep, w FROM pp JOIN wt USING (entity_id)){_AUC},
    ef AS (SELECT dataset_id, rep // 1000 AS seed, rep % 1000 AS draw, x.a - z.a AS effect FROM a_x_quantity x JOIN a_x_discount z USING (dataset_id, rep) WHERE x.a IS NOT NULL AND z.a IS NOT NULL AND NOT isnan(x.a)),
    ix AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, seed ORDER BY draw) - 1 AS k, count(*) OVER (PARTITION BY dataset_id, seed) AS nk FROM ef),
    ds AS (SELECT dataset_id, row_number() OVER (ORDER BY dataset_id) - 1 AS unit, count(*) OVER () AS n FROM (SELECT DISTINCT dataset_id FROM ef)),
    sd AS (SELECT dataset_id, seed, nk, row_number() OVER (PARTITION BY dataset_id ORDER BY seed) - 1 AS j, count(*) OVER (PARTITION BY dataset_id) AS ns FROM (SELECT DISTINCT dataset_id, seed, nk FROM ix)),
    d1 AS (SELECT rep, slot, CAST(floor({u_sql(f"'{S}|' || rep || '|' || slot")} * n) AS BIGINT) AS unit FROM (SELECT any_value(n) AS n FROM ds), range({REPS}) r(rep), range(1000) s(slot) WHERE slot < n),
    d2 AS (SELECT rep, slot, dataset_id, ns, i FROM d1 JOIN ds USING (unit) JOIN (SELECT DISTINCT dataset_id, ns FROM sd) USING (dataset_id), range(10) t(i) WHERE i < ns),
    d3 AS (SELECT rep, slot, i, d2.dataset_id, seed, CAST(floor({u_sql(f"'{S}|inner|' || rep || '|' || slot || '|' || i")} * nk) AS BIGINT) AS k FROM d2 JOIN sd ON sd.dataset_id = d2.dataset_id AND sd.j = CAST(floor({u_sql(f"'{S}|in|' || rep || '|' || slot || '|' || i")} * d2.ns) AS BIGINT)),
    st AS (SELECT rep, avg(effect) AS stat FROM d3 JOIN ix USING (dataset_id, seed, k) GROUP BY rep) """ + _iv("st")  # fmt: skip
