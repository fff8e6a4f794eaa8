"""Queries on columns: metrics, rankers and removal policies, over a panel with probes of known truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.operators import columns, metrics, order, policies, probes, rankers
from fieldaudit.plans.panel_queries import S, _noise
from fieldaudit.plans.tables import FEATURES, PANEL, melted, melted_sql, panel, read

QUERIES, ORACLE = {}, {}
COLUMNS = [*FEATURES, "m02", "m10_copy", "m10"]
# The registry of the columns
REGISTRY = [
    ("x_quantity", 0, True, "prediction_time", None, False, False), ("x_discount", 1, True, "source_specific", "part", False, False), ("x_tax", 2, True, "pre_outcome", None, False, True),
    ("x_size", 3, True, "unknown", "part", False, False), ("x_price", 4, True, "prediction_time", "part", False, False), ("m02", 5, False, "post_outcome", None, True, False),
    ("m10_copy", 6, True, "prediction_time", "M10", False, False), ("m10", 7, False, "future_window", "M10", True, True),
]
EDGES = [("x_quantity", "m10_copy", 1.0), ("m10_copy", "m10", 0.8), ("x_size", "x_price", 0.4), ("m10", "x_tax", 0.2)]
LEAKS = ("m02", "m10")
_lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
_values = lambda rows: ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)
PROBED = PANEL + f""",
probed AS (SELECT *, round(0.8 * (y - prior) + {_noise('m02')}, 6) AS m02, x_quantity AS m10_copy, round(0.5 * (y - prior) + {_noise('m10')}, 6) AS m10 FROM splitted),
ml AS ({melted_sql('probed', COLUMNS, 'dataset_id, source_id, split, row_id, y')}),
registry AS (SELECT * FROM (VALUES {_values(REGISTRY)}) r(feature_id, position, available, lifecycle, group_id, outcome_descendant, post_event_table)),
edges AS (SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM (VALUES {_values(EDGES)}) e(src, dst, weight)),
sc AS (SELECT c.*, r.* EXCLUDE (feature_id, position), c.feature_id IN {LEAKS} AS is_leak
       FROM (SELECT dataset_id, feature_id, position, coalesce(round(abs(corr(value, y)), 6), 0) AS score FROM ml WHERE split = 'train' GROUP BY ALL) c JOIN registry r USING (feature_id))"""


def probed(s, d):
    p = probes.compose(order.time_split(panel(s, d)), lambda x: probes.noisy_proxy(x, 0.8, S), lambda x: probes.mixed_group(x, 0.5, S, "x_quantity"))
    return p.withColumns({"m02": F.round("m02", 6), "m10": F.round("m10", 6)})


def long(s, d):
    return melted(probed(s, d), COLUMNS, ["dataset_id", "source_id", "split", "row_id", "y"])


def registry(s):
    return s.createDataFrame(REGISTRY, "feature_id string, position int, available boolean, lifecycle string, group_id string, outcome_descendant boolean, post_event_table boolean")


def edges(s):
    return s.createDataFrame(EDGES, "src string, dst string, weight double")


def scores(s, d):
    c = rankers.correlation(long(s, d).where("split = 'train'"), ["dataset_id", "feature_id", "position"]).withColumn("score", F.round("corr", 6)).drop("corr")
    c = c.checkpoint()  # a row a column and dataset, which the policies read several times
    return c.join(F.broadcast(registry(s).drop("position")), "feature_id").withColumn("is_leak", F.col("feature_id").isin(*LEAKS))


def rounded(df, keep, *cols):
    return df.select(*keep, *(F.round(F.col(c).cast("double"), 6).alias(c) for c in cols))


def add(name, run, sql):
    QUERIES[name], ORACLE[name] = run, PROBED + "\n" + sql


KEY = ["dataset_id", "feature_id"]
add("e1_auroc", lambda s, d: rounded(metrics.auroc(long(s, d).where("split = 'test'"), KEY, "value"), KEY, "n_pos", "n_neg", "auroc"),
    """, f AS (SELECT dataset_id, feature_id, value, sum(y) AS p, sum(1 - y) AS q FROM ml WHERE split = 'test' GROUP BY ALL),
    g AS (SELECT *, sum(q) OVER (PARTITION BY dataset_id, feature_id ORDER BY value ROWS UNBOUNDED PRECEDING) - q / 2.0 AS below FROM f)
    SELECT dataset_id, feature_id, CAST(sum(p) AS DOUBLE) AS n_pos, CAST(sum(q) AS DOUBLE) AS n_neg, round(CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * below) / CAST(sum(p) * sum(q) AS DOUBLE) END, 6) AS auroc FROM g GROUP BY ALL""")  # fmt: skip
_AP = """, f AS (SELECT dataset_id, score, count(*) AS n, sum(CAST(is_leak AS INT)) AS t FROM sc GROUP BY ALL),
    g AS (SELECT *, t * sum(t) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS h FROM f WINDOW w AS (PARTITION BY dataset_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    ap AS (SELECT dataset_id, sum(n) AS n, sum(t) AS n_true, CASE WHEN sum(t) > 0 THEN sum(h) / sum(t) ELSE 0 END AS ap FROM g GROUP BY ALL),
    apn AS (SELECT *, (ap - n_true / CAST(n AS DOUBLE)) / greatest(1e-12, 1 - n_true / CAST(n AS DOUBLE)) AS normalized_ap FROM ap),
    rk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, position DESC) AS k FROM sc)"""
add("e2_average_precision", lambda s, d: rounded(metrics.average_precision(scores(s, d), ["dataset_id"], "score", "is_leak"), ["dataset_id"], "n", "n_true", "ap", "normalized_ap"),
    _AP + " SELECT dataset_id, CAST(n AS DOUBLE) AS n, CAST(n_true AS DOUBLE) AS n_true, round(ap, 6) AS ap, round(normalized_ap, 6) AS normalized_ap FROM apn")
add("e3_localization", lambda s, d: rounded(metrics.localization(scores(s, d), ["dataset_id"]), ["dataset_id"], "ap", "normalized_ap", "top_k_recall", "legitimate_fpr", "reciprocal_rank"),
    _AP + """ SELECT dataset_id, round(ap, 6) AS ap, round(normalized_ap, 6) AS normalized_ap, round(count(*) FILTER (is_leak AND k <= 5) / CAST(2 AS DOUBLE), 6) AS top_k_recall,
    round(count(*) FILTER (NOT is_leak AND k <= 5) / CAST(6 AS DOUBLE), 6) AS legitimate_fpr, round(1 / CAST(min(k) FILTER (is_leak) AS DOUBLE), 6) AS reciprocal_rank
    FROM rk JOIN apn USING (dataset_id) GROUP BY ALL""")  # fmt: skip
add("e4_reciprocal_rank", lambda s, d: rounded(metrics.localization(scores(s, d), ["dataset_id"]), ["dataset_id"], "reciprocal_rank"),
    _AP + " SELECT dataset_id, round(1 / CAST(min(k) FILTER (is_leak) AS DOUBLE), 6) AS reciprocal_rank FROM rk GROUP BY dataset_id")
add("e5_losses", lambda s, d: rounded(metrics.losses(probed(s, d).where("split = 'test'").withColumn("p", F.col("x_quantity") / 60.0), ["dataset_id"], "p"), ["dataset_id"], "log_loss", "brier"),
    """ SELECT dataset_id, round(avg(-(y * ln(x_quantity / 60.0) + (1 - y) * ln(1 - x_quantity / 60.0))), 6) AS log_loss, round(avg((x_quantity / 60.0 - y) * (x_quantity / 60.0 - y)), 6) AS brier
    FROM probed WHERE split = 'test' GROUP BY dataset_id""")  # fmt: skip
add("e14_mean_difference", lambda s, d: rounded(metrics.mean_difference(long(s, d), KEY, "value"), KEY, "smd"),
    """ SELECT dataset_id, feature_id, round(CASE WHEN sqrt((a + b) / 2) > 1e-12 THEN (p - q) / sqrt((a + b) / 2) ELSE 0 END, 6) AS smd FROM (SELECT dataset_id, feature_id,
    avg(value) FILTER (y = 1) AS p, avg(value) FILTER (y = 0) AS q, var_samp(value) FILTER (y = 1) AS a, var_samp(value) FILTER (y = 0) AS b FROM ml GROUP BY ALL)""")  # fmt: skip
_SHARE = """, f AS (SELECT dataset_id, source_id, sum(y) AS p, sum(1 - y) AS q FROM probed GROUP BY ALL),
    g AS (SELECT dataset_id, p / CAST(sum(p) OVER w AS DOUBLE) AS p, q / CAST(sum(q) OVER w AS DOUBLE) AS q FROM f WINDOW w AS (PARTITION BY dataset_id))"""
add("e15_total_variation", lambda s, d: rounded(metrics.total_variation(panel(s, d), ["dataset_id"], "source_id"), ["dataset_id"], "total_variation"),
    _SHARE + " SELECT dataset_id, round(sum(abs(p - q)) / 2, 6) AS total_variation FROM g GROUP BY ALL")
add("e16_jensen_shannon", lambda s, d: rounded(metrics.jensen_shannon(panel(s, d), ["dataset_id"], "source_id"), ["dataset_id"], "js_divergence"),
    _SHARE + " SELECT dataset_id, round(sum(p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) / 2 + q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12)) / 2), 6) AS js_divergence FROM g GROUP BY ALL")


def severity(s, d):
    """Standardised difference of a proxy by strength, and whether it grows from strength to strength."""
    p = panel(s, d)
    for i, strength in enumerate((0.2, 0.5, 0.8)):
        p = probes.noisy_proxy(p, strength, S, f"s{i}")
    m = metrics.mean_difference(melted(p, ["s0", "s1", "s2"], ["y"]), ["position"], "value")
    step = F.col("smd") - F.lag("smd").over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("position"))
    return m.withColumn("grows", F.coalesce(step >= -0.02, F.lit(True))).select("position", F.round("smd", 6).alias("smd"), "grows")


add("e17_severity", severity, ", sv AS (" + " UNION ALL ".join(f"SELECT {i} AS position, y, {x} * (y - prior) + {_noise(f's{i}')} AS v FROM placed" for i, x in enumerate((0.2, 0.5, 0.8))) + """),
    sd AS (SELECT position, (avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / sqrt((var_samp(v) FILTER (y = 1) + var_samp(v) FILTER (y = 0)) / 2) AS smd FROM sv GROUP BY position)
    SELECT position, round(smd, 6) AS smd, coalesce(smd - lag(smd) OVER (ORDER BY position) >= -0.02, true) AS grows FROM sd""")  # fmt: skip
_MI = """, qe AS (SELECT {k}, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM ml WHERE {w} GROUP BY ALL),
    bn AS (SELECT {k}, len(list_filter(e, lambda x: x < value)) AS b, y, count(*) AS n FROM ml JOIN qe USING ({k}) WHERE {w} GROUP BY ALL),
    tm AS (SELECT {k}, n / CAST(sum(n) OVER (PARTITION BY {k}) AS DOUBLE) * ln(n * CAST(sum(n) OVER (PARTITION BY {k}) AS DOUBLE) / (sum(n) OVER (PARTITION BY {k}, b) * CAST(sum(n) OVER (PARTITION BY {k}, y) AS DOUBLE))) AS t FROM bn),
    mi AS (SELECT {k}, greatest(0, sum(t)) AS mi FROM tm GROUP BY ALL)"""
add("d1_mutual_information", lambda s, d: rounded(rankers.mutual_information(long(s, d).where("split = 'train'"), KEY), KEY, "mi"),
    _MI.format(k="dataset_id, feature_id", w="split = 'train'") + " SELECT dataset_id, feature_id, round(mi, 6) AS mi FROM mi")
add("d2_correlation", lambda s, d: scores(s, d).select("dataset_id", "feature_id", "score"), " SELECT dataset_id, feature_id, score FROM sc")
_STAGE = "CASE lifecycle " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rankers.LIFECYCLE.items()) + " ELSE 0.5 END"
_SCALED = "CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE {o} END"


def _instability(s, d):
    found = rankers.instability(long(s, d).where("split = 'train'"), ["feature_id"], "source_id").withColumn("_one", F.lit(1))
    return found.withColumn("scaled", rankers.min_max("instability", ["_one"], 0.0))


add("d5_instability", lambda s, d: rounded(_instability(s, d), ["feature_id"], "instability", "scaled"),
    _MI.format(k="feature_id, source_id", w="split = 'train'") + f""", tc AS (SELECT source_id FROM splitted WHERE split = 'train' GROUP BY 1 HAVING count(*) > 10),
    es AS (SELECT feature_id, CASE WHEN count(*) >= 2 THEN stddev_pop(mi) ELSE 0 END AS x FROM mi JOIN tc USING (source_id) GROUP BY feature_id)
    SELECT feature_id, round(x, 6) AS instability, round({_SCALED.format(c='x', o=0)}, 6) AS scaled FROM es""")  # fmt: skip
add("d6_availability_risk", lambda s, d: rankers.availability_risk(scores(s, d)).select("dataset_id", "feature_id", "availability_risk"),
    f""" SELECT dataset_id, feature_id, CAST(greatest({_STAGE},
    CASE WHEN available THEN 0 ELSE 1 END, CASE WHEN outcome_descendant THEN 1 ELSE 0 END, CASE WHEN post_event_table THEN 0.9 ELSE 0 END) AS DOUBLE) AS availability_risk FROM sc""")  # fmt: skip


def train_counts(s, d):
    """The train rows of all datasets, counted for risks()."""
    return rankers.counted(long(s, d).where("split = 'train'"), ["feature_id", "source_id"])


def risks(s, train):
    """Impact, availability, structure and instability of each column, by train_counts()."""
    mi = rankers.mutual_information(train, ["feature_id"])
    own = rankers.structural_risk(rankers.availability_risk(registry(s)), edges(s))
    out = own.join(mi, "feature_id").join(rankers.instability(train, ["feature_id"], "source_id"), "feature_id").withColumn("_one", F.lit(1))
    return out.withColumns({"i": rankers.min_max("mi", ["_one"]), "a": F.col("availability_risk"), "s": F.col("structural_risk"), "e": rankers.min_max("instability", ["_one"], 0.0)}).drop("_one")


_RISK = (
    _MI.format(k="feature_id", w="split = 'train'")
    + _MI.format(k="feature_id, source_id", w="split = 'train'").replace("qe AS", "qe2 AS").replace("JOIN qe USING", "JOIN qe2 USING").replace("bn AS", "bn2 AS").replace("FROM bn)", "FROM bn2)").replace("tm AS", "tm2 AS").replace("FROM tm ", "FROM tm2 ").replace("mi AS (", "mi2 AS (")
    + f""", tc AS (SELECT source_id FROM splitted WHERE split = 'train' GROUP BY 1 HAVING count(*) > 10),
    es AS (SELECT feature_id, CASE WHEN count(*) >= 2 THEN stddev_pop(mi) ELSE 0 END AS instability FROM mi2 JOIN tc USING (source_id) GROUP BY feature_id),
    dg AS (SELECT feature_id, sum(w) AS d FROM (SELECT src AS feature_id, abs(weight) AS w FROM edges UNION ALL SELECT dst, abs(weight) FROM edges) GROUP BY feature_id),
    gz AS (SELECT group_id, count(*) AS g FROM registry WHERE group_id IS NOT NULL GROUP BY 1),
    st AS (SELECT r.*, coalesce((g - 1) / CAST((SELECT greatest(1, max(g) - 1) FROM gz) AS DOUBLE), 0) AS gs, coalesce(d, 0) AS d FROM registry r LEFT JOIN dg USING (feature_id) LEFT JOIN gz USING (group_id)),
    rs AS (SELECT feature_id, outcome_descendant, post_event_table, {_SCALED.format(c="mi", o=0.5)} AS i,
      greatest({_STAGE}, CASE WHEN available THEN 0 ELSE 1 END, CASE WHEN outcome_descendant THEN 1 ELSE 0 END, CASE WHEN post_event_table THEN 0.9 ELSE 0 END) AS a,
      greatest({_SCALED.format(c="d", o=0)}, gs) AS s, {_SCALED.format(c="instability", o=0)} AS e FROM st JOIN mi USING (feature_id) JOIN es USING (feature_id))"""
)
add("d7_structural_risk", lambda s, d: rounded(risks(s, train_counts(s, d)), ["feature_id"], "s"), _RISK + " SELECT feature_id, round(CAST(s AS DOUBLE), 6) AS s FROM rs")
add("d8_composite", lambda s, d: rounded(risks(s, train_counts(s, d)).withColumn("composite", rankers.composite(None, {"i": 0.30, "a": 0.30, "s": 0.25, "e": 0.15})), ["feature_id"], "composite"),
    _RISK + " SELECT feature_id, round(CAST(0.30 * i + 0.30 * a + 0.25 * s + 0.15 * e AS DOUBLE), 6) AS composite FROM rs")
add("d9_combinations", lambda s, d: rounded(rankers.combinations(risks(s, train_counts(s, d)), ["feature_id"]), ["feature_id", "combo"], "score"),
    _RISK + " " + " UNION ALL ".join(f"SELECT feature_id, '{n}' AS combo, round(CAST({x} AS DOUBLE), 6) AS score FROM rs" for n, x in {
        "I": "i", "A": "a", "S": "s", "E": "e", "I+A": "(i + a) / 2.0", "I+S": "(i + s) / 2.0", "A+S+E": "0.4 * a + 0.4 * s + 0.2 * e", "I+A+S+E": "(i + a + s + e) / 4.0"}.items()))


def cells(s, d):
    return scores(s, d).withColumn("cell", F.col("dataset_id"))


def bad(s, d):
    return scores(s, d).where("is_leak").select("feature_id").distinct()


def _alternate(s, d):
    """The known bad columns are those of the counted train rows: the ones that bad() finds among the scores of the same rows."""
    train = train_counts(s, d)
    known = train.where(F.col("feature_id").isin(*LEAKS)).select("feature_id").distinct()
    return rounded(rankers.alternate_risk(risks(s, train), rankers.distance_risk(registry(s), edges(s), known)), ["feature_id"], "flag_risk", "distance_risk", "alternate_composite")


_REACH = """, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), h AS (SELECT DISTINCT feature_id AS f, 0 AS k FROM sc WHERE is_leak UNION SELECT b.b, k + 1 FROM h JOIN b ON b.a = h.f WHERE k < 8),
    ds AS (SELECT r.feature_id, CAST(min(k) AS INT) AS distance, CAST(CASE min(k) WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE CASE WHEN min(k) IS NULL THEN 0.3 ELSE 0.1 END END AS DOUBLE) AS risk FROM registry r LEFT JOIN h ON h.f = r.feature_id GROUP BY 1)"""
add("d10_distance_risk", lambda s, d: rankers.distance_risk(registry(s), edges(s), bad(s, d)), _REACH + " SELECT * FROM ds")
add("d10_alternate_risk", lambda s, d: _alternate(s, d),
    _RISK + _REACH + """, al AS (SELECT rs.*, risk, CASE WHEN outcome_descendant AND post_event_table THEN 0.8 WHEN outcome_descendant THEN 0.9 WHEN post_event_table THEN 0.7 ELSE 0.5 END AS fr FROM rs JOIN ds USING (feature_id))
    SELECT feature_id, round(CAST(fr AS DOUBLE), 6) AS flag_risk, round(risk, 6) AS distance_risk, round(CAST(greatest(0, least(1, 0.4 * fr + 0.4 * risk + 0.2 * i * fr)) AS DOUBLE), 6) AS alternate_composite FROM al""")  # fmt: skip
flags = lambda df: df.select("dataset_id", "feature_id", "removed")
_TOP = "row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, position DESC)"
add("g1_keep_all", lambda s, d: flags(policies.keep_all(scores(s, d))), " SELECT dataset_id, feature_id, false AS removed FROM sc")
add("g2_oracle", lambda s, d: flags(policies.oracle(scores(s, d))), " SELECT dataset_id, feature_id, is_leak AS removed FROM sc")
add("g3_field_budget", lambda s, d: flags(policies.fields(scores(s, d), ["dataset_id"], 0.25)), f" SELECT dataset_id, feature_id, {_TOP} <= 2 AS removed FROM sc")
add("g4_group_budget", lambda s, d: flags(policies.groups(scores(s, d), ["dataset_id"], 0.3)),
    """, bs AS (SELECT dataset_id, group_id, max(score) AS b FROM sc WHERE group_id IS NOT NULL GROUP BY ALL),
    ch AS (SELECT dataset_id, group_id, row_number() OVER (PARTITION BY dataset_id ORDER BY b DESC, group_id DESC) <= greatest(1, ceil(0.3 * count(*) OVER (PARTITION BY dataset_id))) AS removed FROM bs)
    SELECT dataset_id, feature_id, coalesce(removed, false) AS removed FROM sc LEFT JOIN ch USING (dataset_id, group_id)""")  # fmt: skip
add("g5_threshold", lambda s, d: flags(policies.threshold(scores(s, d), 0.3)), " SELECT dataset_id, feature_id, score > 0.3 AS removed FROM sc")
add("g6_graph_cut", lambda s, d: flags(policies.graph_cut(cells(s, d), edges(s), 0.4)),
    """, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), h AS (SELECT a AS f, a AS c FROM b UNION SELECT b.b, h.c FROM h JOIN b ON b.a = h.f),
    cp AS (SELECT f AS feature_id, min(c) AS component FROM h GROUP BY f), bs AS (SELECT dataset_id, component, max(score) AS b, min(position) AS p FROM sc JOIN cp USING (feature_id) GROUP BY ALL),
    ch AS (SELECT dataset_id, component, row_number() OVER (PARTITION BY dataset_id ORDER BY b DESC, p) <= greatest(1, ceil(0.4 * count(*) OVER (PARTITION BY dataset_id))) AS removed FROM bs)
    SELECT dataset_id, feature_id, coalesce(removed, false) AS removed FROM sc LEFT JOIN cp USING (feature_id) LEFT JOIN ch USING (dataset_id, component)""")  # fmt: skip
_LATE = "(lifecycle IN ('post_outcome', 'future_window', 'repayment', 'closed') OR NOT available OR outcome_descendant OR post_event_table)"
add("g7_lifecycle", lambda s, d: flags(policies.lifecycle(scores(s, d), ["dataset_id"])), f" SELECT dataset_id, feature_id, {_LATE} AS removed FROM sc")
add("g7_lifecycle_budget", lambda s, d: flags(policies.lifecycle(scores(s, d), ["dataset_id"], 0.4)),
    f""" SELECT dataset_id, feature_id, row_number() OVER (PARTITION BY dataset_id ORDER BY {_LATE} DESC, score DESC, position DESC) <= 4 AS removed FROM sc""")
add("g8_random_removal", lambda s, d: flags(policies.random(scores(s, d), ["dataset_id"], 0.25, S)),
    f" SELECT dataset_id, feature_id, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('{S}|' || dataset_id || '|' || feature_id), feature_id) <= 2 AS removed FROM sc")
add("g9_audit_quarantine", lambda s, d: flags(policies.fields(scores(s, d), ["dataset_id"], 0.3, "ceil")), f" SELECT dataset_id, feature_id, {_TOP} <= 3 AS removed FROM sc")
_HASHED = "row_number() OVER (PARTITION BY dataset_id{by} ORDER BY md5({seed} || '|' || dataset_id || '|' || feature_id), feature_id)"
add("g9_audit_policies", lambda s, d: policies.audit(scores(s, d), ["dataset_id"], 0.3, S).select("dataset_id", "policy", "feature_id", "removed"),
    f""", rk AS (SELECT dataset_id, feature_id, is_leak, {_TOP} AS a, {_HASHED.format(by='', seed=f"'{S}'")} AS b, ceil(round(0.3 * count(*) OVER (PARTITION BY dataset_id), 9)) AS k FROM sc)
    SELECT dataset_id, policy, feature_id, CASE policy WHEN 'no_removal' THEN false WHEN 'auto_quarantine' THEN a <= k WHEN 'remove_all_oracle' THEN is_leak ELSE b <= k END AS removed
    FROM rk, (VALUES ('no_removal'), ('auto_quarantine'), ('remove_all_oracle'), ('random_matched')) p(policy)""")  # fmt: skip
add("g8_random_seeds", lambda s, d: _seeds(s, d),
    f""", sd AS (SELECT sc.*, seed FROM sc, range(1, 21) r(seed)), rk AS (SELECT *, {_HASHED.format(by=', seed', seed='seed')} <= 2 AS removed FROM sd),
    pr AS (SELECT dataset_id, seed, count(*) FILTER (removed) AS cost, count(*) FILTER (removed AND is_leak) / CAST(count(*) FILTER (is_leak) AS DOUBLE) AS recall FROM rk GROUP BY ALL)
    SELECT dataset_id, count(*) AS seeds, min(cost) AS least_cost, max(cost) AS most_cost, round(avg(recall), 6) AS recall, round(stddev_pop(recall), 6) AS recall_sd FROM pr GROUP BY 1""")  # fmt: skip


def _seeds(s, d):
    """Recall of removal at random over twenty seeds, all at the cost of g3."""
    n = policies.result(policies.random_seeds(scores(s, d), ["dataset_id"], 0.25, list(range(1, 21))), ["dataset_id", "seed"])
    out = n.groupBy("dataset_id").agg(F.count("*").alias("seeds"), F.min("review_units").alias("least_cost"), F.max("review_units").alias("most_cost"), F.avg("recall").alias("recall"), F.stddev_pop("recall").alias("recall_sd"))
    return rounded(out, ["dataset_id", "seeds", "least_cost", "most_cost"], "recall", "recall_sd")


_G3 = f", g3 AS (SELECT *, {_TOP} <= 2 AS removed FROM sc)"
add("g10_policy_result", lambda s, d: rounded(policies.result(policies.fields(scores(s, d), ["dataset_id"], 0.25), ["dataset_id"]), ["dataset_id", "kept", "quarantined", "review_units"], "recall", "false_quarantine_rate", "retention"),
    _G3 + """ SELECT dataset_id, string_agg(feature_id, ',' ORDER BY feature_id) FILTER (NOT removed) AS kept, string_agg(feature_id, ',' ORDER BY feature_id) FILTER (removed) AS quarantined, count(*) FILTER (removed) AS review_units,
    round(count(*) FILTER (removed AND is_leak) / CAST(2 AS DOUBLE), 6) AS recall, round(count(*) FILTER (removed AND NOT is_leak) / CAST(6 AS DOUBLE), 6) AS false_quarantine_rate,
    round(count(*) FILTER (NOT removed AND NOT is_leak) / CAST(6 AS DOUBLE), 6) AS retention FROM g3 GROUP BY dataset_id""")  # fmt: skip
add("g11_unique_budgets", lambda s, d: policies.unique_budgets(scores(s, d).groupBy("dataset_id").agg(F.count("*").alias("n_columns")), [0.05, 0.1, 0.2, 0.3]).select("dataset_id", "share", "k", "fitted_share"),
    """, ct AS (SELECT dataset_id, count(*) AS n FROM sc GROUP BY dataset_id), bg AS (SELECT dataset_id, share, CAST(greatest(1, round_even(share * n, 0)) AS INT) AS k FROM ct, (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.2), (0.3)) v(share))
    SELECT *, min(share) OVER (PARTITION BY dataset_id, k) AS fitted_share FROM bg""")  # fmt: skip
add("g12_semantic_groups", lambda s, d: policies.groups(scores(s, d), ["dataset_id"], 0.3, singles=True).groupBy("dataset_id", F.coalesce("group_id", "feature_id").alias("unit")).agg(F.count("*").alias("n_columns"), F.max("removed").alias("removed")),
    """, un AS (SELECT *, coalesce(group_id, feature_id) AS unit FROM sc), bs AS (SELECT dataset_id, unit, max(score) AS b, count(*) AS n_columns FROM un GROUP BY ALL)
    SELECT dataset_id, unit, n_columns, row_number() OVER (PARTITION BY dataset_id ORDER BY b DESC, unit DESC) <= ceil(0.3 * count(*) OVER (PARTITION BY dataset_id)) AS removed FROM bs""")  # fmt: skip
add("g13_selection_digest", lambda s, d: policies.digest(policies.fields(scores(s, d), ["dataset_id"], 0.25), ["dataset_id"], "field"),
    _G3 + " SELECT dataset_id, sha256('field|' || string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (removed)) AS digest FROM g3 GROUP BY dataset_id")


def reconstructed(s, d):
    """Cells whose digest of a repeated selection differs from the one recorded (here: of every cell with an even id, of another budget)."""
    again = policies.digest(policies.fields(scores(s, d), ["dataset_id"], 0.25), ["dataset_id"], "field")
    other = policies.digest(policies.fields(scores(s, d), ["dataset_id"], 0.5), ["dataset_id"], "field").withColumnRenamed("digest", "other")
    recorded = again.join(other, "dataset_id").select("dataset_id", F.when(F.col("dataset_id") % 2 == 0, F.col("other")).otherwise(F.col("digest")).alias("recorded"))
    return again.join(recorded, "dataset_id").where("digest <> recorded")


add("g14_reconstruction", reconstructed, f""", g5 AS (SELECT *, {_TOP} <= 2 AS a, {_TOP} <= 4 AS b FROM sc),
    dg AS (SELECT dataset_id, sha256('field|' || string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (a)) AS digest, sha256('field|' || string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (b)) AS recorded FROM g5 GROUP BY dataset_id)
    SELECT * FROM dg WHERE dataset_id % 2 = 0""")  # fmt: skip
add("e11_removal_metrics", lambda s, d: rounded(metrics.removal(policies.fields(scores(s, d), ["dataset_id"], 0.25), ["dataset_id"]), ["dataset_id", "n_removed", "residual_leaks"], "recall", "deletion_precision", "legitimate_retention"),
    _G3 + """ SELECT dataset_id, count(*) FILTER (removed) AS n_removed, 2 - count(*) FILTER (removed AND is_leak) AS residual_leaks, round(count(*) FILTER (removed AND is_leak) / CAST(2 AS DOUBLE), 6) AS recall,
    round(count(*) FILTER (removed AND is_leak) / CAST(2 AS DOUBLE), 6) AS deletion_precision, round(count(*) FILTER (NOT removed AND NOT is_leak) / CAST(6 AS DOUBLE), 6) AS legitimate_retention FROM g3 GROUP BY dataset_id""")  # fmt: skip
add("e13_group_removal", lambda s, d: policies.fields(scores(s, d), ["dataset_id"], 0.25).where("group_id IS NOT NULL").groupBy("dataset_id", "group_id").agg(F.sum(F.col("removed").cast("int")).alias("n_removed"), F.count("*").alias("n"))
    .withColumn("kind", F.when(F.col("n_removed") == 0, "none").when(F.col("n_removed") == F.col("n"), "full").otherwise("partial")),
    _G3 + """ SELECT dataset_id, group_id, count(*) FILTER (removed) AS n_removed, count(*) AS n, CASE WHEN count(*) FILTER (removed) = 0 THEN 'none' WHEN count(*) FILTER (removed) = count(*) THEN 'full' ELSE 'partial' END AS kind
    FROM g3 WHERE group_id IS NOT NULL GROUP BY dataset_id, group_id""")  # fmt: skip
_TRAIN = "(SELECT * FROM splitted WHERE split = 'train')"
add("f10_train_codes", lambda s, d: _train_codes(s, d), f""", t AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS code FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM {_TRAIN}))
    SELECT split, coalesce(CAST(code AS BIGINT), -2) AS code, count(*) AS n FROM splitted LEFT JOIN t ON day = strftime(ts, '%Y-%m-%d') GROUP BY ALL""")  # fmt: skip


def _train_codes(s, d):
    """Codes of shipping days by the days of train rows; later splits have days that no train row has. Rows by split and code."""
    days = order.time_split(panel(s, d)).select("split", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return columns.train_codes(days, "day").groupBy("split", F.col("day_code").cast("long").alias("code")).agg(F.count("*").alias("n"))


_OPEN = ["mean_price", "n_open", "last_price"]
_CUSTOMERS = """WITH o AS (SELECT o_custkey, avg(o_totalprice) AS mean_price, CAST(count(*) AS DOUBLE) AS n_open, max(o_totalprice) AS last_price FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
    c AS (SELECT c_custkey, mean_price, n_open, last_price, CASE WHEN c_custkey % 5 < 3 THEN 'train' ELSE 'test' END AS split FROM customer LEFT JOIN o ON o_custkey = c_custkey),
    m AS (SELECT coalesce(quantile_cont(mean_price, 0.5), 0) AS a, coalesce(quantile_cont(n_open, 0.5), 0) AS b, coalesce(quantile_cont(last_price, 0.5), 0) AS e FROM c WHERE split = 'train')"""
QUERIES["f11_train_median_imputation"] = lambda s, d: rounded(columns.imputed(_open_orders(s, d), _OPEN), ["c_custkey", "split"], *_OPEN)
ORACLE["f11_train_median_imputation"] = _CUSTOMERS + " SELECT c_custkey, split, round(coalesce(mean_price, a), 6) AS mean_price, round(coalesce(n_open, b), 6) AS n_open, round(coalesce(last_price, e), 6) AS last_price FROM c, m"


def _open_orders(s, d):
    """Customers with figures of their partly finished orders: null for those who have none."""
    o = read(s, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey"))
    o = o.agg(F.avg("o_totalprice").alias("mean_price"), F.count("*").cast("double").alias("n_open"), F.max("o_totalprice").alias("last_price"))
    c = read(s, d, "customer").select("c_custkey", F.when(F.pmod("c_custkey", F.lit(5)) < 3, "train").otherwise("test").alias("split"))
    return c.join(o, "c_custkey", "left")


add("f16_train_scaling", lambda s, d: _scaled(s, d), f""", t AS (SELECT avg(x_price) AS m, stddev_pop(x_price) AS v FROM {_TRAIN}) SELECT row_id, round((x_price - m) / v, 6) AS z FROM splitted, t""")


def _scaled(s, d):
    p = order.time_split(panel(s, d))
    fit = p.where("split = 'train'").agg(F.avg("x_price").alias("m"), F.stddev_pop("x_price").alias("v"))
    return p.crossJoin(F.broadcast(fit)).select("row_id", F.round((F.col("x_price") - F.col("m")) / F.col("v"), 6).alias("z"))


_TO_SCALE = [c for c in COLUMNS if c != "m10_copy"]


def _all_scaled(s, d):
    return rounded(columns.scaled(probed(s, d), _TO_SCALE), ["row_id", "split"], *_TO_SCALE)


add("f16_train_scaling_columns", _all_scaled, f", t AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _TO_SCALE)} FROM probed WHERE split = 'train') SELECT row_id, split, "
    + ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) AS {c}" for c in _TO_SCALE) + " FROM probed, t")


def flagship(s, d):
    """Which columns know the future, and would a correlation ranker find them?"""
    return QUERIES["e3_localization"](s, d)
