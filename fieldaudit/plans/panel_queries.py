"""Queries on the panel: order, splits, samples and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.operators import neighbours, order, probes
from fieldaudit.plans.tables import FEATURES, PANEL, melted, melted_sql, normal_sql, panel, u_sql

S = 7  # seed
_r = lambda df, *cols: df.select("row_id", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in cols))
_hash = lambda s, d="": f"md5('{s}|' || row_id)"
_noise = lambda name, std=probes.NOISE: f"CAST({std} AS DOUBLE) * {normal_sql(S, name)}"

QUERIES, ORACLE = {}, {}


def add(name, run, sql):
    QUERIES[name], ORACLE[name] = run, PANEL + "\n" + sql


add("t0_position", lambda s, d: order.by_time(panel(s, d), {"c": F.col("y").cast("long")}).select("row_id", F.col("pos").cast("long").alias("pos"), "c"),
    "SELECT row_id, pos, CAST(c AS BIGINT) AS c FROM placed")
add("t1_time_split", lambda s, d: order.time_split(panel(s, d)).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.countDistinct("entity_id").alias("entities")),
    "SELECT split, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, count(DISTINCT entity_id) AS entities FROM splitted GROUP BY split")
add("t2_random_split", lambda s, d: order.random_split(panel(s, d), S).select("row_id", "split"),
    f"""SELECT row_id, CASE WHEN p <= floor(n * 0.6) THEN 'train' WHEN p <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {_hash(S)}, row_id) AS p FROM placed)""")  # fmt: skip
add("t3_systematic_sample", lambda s, d: order.systematic_sample(panel(s, d), 500).select("row_id", "y"),
    "SELECT row_id, y FROM placed WHERE pos - 1 IN (SELECT CAST(floor(i * (n - 1) / CAST(499 AS DOUBLE)) AS BIGINT) FROM stats, range(500) t(i))")
add("t4_class_cap", lambda s, d: order.class_cap(panel(s, d), 5000, S).select("row_id", "y"),
    f"""SELECT row_id, y FROM (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {_hash(S)}, row_id) AS k, count(*) OVER (PARTITION BY y) AS c, n FROM placed)
    WHERE k <= CASE WHEN n <= 5000 THEN c ELSE greatest(1, floor(c * 5000 / CAST(n AS DOUBLE))) END""")  # fmt: skip
add("t5_nested_fractions", lambda s, d: order.nested_fractions(panel(s, d), [0.25, 0.5, 0.75, 1.0], S).groupBy("fraction").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.max("row_id").alias("last_row")),
    f"""SELECT fraction, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, max(row_id) AS last_row
    FROM (SELECT *, row_number() OVER (ORDER BY {_hash(S)}, row_id) AS k FROM placed), (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75), (1.0)) f(fraction)
    WHERE k <= greatest(4, floor(fraction * n)) GROUP BY fraction""")  # fmt: skip
add("t6_permuted_columns", lambda s, d: order.permuted(order.time_split(panel(s, d)).select("row_id", "split", "x_quantity").checkpoint(), ["x_quantity"], S).select("row_id", "x_quantity"),
    f"""SELECT a.row_id, b.x_quantity FROM (SELECT row_id, split, row_number() OVER (PARTITION BY split ORDER BY md5('{S}a|' || row_id), row_id) AS k FROM splitted) a
    JOIN (SELECT x_quantity, split, row_number() OVER (PARTITION BY split ORDER BY md5('{S}b|' || row_id), row_id) AS k FROM splitted) b ON a.split = b.split AND a.k = b.k""")  # fmt: skip


def _means(s, d):
    return melted(panel(s, d), FEATURES, ["dataset_id"]).groupBy("dataset_id", "feature_id", "position").agg(F.round(F.avg("value"), 6).alias("score"))


_MEANS = f"m AS (SELECT dataset_id, feature_id, position, round(avg(value), 6) AS score FROM ({melted_sql('panel', FEATURES, 'dataset_id')}) GROUP BY ALL)"
add("t8_top_k", lambda s, d: order.top_k(_means(s, d), ["dataset_id"], "score", 3).select("dataset_id", "feature_id", "score", "rank"),
    f""", {_MEANS} SELECT dataset_id, feature_id, score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, position DESC) AS k FROM m) WHERE k <= 3""")
add("t9_random_k", lambda s, d: order.random_k(_means(s, d), ["dataset_id"], "feature_id", 2, S).select("dataset_id", "feature_id", "rank"),
    f""", {_MEANS} SELECT dataset_id, feature_id, CAST(k AS INT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('{S}|' || dataset_id || '|' || feature_id), feature_id) AS k FROM m) WHERE k <= 2""")  # fmt: skip
add("m0_loo_prior", lambda s, d: _r(probes.loo_prior(panel(s, d)), "prior"), "SELECT row_id, round(prior, 6) AS prior FROM placed")
add("m1_label_copy", lambda s, d: _r(probes.label_copy(panel(s, d), 0.8, S), "m01"),
    f"""SELECT row_id, CAST(CASE WHEN {u_sql(f"'{S}|M01|' || row_id")} < 0.5 * (1 - 0.8) THEN 1 - y ELSE y END AS DOUBLE) AS m01 FROM placed""")
add("m2_noisy_proxy", lambda s, d: _r(probes.noisy_proxy(panel(s, d), 0.8, S), "m02"), f"SELECT row_id, round(0.8 * (y - prior) + {_noise('m02')}, 6) AS m02 FROM placed")
add("m3_interaction", lambda s, d: _r(probes.interaction(panel(s, d), 0.8, S, "x_quantity"), "m03"),
    f"SELECT row_id, round(0.8 * (2 * y - 1) * CASE WHEN x_quantity >= (SELECT quantile_cont(x_quantity, 0.5) FROM panel) THEN 1 ELSE -1 END + {_noise('m03')}, 6) AS m03 FROM placed")

_FUTURE = """, ends AS (SELECT ts, max(pos) AS last FROM placed GROUP BY ts),
w AS (SELECT ts, least(last + {skip}, n) AS a, least(n, least(last + {skip}, n) + {width}) AS b FROM ends, stats),
f AS (SELECT w.ts, w.b - w.a AS k, CASE WHEN w.b > w.a THEN (y.c - coalesce(x.c, 0)) / CAST(w.b - w.a AS DOUBLE) END AS f FROM w LEFT JOIN placed x ON x.pos = w.a LEFT JOIN placed y ON y.pos = w.b)"""
_PLAIN = {"skip": "0", "width": "greatest(2, CAST(floor(n * 0.05) AS BIGINT))"}
_AHEAD = {"skip": "greatest(0, greatest(1, CAST(floor(n * 0.05) AS BIGINT)) - 1)", "width": "greatest(2, CAST(floor(n * 0.05) AS BIGINT))"}
for _name, _ahead, _prior in (("m4_future_mean", False, None), ("m5_ahead_mean", True, None), ("m4c_future_mean_constant", False, 0.5), ("m5c_ahead_mean_constant", True, 0.5)):
    _c = _name.split("_")[0]
    _p = "prior" if _prior is None else "CAST(0.5 AS DOUBLE)"
    add(_name, lambda s, d, c=_c, a=_ahead, p=_prior: _r(probes.future_mean(panel(s, d), 0.8, S, c, ahead=a, prior=p), c, f"{c}_count"),
        _FUTURE.format(**(_AHEAD if _ahead else _PLAIN)) + f" SELECT row_id, round({_p} + 0.8 * (coalesce(f, {_p}) - {_p}) + {_noise(_c)}, 6) AS {_c}, CAST(k AS DOUBLE) AS {_c}_count FROM placed JOIN f USING (ts)")

_ENTITY = """, e AS (SELECT *, count(*) OVER (PARTITION BY entity_id) - count(*) OVER w AS k, sum(y) OVER (PARTITION BY entity_id) - sum(y) OVER w AS later FROM placed
  WINDOW w AS (PARTITION BY entity_id ORDER BY ts RANGE UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN k > 0 THEN (later + 2 * {p}) / CAST(k + 2 AS DOUBLE) ELSE {p} END AS rate FROM e)"""
for _c, _name, _prior in (("m08", "m8_future_entity_rate", None), ("m08c", "m8c_future_entity_rate_constant", 0.5)):
    _p = "prior" if _prior is None else "CAST(0.5 AS DOUBLE)"
    add(_name, lambda s, d, c=_c, p=_prior: _r(probes.future_entity_rate(panel(s, d), 0.8, S, c, prior=p), c, f"{c}_rate", f"{c}_count"),
        _ENTITY.format(p=_p) + f" SELECT row_id, round({_p} + 0.8 * (rate - {_p}) + {_noise(_c)}, 6) AS {_c}, round(rate, 6) AS {_c}_rate, CAST(k AS DOUBLE) AS {_c}_count FROM g")
add("m6_redundant", lambda s, d: _r(probes.redundant(panel(s, d), 0.8, S), "m06_0", "m06_1", "m06_2"),
    "SELECT row_id, " + ", ".join(f"round(0.8 * (y - prior) + {_noise(f'm06_{i}', probes.NOISE * (1 + i / 3))}, 6) AS m06_{i}" for i in range(3)) + " FROM placed")
add("m7_subgroup", lambda s, d: _r(probes.subgroup(panel(s, d), 0.8, S), "m07"),
    f"""SELECT row_id, round(CASE WHEN {u_sql(f"'{S}|M07|' || row_id")} < 0.3 THEN 0.8 * (y - prior) + {_noise('m07')} ELSE 0 END, 6) AS m07 FROM placed""")
add("m9_source_assignment", lambda s, d: probes.source_assignment(panel(s, d), 0.8, S).select("row_id", "m09_source", *(f"m09_{i}" for i in range(4))), "")
_odds = {y: [__import__("math").exp((3 if y else -3) * 0.8 * (-1 + 2 * i / 3)) for i in range(4)] for y in (0, 1)}
_order = sorted(range(4), key=lambda i: (i * 7 + S * 3) % 5)
_draw = lambda y: "CASE " + " ".join(f"WHEN u < CAST({sum(_odds[y][: i + 1]) / sum(_odds[y])!r} AS DOUBLE) THEN {i}" for i in range(3)) + " ELSE 3 END"
ORACLE["m9_source_assignment"] = PANEL + f""",
r AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{S}M09|' || row_id), row_id) AS k, {u_sql(f"'{S}|M09u|' || row_id")} AS u FROM panel),
a AS (SELECT row_id, {[_order.index(i) for i in range(4)]}[CAST(CASE WHEN k <= 20 THEN (k - 1) % 4 WHEN y = 1 THEN {_draw(1)} ELSE {_draw(0)} END AS INT) + 1] AS m09_source FROM r)
SELECT row_id, CAST(m09_source AS INT) AS m09_source, """ + ", ".join(f"CAST(m09_source = {i} AS INT) AS m09_{i}" for i in range(4)) + " FROM a"  # fmt: skip
add("m10_mixed_group", lambda s, d: _r(probes.mixed_group(panel(s, d), 0.8, S, "x_quantity"), "m10_copy", "m10"),
    f"SELECT row_id, round(x_quantity, 6) AS m10_copy, round(0.8 * (y - prior) + {_noise('m10')}, 6) AS m10 FROM placed")
_weight = probes.projection_weights(S, 3)
add("m11_projections", lambda s, d: _r(probes.projections(panel(s, d), 0.8, S), "m11_0", "m11_1", "m11_2"),
    "SELECT row_id, " + ", ".join(f"round(CAST({0.8 * w!r} AS DOUBLE) * (y - prior) + {_noise(f'm11_{i}')}, 6) AS m11_{i}" for i, w in enumerate(_weight)) + " FROM placed")
add("m12_composed", lambda s, d: _r(probes.compose(panel(s, d), lambda p: probes.noisy_proxy(p, 0.8, S), lambda p: probes.mixed_group(p, 0.5, S, "x_tax")), "m02", "m10_copy", "m10"),
    f"SELECT row_id, round(0.8 * (y - prior) + {_noise('m02')}, 6) AS m02, round(x_tax, 6) AS m10_copy, round(0.5 * (y - prior) + {_noise('m10')}, 6) AS m10 FROM placed")


def _next_time(s, d):
    """For each time of each dataset the next strictly later one and how many rows come after: what a look-up by time may not go beyond."""
    from pyspark.sql import Window

    times = panel(s, d).groupBy("dataset_id", "ts").agg(F.count("*").alias("n_rows"))
    w = Window.partitionBy("dataset_id").orderBy("ts")
    later = F.coalesce(F.sum("n_rows").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return times.select("dataset_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(F.lead("ts").over(w), "yyyy-MM-dd").alias("next_day"), later.alias("rows_after"))


add("j13_next_strict_future", _next_time, """, t AS (SELECT dataset_id, ts, count(*) AS n FROM panel GROUP BY ALL)
    SELECT dataset_id, strftime(ts, '%Y-%m-%d') AS day, strftime(lead(ts) OVER w, '%Y-%m-%d') AS next_day, CAST(coalesce(sum(n) OVER (PARTITION BY dataset_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS rows_after
    FROM t WINDOW w AS (PARTITION BY dataset_id ORDER BY ts)""")  # fmt: skip


def _orders(s, d):
    from fieldaudit.operators import columns
    from fieldaudit.plans.tables import read

    o = read(s, d, "orders")
    day = columns.day_difference(F.lit("2000-01-01 12:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return o.select(
        "o_orderkey", columns.binary_label(F.col("o_orderstatus"), ["f"], ["o"]).alias("y"), day.alias("days_before"), columns.number_or(F.substring("o_orderpriority", 1, 1)).alias("priority"),
        F.date_format(columns.tolerant_date(F.date_format("o_orderdate", "MMM-yyyy"), "yyyy-MM-dd", "MMM-yyyy"), "yyyy-MM-dd").alias("month"),
        columns.opaque_id(F.col("o_orderkey").cast("string")).alias("opaque"),
    )


add("f5_order_labels", _orders, """SELECT o_orderkey, CASE lower(trim(o_orderstatus)) WHEN 'f' THEN 1 WHEN 'o' THEN 0 END AS y,
    CAST(floor((epoch_us(TIMESTAMP '2000-01-01 12:00:00') - epoch_us(o_orderdate)) / CAST(86400000000 AS DOUBLE)) AS INT) AS days_before, coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), -1) AS priority,
    strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, 'fid_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS opaque FROM orders""")  # fmt: skip


def _codes(s, d):
    """Codes of event types over the whole table by their sorted order, and rows of each: distinct values are numbered, not rows."""
    from pyspark.sql import Window

    from fieldaudit.plans.tables import read

    e = read(s, d, "events")
    code = e.select("event_type").where("event_type IS NOT NULL").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("event_type")) - 1)
    return e.join(F.broadcast(code), "event_type", "left").groupBy(F.coalesce("code", F.lit(-1)).alias("code")).agg(F.count("*").alias("n"), F.min("event_type").alias("event_type"))


add("f9_whole_table_codes", _codes, "SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS code, n, event_type FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
add("s12_table_digest", lambda s, d: __import__("fieldaudit.operators.ledger", fromlist=["table_digest"]).table_digest(panel(s, d), ["dataset_id"], ["row_id", "entity_id", "source_id", "y"]),
    """SELECT dataset_id, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', row_id, entity_id, source_id, y)), 1, 10) AS BIGINT)) AS BIGINT) AS digest FROM panel GROUP BY 1""")  # fmt: skip


def _vectors(s, d):
    from fieldaudit.plans.tables import read

    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def _vote(s, d):
    """For each vector of an id divisible by 10, the vote of its five nearest of the others for its own label."""
    e = _vectors(s, d)
    near = neighbours.nearest(e.where("id % 10 = 0"), e, 5)
    return neighbours.votes(near, e, F.col("q_label")).select("q_id", F.round("vote", 6).alias("vote"))


def _purity(s, d):
    """How often the nearest vector, and the five nearest, have the label of a vector: over all vectors."""
    e = _vectors(s, d)
    return neighbours.purity(neighbours.nearest(e, e, 5), e, [1, 5]).select(F.round("purity_1", 6).alias("purity_1"), F.round("purity_5", 6).alias("purity_5"))


_KNN = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS q_id, q.label AS q_label, e.vec_id, e.label,
    round(list_sum(list_transform(range(1, len(e.v) + 1), lambda i: (e.v[i] - q.v[i]) * (e.v[i] - q.v[i]))), 9) AS dist FROM e q JOIN e ON {which} AND e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS rank FROM p QUALIFY rank <= 5)"""
QUERIES["j11_neighbour_join"], QUERIES["j12_neighbour_purity"] = _vote, _purity
ORACLE["j11_neighbour_join"] = _KNN.format(which="q.vec_id % 10 = 0") + " SELECT q_id, round(sum(CAST(label = q_label AS INT) / (sqrt(dist) + 1e-9)) / sum(1 / (sqrt(dist) + 1e-9)), 6) AS vote FROM r GROUP BY q_id"
ORACLE["j12_neighbour_purity"] = _KNN.format(which="true") + " SELECT round(avg(CAST(label = q_label AS INT)) FILTER (rank = 1), 6) AS purity_1, round(avg(CAST(label = q_label AS INT)), 6) AS purity_5 FROM r"
