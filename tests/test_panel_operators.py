"""Probes, order, metrics and policies on small tables with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import columns, ledger, metrics, order, policies, probes, rankers, stats

DAY = datetime.datetime(2024, 1, 1)


def panel(spark, rows):
    """rows: (entity, day, y)."""
    data = [(f"r{i:03d}", e, DAY + datetime.timedelta(days=t), y) for i, (e, t, y) in enumerate(rows)]
    return spark.createDataFrame(data, "row_id string, entity_id long, ts timestamp_ntz, y int").repartition(3)


def test_future_entity_rate_by_hand(spark):
    p = panel(spark, [(7, 0, 0), (7, 1, 1), (7, 2, 1), (8, 0, 0), (8, 1, 0), (8, 2, 1)])
    got = {(r.entity_id, r.ts): r for r in probes.future_entity_rate(p, 1.0, 1, "m", prior=0.5, std=0.0).collect()}
    assert got[7, DAY].m == pytest.approx(0.75) and got[7, DAY].m_count == 2
    assert got[7, DAY + datetime.timedelta(days=2)].m == 0.5 and got[7, DAY + datetime.timedelta(days=2)].m_count == 0
    flat = probes.future_entity_rate(p, 0.0, 1, "m", prior=0.5, std=0.0)
    assert {r.m for r in flat.collect()} == {0.5}


def test_own_and_same_time_labels_never_count(spark):
    rows = [(1, t, t % 2) for t in (0, 0, 1, 2, 3, 4, 5, 6)]
    flipped = [(e, t, 1 - y if i == 1 else y) for i, (e, t, y) in enumerate(rows)]
    of = lambda r: {x.row_id: (x.m, x.k) for x in probes.future_mean(panel(spark, r), 1.0, 1, "m", share=0.4, prior=0.5).withColumnRenamed("m_count", "k").collect()}
    a, b = of(rows), of(flipped)
    assert a["r000"] == b["r000"] and a["r001"] == b["r001"]


def test_empty_future_leaves_the_prior(spark):
    got = {r.row_id: r for r in probes.future_window(panel(spark, [(1, t, y) for t, y in enumerate((0, 1, 1, 0))]), F.lit(1), F.lit(2), "f", "k").collect()}
    assert got["r003"].f is None and got["r003"].k == 0 and got["r000"].f == 1.0 and got["r001"].f == 0.5


def test_positions_do_not_depend_on_partitions(spark):
    p = panel(spark, [(i % 3, i // 4, i % 2) for i in range(60)])
    one = {r.row_id: (r.pos, r.c) for r in order.by_time(p.coalesce(1), {"c": F.col("y")}).collect()}
    many = {r.row_id: (r.pos, r.c) for r in order.by_time(p.repartition(7), {"c": F.col("y")}).collect()}
    assert one == many and sorted(x[0] for x in one.values()) == list(range(1, 61))
    ordered = sorted(one, key=lambda r: one[r][0])
    assert ordered == sorted(ordered)
    assert order.time_split(p).groupBy("split").count().where("split = 'train'").first()["count"] == 36


def test_no_window_without_partition_over_rows(spark):
    plan = order.by_time(panel(spark, [(1, 0, 1)]), {"c": F.col("y")})._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in plan.split("\n") if "SinglePartition" in x]
    assert len(rows) <= 1  # the totals of the buckets, one row each


def test_auroc_and_average_precision(spark):
    rows = [("a", s, y, i) for i, (s, y) in enumerate([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)])] + [("b", 0.3, 1, 0)]
    df = spark.createDataFrame(rows, "cell string, score double, y int, position int")
    got = {r.cell: r.auroc for r in metrics.auroc(df, ["cell"], "score").collect()}
    assert got["a"] == pytest.approx((1 + 2 + 1.5) / 6) and got["b"] is None
    ap = {r.cell: r for r in metrics.average_precision(df, ["cell"], "score", "y").collect()}
    assert ap["a"].ap == pytest.approx((1 / 1 + 2 / 3 + 3 / 4) / 3)
    weighted = metrics.auroc(df.where("cell = 'a'").withColumn("w", F.lit(2.0)), ["cell"], "score", weight="w").first()
    assert weighted.auroc == pytest.approx(got["a"])


def test_repair_cases(spark):
    rows = [("A", 0.70, 0.80, 0.72), ("B", 0.70, 0.80, 0.68), ("C", 0.70, 0.70, 0.65), ("D", 0.80, 0.70, 0.76)]
    got = {r.case: r for r in metrics.directional_repair(spark.createDataFrame(rows, "case string, s double, f double, g double"), "s", "f", "g").collect()}
    assert got["A"].same_side_residual == pytest.approx(0.02) and got["A"].directional_repair == pytest.approx(0.08)
    assert got["B"].overcorrection == pytest.approx(0.02) and got["B"].directional_repair == pytest.approx(0.10)
    assert got["C"].introduced_distortion == pytest.approx(0.05) and got["C"].directional_repair_fraction is None
    assert got["D"].same_side_residual == pytest.approx(0.04) and got["D"].directional_repair == pytest.approx(0.06)


def removed(df):
    return {r.feature_id for r in df.where("removed").collect()}


def test_policies(spark):
    rows = [(0, f, i, s, g, life, True, False, late) for i, (f, s, g, life, late) in enumerate([("a", 0.9, "g", "prediction_time", False), ("b", 0.8, "g", "pre_outcome", False), ("c", 0.7, "g", "post_outcome", False), ("d", 0.1, None, "prediction_time", True)])]
    df = spark.createDataFrame(rows, "cell int, feature_id string, position int, score double, group_id string, lifecycle string, available boolean, outcome_descendant boolean, post_event_table boolean")
    assert removed(policies.fields(df, ["cell"], 0.25)) == {"a"} and removed(policies.groups(df, ["cell"], 0.5)) == {"a", "b", "c"}
    assert removed(policies.lifecycle(df, ["cell"])) == {"c", "d"} and removed(policies.groups(df, ["cell"], 1.0)) == {"a", "b", "c"} and removed(policies.fields(df, ["cell"], 0.0)) == set()
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert removed(policies.graph_cut(df, edges, 1.0)) == {"a", "b", "c"} and removed(policies.graph_cut(df, edges.limit(0), 0.5)) == set()
    assert len(removed(policies.random(df, ["cell"], 0.5, 3))) == 2
    a, b = (policies.digest(df.withColumn("removed", F.col("position").isin(1, 3)).orderBy(F.col("position").desc() if d else "position"), ["cell"], u).first().digest for d, u in ((0, "field"), (1, "field")))
    assert a == b != policies.digest(df.withColumn("removed", F.col("position").isin(1, 3)), ["cell"], "group").first().digest


def test_rankers_find_a_copy_of_the_label(spark):
    rows = [(f"r{i}", i % 2, float((i * 37) % 101), float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id string, y int, noise double, copy double")
    long = df.select("y", F.explode(F.array(F.struct(F.lit("noise").alias("feature_id"), F.col("noise").alias("value")), F.struct(F.lit("copy").alias("feature_id"), F.col("copy").alias("value")))).alias("f")).select("y", "f.*")
    for scores, name in ((rankers.mutual_information(long, ["feature_id"]), "mi"), (rankers.correlation(long, ["feature_id"]), "corr")):
        got = {r.feature_id: r[name] for r in scores.collect()}
        assert got["copy"] > 0.5 > 0.2 > got["noise"]


def test_sign_flip_and_holm(spark):
    rows = [("one", 1.0), ("one", 1.0), ("two", 1.0), ("two", -1.0)] + [("ten", 1.0)] * 10
    got = {r.g: r.p for r in stats.exact_sign_flip(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {"one": 0.5, "two": 1.0, "ten": 2 / 2**10}
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.p_holm, 9) for r in stats.holm(p, "p").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_gates_and_joins(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, x double"), spark.createDataFrame([(1, 5.0), (3, 6.0)], "k int, z double")
    with pytest.raises(ledger.GateError):
        ledger.one_to_one(a, b, ["k"])
    with pytest.raises(ledger.GateError):
        ledger.one_to_one(a.union(a), a.withColumnRenamed("x", "z"), ["k"])
    assert ledger.one_to_one(a, a.withColumnRenamed("x", "z"), ["k"]).count() == 2
    assert {(r.k, r.side) for r in ledger.missing_keys(a, b, ["k"]).collect()} == {(2, "left"), (3, "right")}
    digest = lambda d: ledger.table_digest(d.withColumn("g", F.lit(0)), ["g"], ["k", "x"]).first().digest
    assert digest(a.repartition(4)) == digest(a.orderBy(F.col("k").desc()))


def test_column_preparation(spark):
    df = spark.createDataFrame([("train", 0), ("train", 2), ("train", 0), ("validation", 1), ("test", 2), ("test", None)], "split string, v int")
    got = sorted((r.split, r.v_code) for r in columns.train_codes(df, "v").collect())
    assert got == [("test", -1), ("test", 1), ("train", 0), ("train", 0), ("train", 1), ("validation", -2)]
    text = spark.createDataFrame([(" Yes ",), ("no",), ("?",), (None,)], "t string")
    assert [r.y for r in text.select(columns.binary_label(F.col("t"), ["yes"], ["no"]).alias("y")).collect()] == [1, 0, None, None]
    assert [r.x for r in text.select(columns.number_or(F.col("t")).alias("x")).collect()] == [-1.0] * 4
    with pytest.raises(ledger.GateError):
        columns.factor_filter(df, "split", ["other"], ["train", "test"])
    names = spark.createDataFrame([("a_x", True), ("b", True)], "feature_id string, available boolean")
    assert columns.regime(names, "O0").count() == 2 and set(columns.regime(names, "O1").columns) == {"shown_id", "feature_id"}


def test_halved_sign_flip_is_exact_and_whole_queries_read_every_dataset(spark):
    import itertools
    import random

    from fieldaudit import plans
    from fieldaudit.operators import stats

    r = random.Random(3)
    groups = {f"g{n}": [round(r.uniform(-1, 2), 9) for _ in range(n)] for n in (1, 2, 5, 11)} | {"none": [0.0, 0.0]}
    got = {x.g: x for x in stats.halved_sign_flip(spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double"), ["g"], "v").collect()}
    for g, v in groups.items():
        far = [abs(sum(s * x for s, x in zip(signs, v))) >= abs(sum(v)) - 1e-12 for signs in itertools.product((-1, 1), repeat=len(v))]
        assert got[g].n == len(v) and abs(got[g].p - sum(far) / len(far)) < 1e-12
    sf = "/root/testdata/sf0.01"
    datasets = plans.stats_queries.led(spark, sf).select("dataset_id").distinct().count()
    assert datasets > 12 and {x.n for x in plans.QUERIES["b9_exact_sign_flip"](spark, sf).collect()} == {datasets}
    assert plans.QUERIES["b28_case_studies"](spark, sf).count() and plans.QUERIES["b6_category_contrasts"](spark, sf).count() == 3
    rows = [(r.randrange(4), e, r.randrange(2), r.randrange(6), r.randrange(4)) for e in range(30) for _ in range(6)]
    p = spark.createDataFrame(rows, "dataset_id int, entity_id long, y int, x_quantity int, x_discount int")
    weights = plans.stats_queries.entity_weights(p, 5)
    w = {(x.rep, x.entity_id): x.w for x in weights.collect()}
    assert all(sum(v for (k, _), v in w.items() if k == rep) == 30 for rep in range(5))
    want = {}
    for d, rep in itertools.product(range(4), range(5)):
        area = []
        for c in (3, 4):
            pos, neg = ([(x[c], w.get((rep, x[1]), 0)) for x in rows if x[0] == d and x[2] == y] for y in (1, 0))
            won = sum(u * v * ((a > b) + (a == b) / 2) for a, u in pos for b, v in neg)
            area.append(won / (sum(u for _, u in pos) * sum(v for _, v in neg)))
        want[d, rep] = area[0] - area[1]
    got = {(x.dataset_id, x.rep): x.effect for x in plans.stats_queries.auc_effects(p, weights).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_of_neighbours_match_all_pairs(spark):
    import numpy as np

    from fieldaudit.operators import neighbours

    rng = np.random.default_rng(4)
    v = rng.integers(0, 4, (120, 5)).astype(float)  # many equal distances
    rows = [(i, [float(x) for x in v[i]], int(i % 3)) for i in range(120)] + [(500, None, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    near = neighbours.nearest(df.where("id % 4 = 0"), df, 7, queries_a_block=9, points_a_block=17)
    want = {(q, i, k + 1) for q in range(0, 120, 4) for k, i in enumerate(sorted((j for j in range(120) if j != q), key=lambda j: (((v[q] - v[j]) ** 2).sum(), j))[:7])}
    assert {(r.q_id, r.id, r.rank) for r in near.collect()} == want
    few = neighbours.nearest(df.where("id < 2"), df.where("id < 3"), 7)
    assert sorted((r.q_id, r.id) for r in few.collect()) == [(0, 1), (0, 2), (1, 0), (1, 2)] or few.count() == 4
    told = neighbours.purity(near, df, [1, 7]).first()
    assert told.purity_7 == pytest.approx(np.mean([i % 3 == q % 3 for q, i, _ in want]))


def test_blocks_of_neighbours_meet_in_shuffles_of_many_partitions(spark):
    """small shuffles are read as one partition, where any two sides of a group meet; larger ones aren't."""
    from fieldaudit.operators import neighbours

    rows = [(i, [float(i * i % 97), float(i)]) for i in range(200)]
    df, key = spark.createDataFrame(rows, "id long, v array<double>"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        near = {(r.q_id, r.id, r["rank"]) for r in neighbours.nearest(df, df, 3, queries_a_block=30, points_a_block=70).collect()}
    finally:
        spark.conf.set(key, before)
    dist = lambda q, j: sum((a - b) ** 2 for a, b in zip(rows[q][1], rows[j][1]))
    assert near == {(q, i, k + 1) for q in range(200) for k, i in enumerate(sorted((j for j in range(200) if j != q), key=lambda j: (dist(q, j), j))[:3])}
