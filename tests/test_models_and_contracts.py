"""Learners by their directions, and contracts by what they refuse."""

import math

import pytest

from fieldaudit.operators import columns, contracts, models, rankers


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for i in range(600):
        u = ((i * 7919) % 1000) / 1000
        y = int(u + ((i * 104729) % 997) / 997 > 1)
        rows.append((f"r{i:04d}", ("train", "train", "train", "validation", "test")[i % 5], y, u, ((i * 31) % 101) / 101, y + ((i * 17) % 13) / 130))
    return spark.createDataFrame(rows, "row_id string, split string, y int, x double, noise double, leak double").cache()


@pytest.mark.parametrize("name", ["lr", "rf", "gbt", "mlp"])
def test_a_leak_inflates_every_learner(panel, name):
    got = models.paired_scores(panel, ["x", "noise"], ["leak"], name, []).first()
    assert got.clean_auc > 0.6 and got.full_auc > 0.95 and math.isclose(got.paired_harm, got.full_auc - got.clean_auc)


def test_rankers_put_the_leak_first(panel):
    for rank in (models.coefficient_rank, models.permutation_rank):
        score = {r.feature_id: r.score for r in rank(panel, ["x", "noise", "leak"]).collect()}
        assert max(score, key=score.get) == "leak" and len(score) == 3
    with pytest.raises(ValueError):
        models.learner("none", 1, 1)


def test_contracts_refuse(spark, panel):
    with pytest.raises(ValueError):
        contracts.without(panel, ["opened_at"])
    with pytest.raises(ValueError):
        columns.renamed(panel, {"x": "noise"})
    with pytest.raises(ValueError):
        columns.renamed(panel, {"absent": "z"})
    assert contracts.without(panel, ["leak"]).columns == ["row_id", "split", "y", "x", "noise"]
    got = contracts.strict_boolean(spark.createDataFrame([(x,) for x in ("TRUE", " false ", "0", "yes", "", None)], "w string"), "w").collect()
    assert [(r.parsed, r.valid) for r in got] == [(True, True), (False, True)] + [(None, False)] * 4
    numbers = spark.createDataFrame([(0,), (1,), (2,), (None,)], "w int")
    assert [(r.parsed, r.valid) for r in contracts.strict_boolean(numbers, "w").collect()] == [(False, True), (True, True), (None, False), (None, False)]
    assert contracts.strict_boolean(numbers.where("w < 2").selectExpr("w = 1 AS w"), "w", refuse=True).where("parsed").count() == 1
    with pytest.raises(ValueError):
        contracts.strict_boolean(numbers, "w", refuse=True)
    flags = spark.createDataFrame([(True, None), (None, None), (False, False)], "a boolean, b boolean")
    assert [r.y for r in contracts.any_flag(flags, ["a", "b"]).collect()] == [1, 0, 0]


def test_steps_to_known_bad_columns(spark):
    names = spark.createDataFrame([(c,) for c in "abcdef"], "feature_id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = {r.feature_id: r.risk for r in rankers.distance_risk(names, edges, names.where("feature_id = 'a'")).collect()}
    assert got == {"a": 0.9, "b": 0.6, "c": 0.3, "d": 0.1, "e": 0.3, "f": 0.3}


def test_null_times_come_last(spark):
    df = spark.createDataFrame([("2020-01-02", 1), (None, 0), ("2020-01-01", 5), ("2020-01-01", 2)], "ts string, row int").selectExpr("CAST(ts AS date) AS ts", "row")
    assert [r.row for r in contracts.ordered(df, "ts", ["row"]).orderBy("pos").collect()] == [2, 5, 1, 0]


def test_documents_policies_and_levels(spark):
    import json

    from pyspark.sql import functions as F

    from fieldaudit.operators import claims, ledger, policies, probes
    from fieldaudit.operators.ledger import GateError

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    docs = spark.createDataFrame([('{"b":1.50,"a":{"z":null,"y":[3,2]},"p":"/x/y"}',), ('{"p":5,"b":2}',), ("{}",), ("[1]",), ("{bad",), (None,)], "j string")
    got = [r.j for r in contracts.canonical_lineage(docs, "j", {"p": '<"P">'}).collect()]
    assert got == ['{"a":{"y":[3,2],"z":null},"b":1.5,"p":"<\\"P\\">"}', '{"b":2,"p":"<\\"P\\">"}', "{}", None, None, None]
    paths = spark.createDataFrame([("/home/u/a.csv",), ("C:\\data\\b.csv",), ("c.csv",), ("/x/..",), ("/x/",)], "p string")
    assert [r[0] for r in paths.select(contracts.public_path(F.lit("t"), F.col("p"))).collect()] == ["external_sources/t/a.csv", "external_sources/t/b.csv", "external_sources/t/c.csv", None, None]
    cells = spark.createDataFrame([("M", "b", 0.5, 0.1, 0.9), ("M", "a", 0.25, 0.2, 0.3), ("N", "a", 0.1, -0.1, 0.3)], "u string, m string, v double, lo double, hi double")
    told = {r.u: r for r in contracts.nested_document(cells, "u", "m", ["v", "lo", "hi"]).collect()}
    assert json.loads(told["M"].document) == {"a": {"v": 0.25, "lo": 0.2, "hi": 0.3}, "b": {"v": 0.5, "lo": 0.1, "hi": 0.9}} and told["M"].document.startswith('{"a"')
    assert told["M"].spread == 0.25 and told["M"].robust and not told["N"].robust
    with pytest.raises(GateError):
        contracts.same_features(cells, cells.drop("hi"), ["u"])
    contracts.same_features(cells, cells, ["u"])
    registry = spark.createDataFrame([(0, "a", False, None), (0, "b", False, None), (1, "a", True, "g"), (1, "b", None, "g")], "cell int, feature_id string, is_leak boolean, group_id string")
    edges = spark.createDataFrame([(1, "a", "b"), (0, "a", "z")], "cell int, src string, dst string")
    assert {(r.cell, r.policy) for r in policies.applicable(registry, ["cell"], edges).where("status = 'APPLICABLE'").collect()} == {(1, "oracle"), (1, "group_budget"), (1, "graph_cut")}
    assert policies.applicable(registry, ["cell"]).where("status = 'APPLICABLE'").count() == 2
    few = spark.createDataFrame([(f"r{i}", i % 2) for i in range(39)], "row_id string, y int")
    with pytest.raises(GateError):
        probes.source_assignment(few, 0.5, 1)
    scores = spark.createDataFrame([("x", "k", 1.0), ("y", "k", 3.0), ("y", "l", None)], "f string, g string, v double")
    left = {(r.scope, r.level): (r.n, r["mean"]) for r in ledger.leave_levels_out(scores, ["f", "g"], "v").collect()}
    assert left == {("f", "x"): (1, 3.0), ("f", "y"): (1, 1.0)}
    summary = spark.createDataFrame([("a", f"{e}.{f}", v) for e, v in (("strict_distance_reduction", 0.1), ("directional_repair", 0.1), ("leak_recall", 0.1), ("legitimate_retention", 0.0), ("overcorrection", 0.0), ("same_side_residual", -0.1)) for f in ("mean", "low", "high")], "g string, metric string, value double")
    gate = lambda df: [(r.g, r.status) for r in claims.decide(df, ["g"], claims.GATE, "MIXED").collect()]
    changed = lambda name, v: summary.withColumn("value", F.when(F.col("metric") == name, F.lit(v)).otherwise(F.col("value")))
    assert gate(summary) == [("a", "SEMANTICALLY_CORROBORATED")]
    assert gate(changed("same_side_residual.high", 0.0)) == [("a", "SCORE_RECOVERY_ONLY")] == gate(changed("overcorrection.mean", 0.1))
    assert gate(changed("strict_distance_reduction.low", -0.1)) == [("a", "MIXED")] == gate(summary.where("metric <> 'strict_distance_reduction.low'"))
    assert gate(summary.withColumn("value", -F.col("value"))) == [("a", "NEGATIVE")]


def test_missing_numbers_take_the_median_of_train_rows(spark):
    df = spark.createDataFrame([(1, "train", 1.0, None), (2, "train", 4.0, None), (3, "train", None, None), (4, "test", None, 7.0), (5, "test", float("nan"), None)], "id int, split string, a double, b double")
    assert [(r.a, r.b) for r in columns.imputed(df, ["a", "b"]).orderBy("id").collect()] == [(1, 0), (4, 0), (2.5, 0), (2.5, 7), (2.5, 0)]
    assert {(r.feature_id, r.median, r.n_missing) for r in columns.train_medians(df, ["a", "b"]).collect()} == {("a", 2.5, 1), ("b", 0.0, 3)}


def test_outer_draws_come_from_the_store(spark):
    from fieldaudit.operators import stats

    rows = [(d, s, k, float(10 * d + s)) for d in range(3) for s in range(2) for k in range(4) if (d, s, k) != (1, 1, 2)]
    store = spark.createDataFrame(rows, "d int, s int, k int, v double")
    got = stats.outer_bootstrap(store, "d", "s", "k", "v", [], 200, 5).collect()
    assert len(got) == 200 and all(0 <= r.stat <= 21 for r in got) and abs(sum(r.stat for r in got) / 200 - 10.5) < 1.5
    assert sorted(r.stat for r in got) == sorted(r.stat for r in stats.outer_bootstrap(store.repartition(3), "d", "s", "k", "v", [], 200, 5).collect())
