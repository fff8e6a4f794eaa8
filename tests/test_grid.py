"""The evaluation grid against scores made row by row in Python, and the flags of false repairs against hand-made cells."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fieldaudit.functions import draws
from fieldaudit.operators import grid, models, order, probes, rankers, stats
from fieldaudit.operators.ledger import GateError

BASE, CELLS = ["a", "b"], [grid.Cell("M01", "S2", ["p"], ["p"]), grid.Cell("M09", "S2", ["q0", "q1"], ["q0", "q1"], "M09")]
ALL = ["a", "b", "p", "q0", "q1"]


def area(pairs):
    won = [1.0 if x > z else 0.5 if x == z else 0.0 for (x, y), (z, u) in itertools.product(pairs, pairs) if y == 1 and u == 0]
    return sum(won) / len(won) if won else None


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(3)
    rows = []
    for i in range(240):
        y = draw.randrange(2) if i % 3 else 1  # dataset 0 has one class only
        rows.append((i % 3, "train" if i < 120 else "test", y, float(draw.randrange(5)), 7.0, y + draw.randrange(3) / 2, float(draw.randrange(2)), draw.random()))
    df = spark.createDataFrame(rows, "dataset_id int, split string, y int, a double, b double, p double, q0 double, q1 double")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature_id"), F.col(c).alias("value")) for c in ALL)))
    long = df.where("split = 'train'").select("dataset_id", "y", each.alias("f")).select("dataset_id", "y", "f.*")
    columns = grid.fitted(long).join(grid.registry(spark, BASE, CELLS), "feature_id").checkpoint()
    chosen = grid.selections(columns, 0.25, [1, 2], len(BASE)).checkpoint()
    return rows, columns, chosen, grid.areas(df.where("split = 'test'"), chosen, BASE, CELLS).checkpoint()


def test_areas_equal_row_by_row_scores(made):
    rows, _, chosen, auc = made
    weight: dict = {}
    for r in chosen.collect():
        weight.setdefault((r.dataset_id, r.cell, r.run), {})[r.feature_id] = 0 if r.removed else r.weight
    got = {(r.dataset_id, r.cell, r.run): r.auroc for r in auc.collect()}
    assert set(got) == set(weight) and len(got) == 3 * (1 + 2 * 4)
    for key, w in weight.items():
        want = area([(sum(w.get(c, 0) * round(v * grid.VALUE) for c, v in zip(ALL, r[3:])), r[2]) for r in rows if r[0] == key[0] and r[1] == "test"])
        assert got[key] == (None if want is None else pytest.approx(want))


def test_ledger_keeps_failures_and_weighs_columns_without_spread_as_nothing(made):
    _, columns, _, auc = made
    book = grid.ledger(auc, columns).collect()
    assert len(book) == 6 and {r.status for r in book if r.dataset_id == 0} == {"FAILURE"} and {r.status for r in book if r.dataset_id} == {"SUCCESS"}
    assert {r.weight for r in columns.where("feature_id = 'b'").collect()} == {0}
    assert all(r.paired_harm > 0 for r in book if r.dataset_id and r.mechanism == "M01")


def test_baseline_refuses_missing_and_repeated_carriers(made):
    _, columns, chosen, auc = made
    repaired = grid.repairs(grid.ledger(auc, columns), auc, chosen).checkpoint()
    assert grid.baseline(repaired).count() == 6
    with pytest.raises(GateError):
        grid.baseline(repaired.union(repaired))
    with pytest.raises(GateError):
        grid.baseline(repaired.where("NOT (run = 'p3' AND cell = 1)"))


def test_flags_of_false_repairs(spark):
    """Each key has a p3 run and two controls; values: distance gained, recall, residual, overcorrection, retention, leaks removed, partial."""
    control = (0.1, 0.5, 0.1, 0.0, 0.9, 1, False)
    cases = {
        "none": ("M01", (0.2, 0.6, 0.0, 0.0, 0.9, 1, False), []),
        "no gain": ("M09", (0.1, 0.0, 0.2, 0.5, 0.0, 0, True), ["fr2"]),
        "recall": ("M01", (0.2, 0.5, 0.0, 0.0, 0.9, 1, False), ["fr1"]),
        "no leak went": ("M01", (0.2, 0.0, 0.0, 0.0, 0.9, 0, False), ["fr1", "fr2"]),
        "residual": ("M01", (0.2, 0.6, 0.1, 0.0, 0.9, 1, False), ["fr3"]),
        "over": ("M01", (0.2, 0.6, 0.0, 0.01, 0.9, 1, False), ["fr4"]),
        "retention": ("M01", (0.2, 0.6, 0.0, 0.0, 0.8, 1, False), ["fr5"]),
        "partial": ("M09", (0.2, 0.6, 0.0, 0.0, 0.9, 1, True), ["fr6"]),
        "partial of another": ("M06", (0.2, 0.6, 0.0, 0.0, 0.9, 1, True), []),
    }
    rows = [(i, 0, m, "S2", run, *v) for i, (m, p3, _) in enumerate(cases.values()) for run, v in (("p3", p3), ("p2_1", control), ("p2_2", control))]
    names = "dataset_id int, cell int, mechanism string, strength string, run string, strict_distance_reduction double, recall double, same_side_residual double, overcorrection double, legitimate_retention double, n_hit int, partial boolean"
    got = {r.dataset_id: [k for k in ("fr1", "fr2", "fr3", "fr4", "fr5", "fr6") if r[k]] for r in grid.false_repairs(spark.createDataFrame(rows, names)).collect()}
    assert got == {i: flags for i, (_, _, flags) in enumerate(cases.values())}


def test_correlations_with_a_constant_side_are_null_or_0(spark):
    df = spark.createDataFrame([("k", 1.0, 0, 2.0), ("k", 1.0, 1, 3.0), ("k", None, 1, 1.0), ("v", 1.0, 0, 5.0), ("v", 2.0, 1, 1.0), ("v", 4.0, 1, None), ("one", 3.0, 1, 2.0)], "feature_id string, value double, y int, z double")
    got = {r.feature_id: r["corr"] for r in rankers.correlation(df, ["feature_id"]).collect()}
    assert got["k"] == got["one"] == 0 and got["v"] == pytest.approx(0.7559289460184544)
    both = {r.feature_id: r for r in stats.correlations(df.where("value IS NOT NULL AND z IS NOT NULL"), "value", "z", ["feature_id"]).collect()}
    assert both["k"].pearson is None and both["one"].pearson is None and both["v"].pearson == pytest.approx(-1)


def test_fitted_grid_keeps_failures_as_rows(spark, made, monkeypatch):
    rows = made[0]
    df = spark.createDataFrame(rows, "dataset_id int, split string, y int, a double, b double, p double, q0 double, q1 double").checkpoint()
    once, fits = models.fit, []

    def fit(panel, columns, name, seed=1):
        fits.append(columns)
        return once(panel, [] if "q1" in columns else columns, name, seed)  # no columns: the fit fails

    monkeypatch.setattr(models, "fit", fit)
    got = {(r.dataset_id, r.mechanism): r for r in models.evaluation_grid(df, BASE, CELLS, ["lr"], ["dataset_id"]).collect()}
    assert len(got) == 6 and fits == [BASE, [*BASE, "p"], [*BASE, "q0", "q1"]]  # one clean fit for both cells
    for k in (1, 2):
        good, bad = got[k, "M01"], got[k, "M09"]
        assert good.status == "SUCCESS" and good.failure_reason is None and good.paired_harm == pytest.approx(good.full_auc - good.clean_auc) and good.paired_harm > 0
        assert bad.status == "FAILURE" and bad.failure_reason and bad.clean_auc == good.clean_auc
    assert got[0, "M01"].status == "FAILURE"


def test_draws_made_together_equal_those_of_one_expression(spark):
    rows = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("row_id"))
    made = probes.with_draws(rows, 5, ["m02", "m06_0"], ["M01"])
    want = made.select(F.abs(F.col("_drawn_m02") - draws.normal("5", "m02", F.col("row_id"))).alias("a"), F.abs(F.col("_drawn_m06_0") - draws.normal("5", "m06_0", F.col("row_id"))).alias("b"), F.abs(F.col("_drawn_u_M01") - draws.uniform("5", "M01", F.col("row_id"))).alias("c"))
    assert max(want.agg(F.max("a"), F.max("b"), F.max("c")).first()) < 1e-12 and made.count() == 300


def test_splits_shuffle_no_rows_and_cut_between_rows_that_are_alike(spark):
    from datetime import datetime

    rows = [(datetime(2020, 1, 1 + i // 40), f"{i:04d}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, row_id string, i int").checkpoint()
    split = order.time_split(df)
    assert {(r.i, r.split) for r in split.collect()} == {(i, "train" if i < 120 else "validation" if i < 160 else "test") for i in range(200)}
    assert "hashpartitioning" not in split._jdf.queryExecution().executedPlan().toString()
    alike = spark.createDataFrame([(datetime(2020, 1, 1), "same", i) for i in range(10)], "ts timestamp, row_id string, i int").checkpoint()
    assert {r.split: r["count"] for r in order.time_split(alike).groupBy("split").count().collect()} == {"train": 6, "validation": 2, "test": 2}
