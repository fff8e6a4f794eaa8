"""Areas of many scores of the same rows, against every pair of rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import metrics, scored


@pytest.mark.parametrize("kind", ["long", "double"])
def test_areas_over_ranges_equal_those_of_all_pairs(spark, monkeypatch, kind):
    """Exact over many ranges, batches and ties; what is shuffled are arrays, not a row for each score."""
    monkeypatch.setattr(scored, "RANGE", 40)
    monkeypatch.setattr(scored, "ROWS", 60)
    number = float if kind == "double" else int
    rows = [(i % 2 if i < 400 else 2, int(i * 7919 % 31 + i * 37 % 17 > 22) if i < 400 else 1, [number(i * 7919 % 31), number(-(i * 37 % 17)), number(i % 5)]) for i in range(430)]
    df = spark.createDataFrame(rows, f"unit int, y int, x array<{kind}>").repartition(3)
    w = np.array([[1, 0, 3, 0], [2, 1, -1, 0], [0, 5, 1, 0]])
    out = scored.areas(df, lambda unit, x: (np.arange(4) + 10 * unit, x @ w))
    got = {(r.unit, r.fit): r.auroc for r in out.collect()}
    assert len(got) == 12
    for unit, k in itertools.product(range(3), range(4)):
        pairs = [(int(np.array(x) @ w[:, k]), y) for u, y, x in rows if u == unit]
        won = [1.0 if a > b else 0.5 if a == b else 0.0 for (a, y), (b, z) in itertools.product(pairs, pairs) if y == 1 and z == 0]
        assert got[unit, 10 * unit + k] == (pytest.approx(sum(won) / len(won), abs=1e-12) if won else None)


def test_scores_that_are_missing_are_the_highest(spark):
    df = spark.createDataFrame([(0, y, [x]) for y, x in ((1, float("nan")), (0, float("nan")), (1, 2.0), (0, 1.0), (1, None))], "unit int, y int, x array<double>")
    assert scored.areas(df, lambda unit, x: (np.array([0]), x)).first().auroc == pytest.approx((0.5 + 1 + 0 + 1 + 0.5 + 1) / 6)
    assert metrics.auroc(df.select("y", F.coalesce(F.get("x", F.lit(0)), F.lit(float("nan"))).alias("s")), [], "s").first().auroc == pytest.approx(4 / 6)


def test_regressions_of_a_panel_share_passes_and_end_at_the_optimum_of_all_rows(spark, monkeypatch):
    """Whatever sample they begin on, separable columns too."""
    from fieldaudit.operators import batch_models, models

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(batch_models, "START", 60)
    rows = [("train", int(i * 7919 % 101 + i * 31 % 47 > 70), float(i * 7919 % 101), float(i % 13)) for i in range(600)]
    df = spark.createDataFrame([(*r, r[1] + r[3] / 50) for r in rows], "split string, y int, a double, b double, leak double")
    passes, once = [], batch_models._newton
    monkeypatch.setattr(batch_models, "_newton", lambda rows, fits, *more: passes.append(len(fits[0])) or once(rows, fits, *more))
    asked = [models.fit(df, c, "lr") for c in (["a"], ["a", "b"], ["a", "b", "leak"])]
    models.solved(df, asked)
    assert passes[0] == 3 and len(passes) < 60
    y = np.array([r[1] for r in rows])
    for r in asked:
        x = np.array([[*r_[2:], r_[1] + r_[3] / 50] for r_ in rows])[:, : len(r.columns)]
        z = (x - x.mean(0)) / x.std(0)
        prob = 1 / (1 + np.exp(-(r.b + z @ r.w)))
        assert abs((y - prob).sum()) < 1e-4 and np.abs(z.T @ (y - prob) - r.w).max() < 1e-4
