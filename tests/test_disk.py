"""What queries write down: columns of the grid are made where they are read, and scores are shuffled packed."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import binned, neighbours, order, rankers, scored
from fieldaudit.plans import grid_queries, matrix_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_the_grid_writes_down_the_panel_and_not_its_cells_columns(spark, monkeypatch):
    """The columns of all cells were checkpointed for every row, many times the panel."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    widths, kind = [], type(spark.range(1))
    once, stored = kind.checkpoint, order.stored
    monkeypatch.setattr(kind, "checkpoint", lambda df, *a, **k: widths.append(len(df.columns)) or once(df, *a, **k))
    monkeypatch.setattr(order, "stored", lambda df: widths.append(len(df.columns)) or stored(df))
    assert matrix_queries.QUERIES["u3_column_difference"](spark, SF).count() > 0
    _, _, auc = grid_queries.book(spark, SF)
    assert auc.where("auroc > 0.5").count() > 0
    assert max(widths) < len(grid_queries.ADDED) and 4 + len(grid_queries.FEATURES) in widths


def test_packed_scores_come_back_and_are_smaller():
    draw = np.random.default_rng(1)
    for value in (draw.integers(-(2**45), 2**45, 20_000), np.array([-(2**63), 0, 2**63 - 1]), np.array([7, 7, 7]), np.array([5])):
        value = np.sort(value.astype(np.int64))
        assert (scored.unpacked(scored.packed(value)) == value).all()
    some = np.sort(draw.integers(-(2**45), 2**45, 20_000))
    assert len(zlib.compress(scored.packed(some), 1)) < 5.5 * len(some)
    s = np.array([-np.inf, -2.5, -1e-300, -0.0, 0.0, 1.0, np.inf, np.nan])
    told = scored.ordered(s)
    assert (np.diff(told) >= 0).all() and told[3] == told[4] and told[6] == told[7] and len(set(told.tolist())) == 6


def test_sums_at_positions_equal_those_of_all_rows(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    draw = random.Random(2)
    rows = [(f"2020-01-{1 + draw.randrange(4):02d} {draw.randrange(2):02d}:00:00", f"{draw.randrange(16**4):04x}{i}", draw.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows, "ts string, row_id string, y long").withColumn("ts", F.col("ts").cast("timestamp"))
    sums = np.cumsum([y for _, _, y in sorted(rows)])
    for k in (df, df.withColumn("row_id", F.conv(F.substring("row_id", 1, 4), 16, 10).cast("long") * 1000 + F.substring("row_id", 5, 3).cast("long"))):
        got = {r.pos: r._sum for r in order.sums_at(k, "y", spark.createDataFrame([(p,) for p in (0, *range(1, 301, 3), 300, 301)], "pos long").distinct()).collect()}
        assert got == {p: int(sums[p - 1]) for p in {*range(1, 301, 3), 300}}


@pytest.mark.parametrize("slots,sample", [(256, 8_000), (8, 60)])
def test_mutual_information_by_slots_equals_that_of_all_values(spark, monkeypatch, slots, sample):
    """values of every row and column were grouped and ranked; ties, constants, discrete and missing values."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(binned, "SLOTS", slots)
    monkeypatch.setattr(binned, "SAMPLE", sample)
    monkeypatch.setattr(binned, "ROWS", 150)
    draw = random.Random(4)
    rows = []
    for i in range(900):
        y = draw.randrange(2)
        x = [draw.gauss(y, 1), float(draw.randrange(4) + y), 3.0, draw.choice([0.0, -0.0, draw.gauss(y, 2)]), None if i % 9 == 0 else float(i % 7), draw.random() ** 9]
        rows.append((i % 2 if i < 880 else 2, y, x))
    names = list("abcdef")
    df = spark.createDataFrame(rows, "unit int, y int, x array<double>").repartition(3)
    long = df.select("unit", "y", F.posexplode("x").alias("p", "value")).select("unit", F.element_at(F.array(*map(F.lit, names)), F.col("p") + 1).alias("feature_id"), "y", "value")
    want = {(r.unit, r.feature_id): r.mi for r in rankers.mutual_information(long, ["unit", "feature_id"]).collect()}
    got = {(r.unit, r.feature_id): r.mi for r in binned.mutual_information(df, names).collect()}
    assert len(want) == 18 and got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    monkeypatch.setattr(rankers, "mutual_information", None)
    assert binned.mutual_information(df.where("unit > 5"), names).count() == 0


def test_neighbours_shuffle_each_side_for_few_blocks(monkeypatch):
    """a block was 1,000 queries or 4,000 points, and each side was shuffled once for each block of the other."""
    for n in (10_000, 100_000, 1_000_000):
        nq, np_ = neighbours.blocks(n, n, 64, 64)
        assert nq * np_ >= min(64, n // 1_000 * (n // 4_000)) and n * 64 / max(nq, np_) <= neighbours.BLOCK
        assert (nq + np_) * 4 < n / 1_000 + n / 4_000 or n == 10_000
    assert neighbours.blocks(0, 0, 1, 64) == (1, 1)
    nq, np_ = neighbours.blocks(50_000, 500_000, 64, 64)
    assert nq < np_ and nq + np_ < 40


def test_neighbours_over_tiles_and_blocks_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    draw = np.random.default_rng(5)
    v = draw.integers(0, 3, (130, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "id int, v array<float>")
    got = {(r.q_id, r["rank"]): (r.id, r.dist) for r in neighbours.nearest(df, df, 4, queries_a_block=7, points_a_block=11).collect()}
    want = {}
    for i in range(130):
        d = [(float(((v[i] - v[j]) ** 2).sum()), j) for j in range(130) if j != i]
        want |= {(i, r + 1): (j, x) for r, (x, j) in enumerate(sorted(d)[:4])}
    assert got == want
