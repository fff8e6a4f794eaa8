"""How often queries read order lines, and operators on rows that are counted first."""

import os

import pytest
from pyspark.sql import functions as F

from fieldaudit import plans
from fieldaudit.operators import probes, rankers

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name,most", [("f15_t7_views", 1), ("g12_semantic_groups", 0), ("g13_selection_digest", 0), ("t6_permuted_columns", 0), ("m8_future_entity_rate", 3), ("q9_base_unchanged", 3), ("d9_combinations", 0), ("d10_alternate_risk", 0)])
def test_order_lines_are_read_so_often(spark, name, most):
    """Reads that the plan has left when the query returns; what it computed before is checkpointed."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= most


def test_counted_rows_give_the_same_rankings(spark):
    """one table of counts stands for the rows, for fewer columns too; nulls stay in the lowest bin."""
    df = spark.range(600).select((F.col("id") % 2).alias("f"), (F.col("id") % 3).alias("env"), F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 50).cast("double").alias("value"), (F.col("id") * 7 % 50 + F.col("id") % 5 > 26).cast("int").alias("y"))
    counted = rankers.counted(df, ["f", "env"])
    assert counted.count() < 600
    told = lambda out, c: {r.f: pytest.approx(r[c]) for r in out.collect()}
    assert told(rankers.mutual_information(counted, ["f"]), "mi") == {r.f: r.mi for r in rankers.mutual_information(df, ["f"]).collect()}
    assert told(rankers.instability(counted, ["f"], "env"), "instability") == {r.f: r.instability for r in rankers.instability(df, ["f"], "env").collect()}


def test_changed_base_rows_keep_their_number(spark):
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "id int, v string")
    after = spark.createDataFrame([(1, "a"), (2, None), (4, "d"), (4, "d")], "id int, v string")
    assert sorted(map(tuple, probes.same_base(before, after, ["id", "v"]).collect())) == [(1, "a", "before"), (3, "c", "before"), (4, "d", "after"), (4, "d", "after")]


def test_later_rows_of_an_entity_over_months(spark):
    """Counts and rates of strictly later rows, against a loop; no order among rows of one time."""
    rows = [(f"r{i}", i % 3, f"2020-{1 + i * 5 % 4:02d}-{1 + i * 3 % 6:02d}", i * 7 % 4 // 2) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id string, entity_id int, ts string, y int").withColumn("ts", F.col("ts").cast("timestamp"))
    out = probes.future_entity_rate(df, 0.8, 1, prior=0.5)
    assert "row_id ASC" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.row_id: (r.m08_count, r.m08_rate) for r in out.collect()}
    for k, e, t, _ in rows:
        later = [y for _, f, u, y in rows if f == e and u > t]
        assert got[k] == (len(later), pytest.approx((sum(later) + 1) / (len(later) + 2) if later else 0.5))
