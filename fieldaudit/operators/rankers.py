"""Rankers of columns over a melted table (cell, feature_id, value, y): a column is a group, never a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.operators.metrics import pearson
from fieldaudit.operators.order import quantiles, small

# The weight of a column's place in the life of a record; any other place weighs 0.5
LIFECYCLE = {
    "prediction_time": 0.0, "pre_outcome": 0.0, "post_outcome": 1.0, "future_window": 1.0, "repayment": 0.8, "closed": 0.8,
    "subgroup_specific": 0.4, "entity_specific": 0.3, "source_specific": 0.3, "graph_component": 0.2,
}


def counted(df: DataFrame, by: list[str]) -> DataFrame:
    """by, value, y, _counted: df's rows by what mutual_information() needs of them, computed once for all that read it."""
    return df.groupBy(*by, "value", "y").agg(F.count("*").alias("_counted")).checkpoint()


def mutual_information(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """by, mi: mutual information, in nats, of the value's bin and y. Bins lie between exact quantiles, ties in the lower bin.

    A different estimator from those by nearest neighbours: values differ, the order of columns is what it is for. df may be counted() by
    these columns or more; else it is counted here, in one pass over its rows.
    """
    df = df if "_counted" in df.columns else counted(df, by)
    edges = quantiles(df, by, "value", [i / bins for i in range(1, bins)], "_counted").withColumnRenamed("q", "_e").checkpoint()
    placed = df.join(small(edges), by).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("value"))))
    joint = placed.groupBy(*by, "_b", "y").agg(F.sum("_counted").cast("double").alias("_n"))
    all_, of_b, of_y = Window.partitionBy(*by), Window.partitionBy(*by, "_b"), Window.partitionBy(*by, "y")
    n = F.sum("_n").over(all_)
    term = F.col("_n") / n * F.log(F.col("_n") * n / (F.sum("_n").over(of_b) * F.sum("_n").over(of_y)))
    return joint.withColumn("_t", term).groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum("_t")).alias("mi"))


def correlation(df: DataFrame, by: list[str]) -> DataFrame:
    """by, corr: absolute correlation with y, 0 where it isn't defined."""
    return df.groupBy(*by).agg(F.coalesce(F.nanvl(F.abs(pearson("value", F.col("y").cast("double"))), F.lit(0.0)), F.lit(0.0)).alias("corr"))


def min_max(column: str, by: list[str], constant: float = 0.5) -> Column:
    """The column scaled to 0..1 within each group, a constant where all are equal; null counts as 0."""
    w, x = Window.partitionBy(*by), F.coalesce(F.nanvl(F.col(column), F.lit(0.0)), F.lit(0.0))
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(constant))


def instability(df: DataFrame, by: list[str], env: str, least: int = 10) -> DataFrame:
    """by, instability: standard deviation over environments of more than so many rows of the column's mutual information in each. df may be
    counted() by these columns."""
    df = df if "_counted" in df.columns else counted(df, [*by, env])
    mi = mutual_information(df, [*by, env]).join(df.groupBy(*by, env).agg(F.sum("_counted").alias("_n")).where(F.col("_n") > least), [*by, env])
    return mi.groupBy(*by).agg(F.when(F.count("*") >= 2, F.stddev_pop("mi")).otherwise(0.0).alias("instability"))


def availability_risk(columns: DataFrame) -> DataFrame:
    """The registry's rows with availability_risk: the largest of what its flags stand for."""
    stage = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LIFECYCLE.items() for x in kv)), F.col("lifecycle")), F.lit(0.5))
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return columns.withColumn("availability_risk", F.greatest(stage, flag(~F.col("available"), 1.0), flag(F.col("outcome_descendant"), 1.0), flag(F.col("post_event_table"), 0.9)))


def structural_risk(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """The registry's rows with structural_risk: the larger of the scaled weighted degree and the group's size, less one, against the largest group's."""
    ends = edges.select(F.col("src").alias("feature_id"), F.abs("weight").alias("w")).union(edges.select("dst", F.abs("weight")))
    degree = ends.groupBy("feature_id").agg(F.sum("w").alias("_d"))
    groups = columns.where("group_id IS NOT NULL").groupBy("group_id").agg(F.count("*").alias("_g"))
    largest = groups.agg(F.greatest(F.lit(1), F.max("_g") - 1).alias("_most"))
    groups = groups.crossJoin(F.broadcast(largest)).select("group_id", ((F.col("_g") - 1) / F.col("_most")).alias("_share"))
    out = columns.join(degree, "feature_id", "left").join(groups, "group_id", "left").withColumn("_one", F.lit(1))
    risk = F.greatest(min_max("_d", ["_one"], 0.0), F.coalesce("_share", F.lit(0.0)))
    return out.withColumn("structural_risk", risk).select(*columns.columns, "structural_risk")


def composite(df: DataFrame, weights: dict[str, float]) -> Column:
    return sum((F.lit(w) * F.col(c) for c, w in list(weights.items())[1:]), F.lit(list(weights.values())[0]) * F.col(list(weights)[0]))


# The weights of impact i, availability a, structure s and instability e in each combination
COMBINATIONS = {
    "I": {"i": 1.0}, "A": {"a": 1.0}, "S": {"s": 1.0}, "E": {"e": 1.0}, "I+A": {"i": 0.5, "a": 0.5}, "I+S": {"i": 0.5, "s": 0.5},
    "A+S+E": {"a": 0.4, "s": 0.4, "e": 0.2}, "I+A+S+E": {"i": 0.25, "a": 0.25, "s": 0.25, "e": 0.25},
}


def combinations(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each combination of a column's risks."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("combo"), composite(df, w).alias("score")) for k, w in COMBINATIONS.items())))
    return df.select(*keep, each.alias("_c")).select(*keep, "_c.combo", "_c.score")


def distance_risk(columns: DataFrame, edges: DataFrame, known_bad: DataFrame) -> DataFrame:
    """feature_id, distance, risk: steps along edges (either way) to the nearest known bad column: 0.9, 0.6 and 0.3 for none, one and two,
    0.1 for more, 0.3 where none leads there. The registry is a table of columns, so each step is a small job."""
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct().checkpoint()
    reach = front = known_bad.select("feature_id", F.lit(0).alias("distance")).distinct().checkpoint()
    step = 0
    while not front.isEmpty():
        step += 1
        front = front.join(ends, F.col("feature_id") == F.col("a")).select(F.col("b").alias("feature_id")).distinct()
        front = front.join(reach, "feature_id", "left_anti").withColumn("distance", F.lit(step)).checkpoint()
        reach = reach.union(front)
    d = F.col("distance")
    out = columns.select("feature_id").join(reach, "feature_id", "left")
    return out.withColumn("risk", F.when(d.isNull(), 0.3).when(d == 0, 0.9).when(d == 1, 0.6).when(d == 2, 0.3).otherwise(0.1))


def alternate_risk(columns: DataFrame, reached: DataFrame, impact: str = "i") -> DataFrame:
    """columns (with impact) with availability by two flags, structure by distance_risk() and their composite, between 0 and 1."""
    flag = lambda c, w: F.when(F.col(c), F.lit(w)).otherwise(F.lit(0.0))
    hits = F.col("outcome_descendant").cast("int") + F.col("post_event_table").cast("int")
    a = F.when(hits > 0, (flag("outcome_descendant", 0.9) + flag("post_event_table", 0.7)) / hits).otherwise(F.lit(0.5))
    out = columns.join(reached.select("feature_id", F.col("risk").alias("distance_risk")), "feature_id").withColumn("flag_risk", a)
    whole = 0.4 * F.col("flag_risk") + 0.4 * F.col("distance_risk") + 0.2 * F.col(impact) * F.col("flag_risk")
    return out.withColumn("alternate_composite", F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)))
