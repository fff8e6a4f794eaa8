"""Decision rules as a table: a status holds where all its conditions on summary figures hold, and the first status that holds is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A condition: claim, rank of the status among the claim's, status, metric, operator, threshold (a number or another metric's name).
Rule = tuple[str, int, str, str, str, float | str]

# When a governed policy is said to repair, by its paired effects against random controls
GATE: list[Rule] = [
    *(("governance", 0, "SEMANTICALLY_CORROBORATED", m, op, 0.0) for m, op in (
        ("strict_distance_reduction.mean", ">"), ("strict_distance_reduction.low", ">"), ("directional_repair.mean", ">"), ("directional_repair.low", ">"), ("same_side_residual.mean", "<"),
        ("same_side_residual.high", "<"), ("leak_recall.mean", ">"), ("leak_recall.low", ">"), ("overcorrection.mean", "<="), ("legitimate_retention.mean", ">="))),
    *(("governance", 1, "SCORE_RECOVERY_ONLY", m, ">", 0.0) for m in ("strict_distance_reduction.mean", "strict_distance_reduction.low")),
    *(("governance", 2, "NEGATIVE", m, "<", 0.0) for m in ("strict_distance_reduction.mean", "strict_distance_reduction.high")),
]


def rules(spark, table: list[Rule]) -> DataFrame:
    rows = [(c, k, s, m, op, t if isinstance(t, float) else None, None if isinstance(t, float) else t) for c, k, s, m, op, t in table]
    return spark.createDataFrame(rows, "claim_id string, rank int, status string, metric string, op string, threshold double, other string")


def decide(summary: DataFrame, by: list[str], table: list[Rule], otherwise: str) -> DataFrame:
    """by, claim_id, status, n_held, n_conditions of every claim for each group of a summary (by, metric, value).

    A condition on a figure that is missing or null doesn't hold. n_held and n_conditions are of all the claim's conditions. The rules are a
    small table, joined to the summary; their number and names are data, not code.
    """
    conditions = rules(summary.sparkSession, table)
    groups = summary.select(*by).distinct() if by else None
    asked = conditions if groups is None else groups.crossJoin(F.broadcast(conditions))
    value = summary.select(*by, "metric", "value")
    told = asked.join(value, [*by, "metric"], "left").join(value.select(*by, F.col("metric").alias("other"), F.col("value").alias("_other")), [*by, "other"], "left")
    v, t = F.col("value"), F.coalesce("threshold", "_other")
    held = F.when(F.col("op") == ">", v > t).when(F.col("op") == ">=", v >= t).when(F.col("op") == "<", v < t).when(F.col("op") == "<=", v <= t)
    told = told.withColumn("_held", F.coalesce(held, F.lit(False)))
    each = told.groupBy(*by, "claim_id", "rank", "status").agg(F.min("_held").alias("_all"), F.sum(F.col("_held").cast("int")).alias("_n"), F.count("*").alias("_of"))
    best = F.min(F.when(F.col("_all"), F.struct("rank", "status"))).alias("_best")
    return each.groupBy(*by, "claim_id").agg(best, F.sum("_n").alias("n_held"), F.sum("_of").alias("n_conditions")).select(*by, "claim_id", F.coalesce("_best.status", F.lit(otherwise)).alias("status"), "n_held", "n_conditions")


def figures(intervals: DataFrame, by: list[str], effect: str, names: dict[str, str]) -> DataFrame:
    """by, metric, value: a row for each figure of each effect, named effect.figure, from one row an effect; names maps columns to figures."""
    each = F.explode(F.array(*(F.struct(F.concat_ws(".", effect, F.lit(n)).alias("metric"), F.col(c).cast("double").alias("value")) for c, n in names.items()))).alias("_f")
    return intervals.select(*by, each).select(*by, "_f.metric", "_f.value")
