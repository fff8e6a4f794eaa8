"""Algebra of ledgers: checked joins, precedence, key sets, summaries and gates. A gate returns the rows that break it, or raises if asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.operators.order import quantiles


class GateError(ValueError):
    """A table doesn't hold what an operator needs."""


def require(broken: DataFrame, what: str) -> None:
    """Raises if a gate found rows."""
    if not broken.isEmpty():
        raise GateError(what)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of one table that the other lacks, with side."""
    left, right = a.select(*key).distinct(), b.select(*key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).union(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def one_to_one(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Inner join of tables with unique keys and equal key sets, else GateError."""
    require(duplicates(a, key), "the left table repeats a key")
    require(duplicates(b, key), "the right table repeats a key")
    require(missing_keys(a, b, key), "a key has no partner")
    return a.join(b, key)


def complete_left(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Left join to unique keys that leaves no row without a partner, else GateError."""
    require(duplicates(b, key), "the right table repeats a key")
    require(a.join(b, key, "left_anti"), "a row has no partner")
    return a.join(b, key, "left")


def precedence(tables: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """All rows of the first table, then those of each next whose key isn't there yet; provenance names the table."""
    out = None
    for name, df in tables:
        own = df.withColumn("provenance", F.lit(name))
        out = own if out is None else out.unionByName(own.join(out.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def overwrite(raw: DataFrame, news: DataFrame, key: list[str], column: str, where: Column) -> DataFrame:
    """raw with a column taken from news on the rows where the condition holds and news has the key; all else stays."""
    fresh = news.select(*key, F.col(column).alias("_new"))
    return raw.join(fresh, key, "left").withColumn(column, F.when(where & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_new")


def paired_controls(df: DataFrame, key: list[str], treated: Column, control: Column, value: str) -> DataFrame:
    """key, effect: the treated row's value less the mean of its controls; keys without both are left out."""
    t, c = df.where(treated).groupBy(*key).agg(F.avg(value).alias("treated")), df.where(control).groupBy(*key).agg(F.avg(value).alias("control"), F.count("*").alias("n_controls"))
    return t.join(c, key).withColumn("effect", F.col("treated") - F.col("control"))


def pairs(df: DataFrame, level: str, key: list[str], value: str) -> DataFrame:
    """key, a, b, value_a, value_b of every two levels that share a key."""
    left = df.select(*key, F.col(level).alias("a"), F.col(value).alias("value_a"))
    right = df.select(*key, F.col(level).alias("b"), F.col(value).alias("value_b"))
    return left.join(right, key).where("a < b")


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def run_id(*columns: str, length: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256), 1, length)


def table_digest(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n, digest: a sum over rows' hashes, so that neither order nor partitioning matters."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 10), 16, 10).cast("long")).alias("digest"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    q = lambda p: F.percentile(v, F.lit(p))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("std"),
        (q(0.75) - q(0.25)).alias("iqr"),
    )


def two_stage_mean(df: DataFrame, unit: list[str], by: list[str], value: str) -> DataFrame:
    """by, mean, units: the mean over units of each unit's mean, so that a unit's size doesn't count."""
    per = df.groupBy(*by, *unit).agg(F.avg(value).alias("_m"))
    return per.groupBy(*by).agg(F.avg("_m").alias("mean"), F.count("*").alias("units"))


def leave_one_out(df: DataFrame, level: str, value: str) -> DataFrame:
    """left_out, mean, n: the mean without each level in turn, from sums: no row is repeated."""
    each = df.groupBy(F.col(level).alias("left_out")).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    total = each.agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    return each.crossJoin(F.broadcast(total)).select("left_out", ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("mean"), (F.col("_tn") - F.col("_n")).alias("n"))


def leave_levels_out(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """scope, level, n, mean: the mean without each level of each factor in turn. One pass sums all cells; the rest is subtraction."""
    each = scopes(df.where(F.col(value).isNotNull()), factors, {"_s": F.col(value)})
    total = each.where("scope = 'overall'").select(F.col("n").alias("_tn"), F.col("_s").alias("_ts"))
    left = each.where("scope <> 'overall'").crossJoin(F.broadcast(total))
    return left.select("scope", "level", (F.col("_tn") - F.col("n")).alias("n"), ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("n"))).alias("mean")).where("n > 0")


def average_rank(by: list[str], value: str) -> Column:
    """Rank within each group, ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*by, value)) - 1) / 2


def quantile_bin(df: DataFrame, value: str, bins: int = 4) -> DataFrame:
    """df with bin 0.. by edges between quantiles, each bin with its upper edge."""
    edges = quantiles(df, [], value, [i / bins for i in range(1, bins)]).withColumnRenamed("q", "_e")
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")


def scopes(df: DataFrame, factors: list[str], sums: dict[str, Column]) -> DataFrame:
    """scope, level, n and sums: over all rows, and over each level of each factor.

    Rows are first summed by all factors together; grouping sets then expand those sums, one row each, and not the rows.
    """
    cells = df.select(*(F.col(f).cast("string").alias(f) for f in factors), *(c.alias(k) for k, c in sums.items())).groupBy(*factors).agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in sums))
    out = cells.groupingSets([[], *([f] for f in factors)], *factors).agg(F.grouping_id(*factors).alias("_g"), F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in sums))
    left = [2 ** len(factors) - 1 - 2 ** (len(factors) - 1 - i) for i in range(len(factors))]  # grouping_id's bits are set for factors summed over
    pick = lambda of: F.coalesce(*(F.when(F.col("_g") == g, of(f)) for g, f in zip(left, factors)))
    whole = F.col("_g") == 2 ** len(factors) - 1
    return out.select(F.when(whole, F.lit("overall")).otherwise(pick(F.lit)).alias("scope"), F.when(whole, F.lit("all")).otherwise(pick(F.col)).alias("level"), "n", *sums)


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n: how many values of each are null, NaN or infinite, where there are any."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    row = df.agg(*(F.sum(bad(c).cast("int")).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns)))
    return row.select(each.alias("_x")).select("_x.column", "_x.n").where("n > 0")


def broken_invariants(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule, where any does (null counts as broken)."""
    row = df.agg(*(F.sum((~F.coalesce(r, F.lit(False))).cast("int")).alias(k) for k, r in rules.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules)))
    return row.select(each.alias("_x")).select("_x.rule", "_x.n").where("n > 0")
