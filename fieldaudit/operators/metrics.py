"""Evaluation metrics per cell: every one is a grouped aggregate, so thousands of cells are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auroc(df: DataFrame, by: list[str], score: str, label: str = "y", weight: str | None = None, part: str | None = None) -> DataFrame:
    """by, n_pos, n_neg, auroc: the chance that a positive scores above a negative, ties one half; null if a class is missing.

    Rows are first collapsed to different scores. These are put in ranges of (cell, score) of about equal counts, each range sums up what its
    positives win within it, and the totals of the ranges below are added: a cell of any number of scores is never one window. part: a whole
    number that never falls along a cell's score, if there is one: rows are then shuffled once, by it, instead of by score and by range.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    counts = [F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(w)).alias("_q")]
    if part:
        parted = df.withColumnRenamed(part, "_part").repartition(*by, "_part").groupBy(*by, "_part", score).agg(*counts)
    else:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parted = df.groupBy(*by, score).agg(*counts).repartitionByRange(n, *map(F.col, by), F.col(score)).withColumn("_part", F.spark_partition_id())
    below = F.sum("_q").over(Window.partitionBy(*by, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_q")
    part = parted.withColumn("_won", F.col("_p") * (below + F.col("_q") / 2)).groupBy(*by, "_part").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"), F.sum("_won").alias("_won"))
    lower = F.sum("_q").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_q")
    out = part.withColumn("_won", F.col("_won") + F.col("_p") * lower).groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), F.sum("_won").alias("_won"))
    return out.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_won") / (F.col("n_pos") * F.col("n_neg")))).drop("_won")


def average_precision(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """by, n, n_true, ap, normalized_ap: precision at each different score, weighted by the recall it adds. Ties share a threshold."""
    flat = df.groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("int")).alias("_t"))
    along = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("_hit", F.col("_t") * F.sum("_t").over(along) / F.sum("_n").over(along))
    out = flat.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_t").alias("n_true"), F.sum("_hit").alias("_hit"))
    ap = F.when(F.col("n_true") > 0, F.col("_hit") / F.col("n_true")).otherwise(0.0)
    share = F.col("n_true") / F.col("n")
    return out.withColumn("ap", ap).withColumn("normalized_ap", (F.col("ap") - share) / F.greatest(F.lit(1e-12), 1 - share)).drop("_hit")


def localization(df: DataFrame, by: list[str], score: str = "score", truth: str = "is_leak", k: int = 5, tie: str = "position") -> DataFrame:
    """average_precision() with top_k_recall, legitimate_fpr (share of sound columns in the top k) and reciprocal_rank of the first bad one."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).desc()))
    bad, top = F.col(truth).cast("int"), (F.col("_rank") <= k).cast("int")
    ranked = df.withColumn("_rank", rank).groupBy(*by).agg(
        F.sum(bad * top).alias("_hit"), F.sum(bad).alias("_bad"), F.sum((1 - bad) * top).alias("_false"), F.sum(1 - bad).alias("_sound"), F.min(F.when(bad == 1, F.col("_rank"))).alias("_first")
    )
    ranked = ranked.select(
        *by, F.when(F.col("_bad") > 0, F.col("_hit") / F.col("_bad")).otherwise(1.0).alias("top_k_recall"),
        F.when(F.col("_sound") > 0, F.col("_false") / F.col("_sound")).otherwise(0.0).alias("legitimate_fpr"), (1 / F.col("_first")).alias("reciprocal_rank"),
    )
    return average_precision(df, by, score, truth).join(ranked, by)


def pearson(x: str | Column, y: str | Column) -> Column:
    """An aggregate: the correlation of x and y over rows that have both, null where either is constant (F.corr divides by zero there)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def losses(df: DataFrame, by: list[str], probability: str, label: str = "y", eps: float = 1e-15) -> DataFrame:
    p, y = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(probability))), F.col(label)
    return df.groupBy(*by).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((F.col(probability) - y) * (F.col(probability) - y)).alias("brier"))


def exploitation_ratio(full: Column, clean: Column) -> Column:
    return F.least(F.lit(1.0), (full - clean) / F.greatest(F.lit(0.001), 1 - clean))


def utility(df: DataFrame, strict: str, full: str, governed: str) -> DataFrame:
    """residual_inflation, utility_damage, delta, strict_distance_reduction of each row."""
    s, f, g = F.col(strict), F.col(full), F.col(governed)
    return df.withColumns({
        "residual_inflation": F.greatest(F.lit(0.0), g - s), "utility_damage": F.greatest(F.lit(0.0), s - g), "delta": g - f,
        "strict_distance_reduction": F.abs(f - s) - F.abs(g - s),
    })


def directional_repair(df: DataFrame, strict: str, full: str, governed: str, zero: float = 1e-12) -> DataFrame:
    """How a governed score moved from the full one towards the strict one, and on which side it ended.

    Without a gap (zero or less) there is nothing to repair: the fraction is null and any distance is introduced_distortion.
    """
    gap, offset = F.col(full) - F.col(strict), F.col(governed) - F.col(strict)
    none, side = F.abs(gap) <= zero, F.signum(gap)
    out = df.withColumns({"signed_gap": gap, "opportunity": F.abs(gap), "governed_offset": offset, "direction": side})
    out = out.withColumns({
        "same_side_residual": F.when(none, 0.0).otherwise(F.greatest(side * offset, F.lit(0.0)) + F.lit(0.0)), "overcorrection": F.when(none, 0.0).otherwise(F.greatest(-side * offset, F.lit(0.0)) + F.lit(0.0)),
        "introduced_distortion": F.when(none, F.abs(offset)).otherwise(0.0), "opportunity_class": F.when(none, "zero").otherwise("nonzero"),
    })
    out = out.withColumn("directional_repair", F.when(none, 0.0).otherwise(F.col("opportunity") - F.col("same_side_residual")))
    return out.withColumn("directional_repair_fraction", F.when(~none, F.col("directional_repair") / F.col("opportunity")))


def removal(df: DataFrame, by: list[str], removed: str = "removed", truth: str = "is_leak") -> DataFrame:
    """recall, deletion precision, retention of sound columns and what bad ones are left, per cell of a removal table."""
    r, t = F.col(removed).cast("int"), F.col(truth).cast("int")
    out = df.groupBy(*by).agg(F.sum(r).alias("n_removed"), F.sum(t).alias("n_leak"), F.sum(r * t).alias("n_hit"), F.sum((1 - r) * (1 - t)).alias("_kept"), F.sum(1 - t).alias("_sound"))
    ratio = lambda a, b, other: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(other))
    out = out.withColumns({"recall": ratio("n_hit", "n_leak", 1.0), "deletion_precision": ratio("n_hit", "n_removed", 1.0), "legitimate_retention": ratio("_kept", "_sound", 1.0)})
    return out.withColumn("residual_leaks", F.col("n_leak") - F.col("n_hit")).drop("_kept", "_sound")


def mean_difference(df: DataFrame, by: list[str], value: str, label: str = "y") -> DataFrame:
    """Standardised difference of the classes' means, by the mean of their variances; 0 without spread."""
    of = lambda f, c: f(F.when(F.col(label) == c, F.col(value)))
    out = df.groupBy(*by).agg(of(F.avg, 1).alias("_a"), of(F.avg, 0).alias("_b"), of(F.var_samp, 1).alias("_u"), of(F.var_samp, 0).alias("_v"))
    spread = F.sqrt((F.col("_u") + F.col("_v")) / 2)
    return out.select(*by, F.when(spread > 1e-12, (F.col("_a") - F.col("_b")) / spread).otherwise(0.0).alias("smd"))


def _shares(df: DataFrame, by: list[str], category: str, label: str) -> DataFrame:
    flat = df.groupBy(*by, category).agg(F.sum((F.col(label) == 1).cast("double")).alias("p"), F.sum((F.col(label) == 0).cast("double")).alias("q"))
    w = Window.partitionBy(*by)
    return flat.withColumns({"p": F.col("p") / F.sum("p").over(w), "q": F.col("q") / F.sum("q").over(w)})


def total_variation(df: DataFrame, by: list[str], category: str, label: str = "y") -> DataFrame:
    return _shares(df, by, category, label).groupBy(*by).agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"))


def jensen_shannon(df: DataFrame, by: list[str], category: str, label: str = "y") -> DataFrame:
    p, q, e = F.col("p"), F.col("q"), F.lit(1e-12)
    m = (p + q) / 2
    term = p * F.log((p + e) / (m + e)) / 2 + q * F.log((q + e) / (m + e)) / 2
    return _shares(df, by, category, label).groupBy(*by).agg(F.sum(term).alias("js_divergence"))
