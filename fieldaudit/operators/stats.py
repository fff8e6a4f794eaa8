"""Resampling statistics on ledgers: replicates are rows, so any number of them is one job; draws are hashes, so they repeat anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldaudit.functions.draws import pick, uniform
from fieldaudit.operators.metrics import pearson
from fieldaudit.operators.order import small


def numbered(units: DataFrame, key: str, name: str = "unit") -> DataFrame:
    """units with a number from 0 in the order of key; units are the clusters of a ledger, some hundreds at most."""
    return units.withColumn(name, F.row_number().over(Window.orderBy(key)) - 1)


def draws(spark: SparkSession, reps: int, n: int, seed: int) -> DataFrame:
    """rep, slot, unit: n units drawn with replacement for each replicate."""
    slots = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    return slots.withColumn("unit", pick(n, str(seed), F.col("rep"), F.col("slot")))


def interval(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """by, boot_mean, low, high, p_positive, p_two_sided of replicates."""
    tail = (1 - level) / 2
    p = F.avg((F.col(value) > 0).cast("int"))
    return df.groupBy(*by).agg(
        F.avg(value).alias("boot_mean"), F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), p.alias("p_positive"),
        F.least(F.lit(1.0), 2 * F.least(p, 1 - p)).alias("p_two_sided"),
    )


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, reps: int, seed: int) -> DataFrame:
    """rep, stat: the mean over all rows of drawn clusters, so that large clusters count for more. Only sums and counts are drawn."""
    units = numbered(df.groupBy(cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n")), cluster)
    n = units.count()
    return draws(df.sparkSession, reps, n, seed).join(small(units), "unit").groupBy("rep").agg((F.sum("_s") / F.sum("_n")).alias("stat"))


def unit_bootstrap(df: DataFrame, unit: str, value: str, by: list[str], reps: int, seed: int) -> DataFrame:
    """by, rep, stat: the mean of drawn units' means; all groups of by share one draw, so their differences are paired."""
    means = df.groupBy(unit, *by).agg(F.avg(value).alias("_m"))
    units = numbered(means.select(unit).distinct(), unit)
    n = units.count()
    drawn = draws(df.sparkSession, reps, n, seed).join(small(units), "unit")
    return drawn.join(means, unit).groupBy(*by, "rep").agg(F.avg("_m").alias("stat"))


def nested_bootstrap(df: DataFrame, outer: str, inner: str, value: str, by: list[str], reps: int, seed: int) -> DataFrame:
    """by, rep, stat: outer units are drawn, and within each drawn one its inner units; by stays paired."""
    cells = df.groupBy(outer, inner, *by).agg(F.avg(value).alias("_m"))
    units = numbered(cells.select(outer).distinct(), outer)
    inners = cells.select(outer, inner).distinct()
    inners = inners.withColumns({"_in": F.row_number().over(Window.partitionBy(outer).orderBy(inner)) - 1, "_of": F.count("*").over(Window.partitionBy(outer))})
    n = units.count()
    drawn = draws(df.sparkSession, reps, n, seed).join(small(units), "unit").join(small(inners.select(outer, "_of").distinct()), outer)
    drawn = drawn.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_of").cast("int") - 1)))
    drawn = drawn.withColumn("_in", F.floor(uniform(str(seed), "in", F.col("rep"), F.col("slot"), F.col("_k")) * F.col("_of")).cast("int"))
    return drawn.join(small(inners.select(outer, inner, "_in")), [outer, "_in"]).join(cells, [outer, inner]).groupBy(*by, "rep").agg(F.avg("_m").alias("stat"))


def outer_bootstrap(store: DataFrame, outer: str, inner: str, draw: str, value: str, by: list[str], reps: int, seed: int) -> DataFrame:
    """rep, stat: means over drawn outer units, drawn inner units within each, and for each of these one stored inner draw.

    store has a value for each outer and inner unit, draw and group of by (such as a strength); for every group a draw of its own is taken, and
    groups count alike. Draws without a value are not in the store, so they are addressed by their place among those that are.
    """
    cell = [outer, inner, *by]
    placed = store.withColumns({"_k": F.row_number().over(Window.partitionBy(*cell).orderBy(draw)) - 1, "_nk": F.count("*").over(Window.partitionBy(*cell))})
    units = numbered(store.select(outer).distinct(), outer)
    inners = placed.select(*cell, "_nk").distinct()
    known = inners.select(outer, inner).distinct().withColumns({"_j": F.row_number().over(Window.partitionBy(outer).orderBy(inner)) - 1, "_ns": F.count("*").over(Window.partitionBy(outer))})
    drawn = draws(store.sparkSession, reps, units.count(), seed).join(small(units), "unit").join(small(known.select(outer, "_ns").distinct()), outer)
    drawn = drawn.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_ns").cast("int") - 1)))
    at = lambda n, name, *more: F.floor(uniform(str(seed), name, F.col("rep"), F.col("slot"), F.col("_i"), *more) * n).cast("long")
    drawn = drawn.withColumn("_j", at(F.col("_ns"), "in")).join(small(known.drop("_ns")), [outer, "_j"]).join(small(inners), [outer, inner])
    drawn = drawn.withColumn("_k", at(F.col("_nk"), "inner", *map(F.col, by)))
    return drawn.join(placed.select(*cell, "_k", value), [*cell, "_k"]).groupBy("rep").agg(F.avg(value).alias("stat"))


def left_out_r2(df: DataFrame, category: str, x: str, y: str) -> DataFrame:
    """n, r2_category, r2_both: R2 of the predictions that each row gets from the fit to all others, by category and by category and x.

    A left-out residual is the residual over one less the row's leverage, so two passes of sums take the place of a fit for each row.
    """
    mean = df.groupBy(category).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count("*").alias("_c"))
    rows = df.join(F.broadcast(mean), category).select("_c", F.col(y).alias("_y"), (F.col(x) - F.col("_mx")).alias("_u"), (F.col(y) - F.col("_my")).alias("_v"))
    sums = rows.agg(F.sum(F.col("_u") * F.col("_u")).alias("_uu"), F.sum(F.col("_u") * F.col("_v")).alias("_uv"), (F.var_pop("_y") * F.count("*")).alias("_all"))
    rows = rows.crossJoin(F.broadcast(sums))
    one = F.col("_v") / (1 - 1 / F.col("_c"))
    both = (F.col("_v") - F.col("_u") * F.col("_uv") / F.col("_uu")) / (1 - 1 / F.col("_c") - F.col("_u") * F.col("_u") / F.col("_uu"))
    return rows.agg(F.count("*").alias("n"), (1 - F.sum(one * one) / F.first("_all")).alias("r2_category"), (1 - F.sum(both * both) / F.first("_all")).alias("r2_both"))


def exact_sign_flip(df: DataFrame, by: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """by, n, mean, p: the share of all 2^n sign patterns of a group's values (24 at most) whose mean is as far from 0 as the observed."""
    groups = df.groupBy(*by).agg(F.collect_list(value).alias("_v"))
    patterns = groups.withColumn("_bits", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.size("_v")).cast("long") - 1)))
    total = F.aggregate(F.transform("_v", lambda v, i: F.when(F.col("_bits").bitwiseAND(F.pow(F.lit(2.0), i).cast("long")) != 0, v).otherwise(-v)), F.lit(0.0), lambda a, v: a + v)
    seen = F.abs(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v))
    return patterns.groupBy(*by).agg(F.first(F.size("_v")).alias("n"), F.first(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v) / F.size("_v")).alias("mean"), F.avg((F.abs(total) >= seen - tolerance).cast("int")).alias("p"))


def halved_sign_flip(df: DataFrame, by: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """exact_sign_flip for up to 40 values a group: sums of all patterns of either half, and by search how many of their pairs are far enough."""

    def run(group):
        v = np.array([x for x in group.column("_v").to_pylist() if x is not None])
        if len(v) > 40:
            raise ValueError(f"{len(v)} values in a group, 40 at most")
        sums = []
        for half in (v[: len(v) // 2], v[len(v) // 2 :]):
            s = np.zeros(1)
            for x in half:
                s = np.concatenate([s - x, s + x])
            sums.append(np.sort(s))
        far = abs(v.sum()) - tolerance
        high = len(sums[1]) - np.searchsorted(sums[1], far - sums[0], "left")
        low = np.searchsorted(sums[1], -far - sums[0], "right")
        p = 1.0 if far <= 0 else float((high + low).sum()) / 2.0 ** len(v)
        return pa.table({**{c: group.column(c).slice(0, 1) for c in by}, "n": pa.array([len(v)], pa.int32()), "mean": pa.array([v.mean() if len(v) else None], pa.float64()), "p": pa.array([p])})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, F.col(value).alias("_v")).groupBy(*by).applyInArrow(run, f"{kinds}, n int, mean double, p double")


def sampled_sign_flip(df: DataFrame, unit: str, value: str, reps: int, seed: int) -> DataFrame:
    """mean, p with one added to both counts, by signs drawn for each replicate and unit."""
    spark = df.sparkSession
    flips = spark.range(reps).select(F.col("id").alias("rep")).crossJoin(F.broadcast(df.select(unit, value)))
    stat = flips.withColumn("_s", F.when(uniform(str(seed), F.col("rep"), F.col(unit)) < 0.5, F.col(value)).otherwise(-F.col(value))).groupBy("rep").agg(F.avg("_s").alias("_s"))
    seen = df.agg(F.avg(value).alias("mean"))
    return stat.crossJoin(F.broadcast(seen)).groupBy("mean").agg(((F.sum((F.abs("_s") >= F.abs("mean") - 1e-12).cast("int")) + 1) / F.lit(reps + 1)).alias("p"))


def holm(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """df with p_holm: step-down adjusted within each family."""
    w = Window.partitionBy(*(by or []))
    rank, m = F.row_number().over(w.orderBy(p)), F.count("*").over(w)
    out = df.withColumn("_a", (m - rank + 1) * F.col(p))
    return out.withColumn("p_holm", F.least(F.lit(1.0), F.max("_a").over(w.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)))).drop("_a")


def correlations(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, pearson, spearman (of mean ranks), cosine."""
    from fieldaudit.operators.ledger import average_rank

    by = by or []
    ranked = df.withColumns({"_x": average_rank(by, x), "_y": average_rank(by, y)})
    cos = F.sum(F.col(x) * F.col(y)) / F.sqrt(F.sum(F.col(x) * F.col(x)) * F.sum(F.col(y) * F.col(y)))
    return ranked.groupBy(*by).agg(pearson(x, y).alias("pearson"), pearson("_x", "_y").alias("spearman"), cos.alias("cosine"))


def kendall(df: DataFrame, item: str, x: str, y: str) -> DataFrame:
    """tau_b over pairs of items: for summary tables of some hundred items."""
    a = df.select(F.col(item).alias("i"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = df.select(F.col(item).alias("j"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    s, t = F.signum(F.col("x1") - F.col("x2")), F.signum(F.col("y1") - F.col("y2"))
    both = a.join(b, F.col("i") < F.col("j")).select(s.alias("s"), t.alias("t"))
    return both.agg((F.sum(F.col("s") * F.col("t")) / F.sqrt(F.sum(F.abs("s")) * F.sum(F.abs("t")))).alias("tau_b"))


def concordance(df: DataFrame, rater: str, item: str, value: str) -> DataFrame:
    """n_raters, n_items, kendall_w of the raters' rankings of the items."""
    from fieldaudit.operators.ledger import average_rank

    total = df.withColumn("_r", average_rank([rater], value)).groupBy(item).agg(F.sum("_r").alias("_t"), F.count("*").alias("_m"))
    out = total.agg(F.count("*").alias("n_items"), F.first("_m").alias("n_raters"), (F.var_pop("_t") * F.count("*")).alias("_s"))
    m, n = F.col("n_raters"), F.col("n_items")
    return out.select("n_raters", "n_items", (12 * F.col("_s") / (m * m * (n * n * n - n))).alias("kendall_w"))


def regression(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, slope, intercept, r2 of a simple least-squares line."""
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def category_r2(df: DataFrame, category: str, x: str, y: str) -> DataFrame:
    """r2 of y on the category alone, on category and x, and the increment: x and y centred within categories (Frisch and Waugh)."""
    w = Window.partitionBy(category)
    c = df.withColumns({"_x": F.col(x) - F.avg(x).over(w), "_y": F.col(y) - F.avg(y).over(w)})
    s = c.agg(F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), (F.var_pop(y) * F.count("*")).alias("all"))
    first, both = 1 - F.col("yy") / F.col("all"), 1 - (F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")) / F.col("all")
    return s.select(first.alias("r2_category"), both.alias("r2_both"), (both - first).alias("r2_increment"), (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("partial_correlation"))


def cooks_distance(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with cook: how far a point moves the line, by residual, leverage and residual variance."""
    s = df.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(x).alias("_m"), (F.var_pop(x) * F.count("*")).alias("_sxx"), F.count("*").alias("_n"))
    d = df.crossJoin(F.broadcast(s)).withColumn("_e", F.col(y) - F.col("_a") - F.col("_b") * F.col(x))
    d = d.crossJoin(F.broadcast(d.agg((F.sum(F.col("_e") * F.col("_e")) / (F.count("*") - 2)).alias("_s2"))))
    h = 1 / F.col("_n") + (F.col(x) - F.col("_m")) * (F.col(x) - F.col("_m")) / F.col("_sxx")
    return d.withColumn("cook", F.col("_e") * F.col("_e") / (2 * F.col("_s2")) * h / ((1 - h) * (1 - h))).drop("_b", "_a", "_m", "_sxx", "_n", "_e", "_s2")


def dose_slope(df: DataFrame, by: list[str], level: str, value: str) -> DataFrame:
    """by, slope: of the value over standardised levels."""
    w = Window.partitionBy(*by)
    z = (F.col(level) - F.avg(level).over(w)) / F.stddev_pop(level).over(w)
    return df.withColumn("_z", z).groupBy(*by).agg(F.avg(F.col("_z") * F.col(value)).alias("slope"))


def dose_response(point: DataFrame, replicates: DataFrame, by: list[str], level: str, value: str, stat: str = "stat", rep: str = "rep") -> DataFrame:
    """by, slope, low, high, p, p_holm, positive_steps, steps: the value over standardised levels, its interval over replicates, twice the smaller
    share of replicates on one side of 0 (0 counts for both), adjusted over all rows, and how many neighbouring levels rise.

    point has a value for each group and level, replicates a stat for each of them and replicate; both are as few as a plan's cells.
    """
    drawn = dose_slope(replicates, [*by, rep], level, stat)
    share = lambda c: F.avg(c.cast("int"))
    p = F.least(F.lit(1.0), 2 * F.least(share(F.col("slope") <= 0), share(F.col("slope") >= 0)))
    spread = drawn.groupBy(*by).agg(F.percentile("slope", F.lit(0.025)).alias("low"), F.percentile("slope", F.lit(0.975)).alias("high"), p.alias("p"))
    rise = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(level))
    steps = point.withColumn("_up", rise).groupBy(*by).agg(F.sum(F.coalesce((F.col("_up") > 0).cast("int"), F.lit(0))).alias("positive_steps"), F.count("_up").alias("steps"))
    return holm(dose_slope(point, by, level, value).join(spread, by).join(steps, by), "p")




def permuted_increment(df: DataFrame, category: str, item: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """n_reps, r2_increment, p: what x adds to R2 over the category, and how often it adds as much where x is dealt out anew within each.

    Within a category both sides are centred, so a replicate is one sum of products; items are as few as a ledger has.
    """
    w = Window.partitionBy(category)
    rows = df.select(category, item, F.col(y).alias("_y"), (F.col(x) - F.avg(x).over(w)).alias("_u"), (F.col(y) - F.avg(y).over(w)).alias("_v"), F.row_number().over(w.orderBy(item)).alias("_k"))
    reps_ = df.sparkSession.range(reps).withColumnRenamed("id", "rep")
    shuffled = rows.select(category, item, "_u").crossJoin(F.broadcast(reps_)).withColumn("_h", uniform(str(seed), "perm", F.col("rep"), F.col(item)))
    shuffled = shuffled.select("rep", category, F.col("_u"), F.row_number().over(Window.partitionBy("rep", category).orderBy("_h", item)).alias("_k"))
    null = shuffled.join(rows.select(category, "_k", "_v"), [category, "_k"]).groupBy("rep").agg(F.sum(F.col("_u") * F.col("_v")).alias("_null"))
    seen = rows.agg(F.sum(F.col("_u") * F.col("_v")).alias("_uv"), F.sum(F.col("_u") * F.col("_u")).alias("_uu"), (F.var_pop("_y") * F.count("*")).alias("_all"))
    far = (F.col("_null") * F.col("_null") >= F.col("_uv") * F.col("_uv") - 1e-12).cast("int")
    return null.crossJoin(F.broadcast(seen)).agg(F.count("*").alias("n_reps"), F.first(F.col("_uv") * F.col("_uv") / F.col("_uu") / F.col("_all")).alias("r2_increment"), ((1 + F.sum(far)) / (F.count("*") + 1)).alias("p"))
