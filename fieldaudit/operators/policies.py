"""Removal policies over a table of column scores (cell, feature_id, position, score, group_id ..): each adds a removed flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget(share: float | Column, n: Column, rule: str = "ceil_one") -> Column:
    """Columns that a share of n allows: ceil_one is at least one unless the share is 0, ceil is plain, half_even rounds and is at least one."""
    s = F.lit(share) if isinstance(share, float) else share
    product = F.round(s * n, 9)
    if rule == "ceil":
        return F.ceil(product).cast("int")
    if rule == "half_even":
        return F.greatest(F.lit(1), F.bround(product).cast("int"))
    return F.when(s == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(product).cast("int")))


def keep_all(df: DataFrame) -> DataFrame:
    return df.withColumn("removed", F.lit(False))


def oracle(df: DataFrame, truth: str = "is_leak") -> DataFrame:
    return df.withColumn("removed", F.col(truth))


def fields(df: DataFrame, by: list[str], share: float, rule: str = "ceil_one", score: str = "score", tie: str = "position") -> DataFrame:
    """The columns of highest score, as many as the budget allows; among equals the later position."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie).desc()))
    return df.withColumn("removed", rank <= budget(share, F.count("*").over(w), rule))


def groups(df: DataFrame, by: list[str], share: float, rule: str = "ceil_one", score: str = "score", singles: bool = False) -> DataFrame:
    """Whole groups by their highest member, as many groups as the budget allows; ties: the later name. A column without a group stays, or,
    with singles, is a group of its own."""
    unit = df.withColumn("_unit", F.coalesce("group_id", "feature_id") if singles else F.col("group_id"))
    best = unit.where("_unit IS NOT NULL").groupBy(*by, "_unit").agg(F.max(score).alias("_best"))
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.col("_best").desc(), F.col("_unit").desc()))
    chosen = best.withColumn("removed", rank <= budget(share, F.count("*").over(w), rule)).drop("_best")
    return unit.join(chosen, [*by, "_unit"], "left").withColumn("removed", F.coalesce("removed", F.lit(False))).drop("_unit")


def threshold(df: DataFrame, t: float, score: str = "score") -> DataFrame:
    return df.withColumn("removed", F.col(score) > t)


def applicable(columns: DataFrame, by: list[str], edges: DataFrame | None = None) -> DataFrame:
    """by, policy, status: NOT_APPLICABLE for the oracle where no column is known to leak, for a group budget where no column has a group and
    for a graph cut where no edge (by, src, dst) joins two columns of the cell; else APPLICABLE."""
    any_ = columns.groupBy(*by).agg(F.max(F.coalesce(F.col("is_leak"), F.lit(False))).alias("oracle"), F.max(F.col("group_id").isNotNull()).alias("group_budget"))
    if edges is None:
        joined = any_.withColumn("graph_cut", F.lit(False))
    else:
        own = columns.select(*by, "feature_id")
        ends = edges.join(own.withColumnRenamed("feature_id", "src"), [*by, "src"], "left_semi").join(own.withColumnRenamed("feature_id", "dst"), [*by, "dst"], "left_semi")
        joined = any_.join(ends.select(*by).distinct().withColumn("graph_cut", F.lit(True)), by, "left")
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.when(F.coalesce(F.col(p), F.lit(False)), "APPLICABLE").otherwise("NOT_APPLICABLE").alias("status")) for p in ("oracle", "group_budget", "graph_cut"))))
    return joined.select(*by, each.alias("_p")).select(*by, "_p.*")


# The stages of a record's life that come after its outcome
LATE = ("post_outcome", "future_window", "repayment", "closed")


def lifecycle(df: DataFrame, by: list[str], share: float | None = None, score: str = "score", late: tuple[str, ...] = LATE) -> DataFrame:
    """Columns of a late stage, not available, descended from the outcome or from a later table; with a share, those first and then by score, up to the budget."""
    bad = F.col("lifecycle").isin(*late) | ~F.col("available") | F.col("outcome_descendant") | F.col("post_event_table")
    if share is None:
        return df.withColumn("removed", bad)
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(bad.desc(), F.col(score).desc(), F.col("position").desc()))
    return df.withColumn("removed", rank <= budget(share, F.count("*").over(w)))


def random(df: DataFrame, by: list[str], share: float, seed: int, rule: str = "ceil_one") -> DataFrame:
    """As many columns as the budget allows by a hash of seed, cell and column: the cost of fields() without its choice."""
    w = Window.partitionBy(*by)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by), "feature_id"))
    return df.withColumn("removed", F.row_number().over(w.orderBy(h, "feature_id")) <= budget(share, F.count("*").over(w), rule))


AUDITS = ("no_removal", "auto_quarantine", "remove_all_oracle", "random_matched")


def audit(df: DataFrame, by: list[str], share: float, seed: int, truth: str = "is_leak") -> DataFrame:
    """A row of df for each of the policies AUDITS with removed: nothing, the columns of highest score within the budget, all that are known to
    leak, and as many as the budget by a hash. A column's row is ranked once for all of them."""
    flags = fields(df, by, share, "ceil").withColumnRenamed("removed", "_top")
    flags = random(flags, by, share, seed, "ceil").withColumnRenamed("removed", "_any")
    of = dict(zip(AUDITS, (F.lit(False), F.col("_top"), F.coalesce(F.col(truth), F.lit(False)), F.col("_any"))))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), c.alias("removed")) for p, c in of.items())))
    return flags.withColumn("_p", each).select(*df.columns, "_p.*")


def random_seeds(df: DataFrame, by: list[str], share: float, seeds: list[int], rule: str = "ceil_one") -> DataFrame:
    """A row of df for each seed with removed as random() gives it for that seed."""
    each = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    w = Window.partitionBy(*by, "seed")
    h = F.md5(F.concat_ws("|", F.col("seed").cast("string"), *(F.col(c).cast("string") for c in by), "feature_id"))
    return each.withColumn("removed", F.row_number().over(w.orderBy(h, "feature_id")) <= budget(share, F.count("*").over(w), rule))


def labelled_components(edges: DataFrame) -> DataFrame:
    """(feature_id, component) of the columns that edges (src, dst) touch: the smallest feature_id that edges lead to.

    Each round takes over the smallest label next door and that label's own label; it ends when a round changes nothing.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct().checkpoint()
    label = both.select("a", F.col("a").alias("component")).distinct().checkpoint()
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, "a").select("a", F.least("component", "near").alias("component"))
        jump = step.select(F.col("a").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component").select("a", F.col("further").alias("component")).checkpoint()
        same = step.join(label.withColumnRenamed("component", "old"), "a").where("component <> old").isEmpty()
        label = step
        if same:
            return label.withColumnRenamed("a", "feature_id")


def graph_cut(df: DataFrame, edges: DataFrame, share: float, score: str = "score") -> DataFrame:
    """Whole components of the columns' graph by their highest member, as many components as the budget allows; ties: the one of the first column.

    df has cell, feature_id, position and score. A column without an edge is in no component and stays.
    """
    df = df.join(F.broadcast(labelled_components(edges)), "feature_id", "left")
    best = df.where("component IS NOT NULL").groupBy("cell", "component").agg(F.max(score).alias("_best"), F.min("position").alias("_first"))
    w = Window.partitionBy("cell")
    rank = F.row_number().over(w.orderBy(F.col("_best").desc(), "_first"))
    best = best.withColumn("removed", rank <= budget(share, F.count("*").over(w))).select("cell", "component", "removed")
    return df.join(best, ["cell", "component"], "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def result(df: DataFrame, by: list[str], truth: str = "is_leak") -> DataFrame:
    """Per cell: kept and quarantined columns in order, how many to review, recall, false quarantine rate and retention."""
    r, t = F.col("removed"), F.col(truth)
    n = lambda c: F.sum(c.cast("int"))
    return df.groupBy(*by).agg(
        F.array_join(F.sort_array(F.collect_list(F.when(~r, F.col("feature_id")))), ",").alias("kept"), F.array_join(F.sort_array(F.collect_list(F.when(r, F.col("feature_id")))), ",").alias("quarantined"),
        n(r).alias("review_units"), (n(r & t) / F.greatest(F.lit(1), n(t))).alias("recall"), (n(r & ~t) / F.greatest(F.lit(1), n(~t))).alias("false_quarantine_rate"),
        (n(~r & ~t) / F.greatest(F.lit(1), n(~t))).alias("retention"),
    )


def unique_budgets(cells: DataFrame, shares: list[float], n: str = "n_columns") -> DataFrame:
    """A row per cell and share with k and the smallest share of the same k: what need not be fitted again."""
    each = cells.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("k", budget(F.col("share"), F.col(n), "half_even"))
    keys = [c for c in cells.columns if c != n]
    return each.withColumn("fitted_share", F.min("share").over(Window.partitionBy(*keys, "k")))


def digest(df: DataFrame, by: list[str], unit: str) -> DataFrame:
    """by, digest: a hash of the unit's name and the positions removed, in order: the same for the same choice."""
    chosen = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("position")))), lambda x: x.cast("string")), ",")
    return df.groupBy(*by).agg(F.sha2(F.concat(F.lit(f"{unit}|"), chosen), 256).alias("digest"))
