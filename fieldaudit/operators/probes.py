"""Contamination probes: columns that know the label or the future, to see whether a detector or a policy finds them.

Each takes a panel (row_id, dataset_id, entity_id, ts, y and features) and returns it with the probe's columns. strength 0 leaves the
prior (plus noise), 1 the whole signal.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.functions.draws import normal, several, uniform
from fieldaudit.operators.ledger import GateError
from fieldaudit.operators.order import positions, quantiles, small, sums_at

NOISE = 0.1
#: A panel with this column has its priors already: loo_prior(df, PRIOR) once, and probes after it don't aggregate the panel again.
PRIOR = "loo_prior"


def loo_prior(df: DataFrame, name: str = "prior") -> DataFrame:
    """The mean label of all other rows, 0.5 for a row alone."""
    if PRIOR in df.columns:
        return df.withColumn(name, F.col(PRIOR))
    total = df.agg(F.count("*").alias("_n"), F.sum("y").alias("_y")).checkpoint()
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("_n") > 1, (F.col("_y") - F.col("y")) / (F.col("_n") - 1)).otherwise(F.lit(0.5))).drop("_n", "_y")


def noise(probe: str, seed: int, std: float = NOISE, df: DataFrame | None = None) -> Column:
    """A normal number for each row; read from df where with_draws() has put it there."""
    own = f"{DRAWN}{probe}"
    return F.lit(std) * (F.col(own) if df is not None and own in df.columns else normal(str(seed), probe, F.col("row_id")))


def _chance(probe: str, seed: int, df: DataFrame) -> Column:
    own = f"{DRAWN}u_{probe}"
    return F.col(own) if own in df.columns else uniform(str(seed), probe, F.col("row_id"))


#: What begins the names of columns with draws that with_draws() has made.
DRAWN = "_drawn_"


def with_draws(df: DataFrame, seed: int, normals: list[str], uniforms: list[str]) -> DataFrame:
    """df with the draws that probes of this seed take, made once for all strengths; source_assignment() takes the uniform one M09u."""
    made = df.withColumn("_draws", several(str(seed), normals, uniforms, F.col("row_id")))
    names = [*normals, *(f"u_{name}" for name in uniforms)]
    return made.select(*df.columns, *(F.get("_draws", F.lit(i)).alias(f"{DRAWN}{name}") for i, name in enumerate(names)))


def label_copy(df: DataFrame, strength: float, seed: int) -> DataFrame:
    return df.withColumn("m01", F.when(_chance("M01", seed, df) < 0.5 * (1 - strength), 1 - F.col("y")).otherwise(F.col("y")).cast("double"))


def noisy_proxy(df: DataFrame, strength: float, seed: int, name: str = "m02", std: float = NOISE) -> DataFrame:
    return loo_prior(df, "_p").withColumn(name, F.lit(strength) * (F.col("y") - F.col("_p")) + noise(name, seed, std, df)).drop("_p")


def interaction(df: DataFrame, strength: float, seed: int, feature: str) -> DataFrame:
    """The label with its sign turned where the feature is below its median."""
    mid = quantiles(df, [], feature, [0.5]).select(F.get("q", F.lit(0)).alias("_mid"))
    side = F.when(F.col(feature) >= F.col("_mid"), F.lit(1.0)).otherwise(F.lit(-1.0))
    return df.crossJoin(F.broadcast(mid)).withColumn("m03", F.lit(strength) * (2 * F.col("y") - 1) * side + noise("m03", seed)).drop("_mid")


def future_window(df: DataFrame, skip: Column, width: Column, name: str, count: str) -> DataFrame:
    """df with the mean label of width rows from the skip-th strictly later one on, and how many there were; null and 0 without any.

    All rows of one time share a window, whose ends follow from the times' numbers of rows; the sums up to these ends are all that is made of
    the rows' prefix sums. A time is one row of the sides that are joined; they are broadcast where they are small.
    """
    rows = df.select("row_id", "ts", F.col("y").cast("long").alias("y")).where("ts IS NOT NULL")
    counts = rows.groupBy("ts").agg(F.count("*").alias("_c")).checkpoint()
    times = positions(counts, [F.col("ts")], F.date_trunc("hour", "ts"), {"_last": F.col("_c")}).crossJoin(F.broadcast(counts.agg(F.sum("_c").alias("_n"))))
    times = times.withColumns({"_skip": skip, "_width": width})
    times = times.withColumn("_from", F.least(F.col("_last") + F.greatest(F.lit(0), F.col("_skip") - 1), F.col("_n")))
    times = times.select("ts", "_n", "_from", F.least(F.col("_n"), F.col("_from") + F.col("_width")).alias("_to")).checkpoint()
    ends = times.select(F.col("_from").alias("pos")).union(times.select("_to")).distinct().checkpoint()
    sums = sums_at(rows, "y", ends).checkpoint()
    at = lambda end, name: small(sums).select(F.col("pos").alias(end), F.col("_sum").alias(name))
    times = times.join(at("_from", "_a"), "_from", "left").join(at("_to", "_b"), "_to", "left")
    n = F.col("_to") - F.col("_from")
    times = times.select("ts", F.when(n > 0, (F.col("_b") - F.coalesce("_a", F.lit(0))) / n).alias(name), n.cast("long").alias(count)).checkpoint()
    return df.join(small(times), "ts")


def future_mean(df: DataFrame, strength: float, seed: int, name: str = "m04", share: float = 0.05, ahead: bool = False, prior: float | None = None) -> DataFrame:
    """The mean label of the next rows in time, mixed with the prior; ahead: beginning a window's length later. prior: a constant, or None
    for the mean label of all other rows. Also name_count, the rows of each window."""
    n = F.col("_n")
    width = F.greatest(F.lit(2), F.greatest(F.lit(1), F.floor(n * share))) if ahead else F.greatest(F.lit(2), F.floor(n * share))
    skip = F.greatest(F.lit(1), F.floor(n * share)) if ahead else F.lit(1)
    out = future_window(loo_prior(df, "_p"), skip, width, "_f", f"{name}_count")
    p = F.lit(prior) if prior is not None else F.col("_p")
    return out.withColumn(name, p + F.lit(strength) * (F.coalesce("_f", p) - p) + noise(name, seed)).drop("_f", "_p")


def future_entity_rate(df: DataFrame, strength: float, seed: int, name: str = "m08", weight: float = 2.0, prior: float | None = None, std: float = NOISE) -> DataFrame:
    """The shrunk mean label of the entity's strictly later rows, mixed with the prior. Also name_count and name_rate.

    Rows of one time of an entity share a window, so they are counted first; an entity's times are summed up by buckets of a month like a whole
    table's, so an entity with very many rows is not one task's. Rows aren't ordered among themselves.
    """
    times = df.groupBy("entity_id", "ts", F.date_trunc("month", "ts").alias("_month")).agg(F.count("*").alias("_c"), F.sum("y").alias("_y"))
    months = times.groupBy("entity_id", "_month").agg(F.sum("_c").alias("_mc"), F.sum("_y").alias("_my"))
    after = Window.partitionBy("entity_id").orderBy("_month").rowsBetween(1, Window.unboundedFollowing)
    months = months.select("entity_id", "_month", *(F.coalesce(F.sum(f"_m{c}").over(after), F.lit(0)).alias(f"_m{c}") for c in "cy"))
    after = Window.partitionBy("entity_id", "_month").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    inner = times.select("entity_id", "ts", "_month", *(F.coalesce(F.sum(f"_{c}").over(after), F.lit(0)).alias(f"_{c}") for c in "cy"))
    later = inner.join(months, ["entity_id", "_month"]).select("entity_id", "ts", (F.col("_c") + F.col("_mc")).alias(f"{name}_count"), (F.col("_y") + F.col("_my")).alias("_later"))
    out = loo_prior(df, "_p").join(later, ["entity_id", "ts"])  # in this order: the priors' total is of df alone, without the join
    p, count = (F.lit(prior) if prior is not None else F.col("_p")), F.col(f"{name}_count")
    rate = F.when(count > 0, (F.col("_later") + weight * p) / (count + weight)).otherwise(p)
    return out.withColumn(f"{name}_rate", rate).withColumn(name, p + F.lit(strength) * (F.col(f"{name}_rate") - p) + noise(name, seed, std)).drop("_p", "_later")


def redundant(df: DataFrame, strength: float, seed: int, copies: int = 3) -> DataFrame:
    out = loo_prior(df, "_p")
    return out.withColumns({f"m06_{i}": F.lit(strength) * (F.col("y") - F.col("_p")) + noise(f"m06_{i}", seed, NOISE * (1 + i / copies), df) for i in range(copies)}).drop("_p")


def subgroup(df: DataFrame, strength: float, seed: int, prevalence: float = 0.3) -> DataFrame:
    inside = _chance("M07", seed, df) < prevalence
    return loo_prior(df, "_p").withColumn("m07", F.when(inside, F.lit(strength) * (F.col("y") - F.col("_p")) + noise("m07", seed, df=df)).otherwise(F.lit(0.0))).drop("_p")


#: The place of a row in its class, where it is among the first, which source_assignment() at any strength takes from a panel that has it.
PLACE = "m09_place"


def source_places(df: DataFrame, seed: int, least: int = 20) -> DataFrame:
    """df with the places of the first `least` rows of each class in hash order, null for later ones; each class must have so many rows, those
    that the sources are promised. Nothing else of the order is used, so it isn't made: each task passes on its first rows only."""
    sizes = {r.y: r.n for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if short := [y for y in (0, 1) if sizes.get(y, 0) < least]:
        raise GateError(f"classes {short} have fewer than {least} rows")
    key, first = F.md5(F.concat_ws("|", F.lit(f"{seed}M09"), "row_id")), None
    for y in (0, 1):
        own = df.where(F.col("y") == y).select("y", "row_id", key.alias("_key")).orderBy("_key", "row_id").limit(least)
        first = own if first is None else first.unionByName(own)
    first = first.checkpoint()
    order = Window.partitionBy("y").orderBy("_key", "row_id")  # the first rows of both classes
    first = first.select("row_id", F.row_number().over(order).alias(PLACE)).groupBy("row_id").agg(F.min(PLACE).alias(PLACE))
    return df.join(F.broadcast(first), "row_id", "left")


def source_assignment(df: DataFrame, strength: float, seed: int, sources: int = 4, least: int = 5) -> DataFrame:
    """m09_source, drawn with odds that depend on the label, and an indicator for each: the first rows of each class in hash order go round
    the sources so that each has at least so many; the numbers of the sources are shuffled. Raises where a class has too few rows for that,
    which is counted unless df has its places already (source_places() has counted them then)."""
    delta = [-1 + 2 * i / (sources - 1) for i in range(sources)]
    odds = {y: [math.exp((3 if y else -3) * strength * d) for d in delta] for y in (0, 1)}
    placed = df if PLACE in df.columns else source_places(df, seed, sources * least)
    u = _chance("M09u", seed, df)

    def drawn(y: int) -> Column:
        out, share = F.lit(sources - 1), 0.0
        edges = []
        for i in range(sources - 1):
            share += odds[y][i] / sum(odds[y])
            edges.append((i, share))
        for i, edge in reversed(edges):
            out = F.when(u < edge, F.lit(i)).otherwise(out)
        return out

    raw = F.when(F.col(PLACE) <= sources * least, F.pmod(F.col(PLACE) - 1, F.lit(sources)).cast("int")).otherwise(F.when(F.col("y") == 1, drawn(1)).otherwise(drawn(0)))
    order = sorted(range(sources), key=lambda i: (i * 7 + seed * 3) % (sources + 1))
    named = F.element_at(F.array(*(F.lit(order.index(i)) for i in range(sources))), (raw + 1).cast("int"))
    out = placed.withColumn("m09_source", named)
    out = out if PLACE in df.columns else out.drop(PLACE)
    return out.withColumns({f"m09_{i}": (F.col("m09_source") == i).cast("int") for i in range(sources)})


def mixed_group(df: DataFrame, strength: float, seed: int, feature: str) -> DataFrame:
    """A legitimate copy of a feature and a proxy, one group."""
    return noisy_proxy(df.withColumn("m10_copy", F.col(feature)), strength, seed, "m10")


def projection_weights(seed: int, k: int) -> list[float]:
    """k weights that follow from the seed like draws from a normal distribution, of either sign."""
    draw = lambda i, part: (int(hashlib.md5(f"{seed}|M11|{part}|{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    return [math.sqrt(-2 * math.log(draw(i, "r"))) * math.cos(2 * math.pi * draw(i, "a")) for i in range(k)]


def projections(df: DataFrame, strength: float, seed: int, k: int = 3) -> DataFrame:
    """k columns that each hold the label, weighted by projection_weights()."""
    weights = projection_weights(seed, k)
    return loo_prior(df, "_p").withColumns({f"m11_{i}": F.lit(strength * w) * (F.col("y") - F.col("_p")) + noise(f"m11_{i}", seed, df=df) for i, w in enumerate(weights)}).drop("_p")


def complete_graph(columns: DataFrame, group: str) -> DataFrame:
    """src, dst, weight: all pairs of the columns (feature_id, position, group_id) of a group."""
    a, b = columns.where(F.col("group_id") == group).alias("a"), columns.where(F.col("group_id") == group).alias("b")
    return a.join(b, F.col("a.position") < F.col("b.position")).select(F.col("a.feature_id").alias("src"), F.col("b.feature_id").alias("dst"), F.lit(1.0).alias("weight"))


def compose(df: DataFrame, *probes) -> DataFrame:
    """df with the columns of several probes (functions of a panel), which share one computation of the priors."""
    had = PRIOR in df.columns
    df = loo_prior(df, PRIOR)
    for probe in probes:
        df = probe(df)
    return df if had else df.drop(PRIOR)


def same_base(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the base columns that differ: none if a probe left them alone."""
    both = before.select(*columns, F.lit(1).alias("_d")).union(after.select(*columns, F.lit(-1)))  # each side is read once
    left = both.groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    each = left.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_d"))))
    return each.select(*columns, F.when(F.col("_d") > 0, "before").otherwise("after").alias("side"))


