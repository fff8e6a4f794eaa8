"""Exact positions and prefix sums over whole tables without a window over the whole table, and what follows from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, order: list[Column], bucket: Column, sums: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """df with pos (from 1, in the given order) and running sums, exact over the whole table, or within each group of the columns by.

    bucket must not fall along the order (a day of the time ordered by, a prefix of a hash): rows are numbered within buckets, and the
    buckets' totals, one row each, are summed along. No task gets more than the rows of a bucket.
    """
    by, sums = by or [], sums or {}
    w = Window.partitionBy(*by, "_bucket").orderBy(*order)
    df = df.withColumn("_bucket", bucket).withColumns({f"_x_{k}": v for k, v in sums.items()})
    inner = df.withColumns({"_n": F.row_number().over(w)} | {f"_s_{k}": F.sum(f"_x_{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in sums})
    total = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"), *(F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums))
    along = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*by, "_bucket", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"), *(F.coalesce(F.sum(f"_t_{k}").over(along), F.lit(0)).alias(f"_b_{k}") for k in sums))
    out = inner.join(before, [*by, "_bucket"])
    out = out.withColumns({"pos": F.col("_before") + F.col("_n")} | {k: F.col(f"_b_{k}") + F.col(f"_s_{k}") for k in sums})
    return out.drop("_bucket", "_before", "_n", *(f"_{p}_{k}" for p in "xsb" for k in sums))


#: Rows that are broadcast at most, of a few numbers each; larger sides are joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (narrow and already computed) marked for broadcast if it has few enough rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame) -> DataFrame:
    """df from Parquet in the shared folder: a wide table's columns are packed there, where a checkpoint's rows take eight bytes a value."""
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with _part, which never falls along the order: ranges of about equal counts, as many as shuffles have partitions.

    Spark samples the ranges, so the result is checkpointed: every reader sees the same ones. Rows should differ in the order's columns, as
    equal ones share a part.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint()


def _before(parted: DataFrame, by: list[str], rows: Column) -> DataFrame:
    """by, _part, _rows, _before, _all: rows of each part of a group, of its earlier parts and of all of them. A group has at most as many rows here as there are parts."""
    total = parted.groupBy(*by, "_part").agg(F.sum(rows).alias("_rows"))
    along, whole = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    return total.select("*", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("_all"))


def ranked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with pos, from 1 within each group in an order without ties. Ranges of the order are numbered by themselves and moved on by the rows
    before them, so neither a group nor a value of the order's first column has to fit in a task."""
    one = by or ["_one"]
    df = df if by else df.withColumn("_one", F.lit(1))
    parted = parts(df, [*map(F.col, one), *order])
    inner = parted.withColumn("_n", F.row_number().over(Window.partitionBy(*one, "_part").orderBy(*order)))
    out = inner.join(_before(parted, one, F.lit(1)).drop("_rows", "_all"), [*one, "_part"]).withColumn("pos", F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")
    return out if by else out.drop("_one")


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float], weight: str | None = None) -> DataFrame:
    """by, q: exact quantiles of a column's values that aren't null, linear between neighbours, as an array in the order of at. weight: how
    many rows a row stands for.

    Different values are counted, put in ranges and ranked through the ranges' totals; only the ranges that hold a wanted rank are then
    numbered. No buffer holds a group's values, and a value of very many rows is one row.
    """
    one = by or ["_one"]
    df = df if by else df.withColumn("_one", F.lit(1))
    flat = df.where(F.col(value).isNotNull()).groupBy(*one, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    parted = parts(flat, [*map(F.col, one), F.col("_v")])
    before = _before(parted, one, F.col("_c"))
    place = lambda p, end: end((F.col("_all") - 1) * F.lit(float(p))).cast("long")
    wanted = F.array(*(F.struct(F.lit(2 * i + j).alias("k"), place(p, end).alias("r")) for i, p in enumerate(at) for j, end in enumerate((F.floor, F.ceil))))
    asked = before.withColumn("_w", F.explode(F.filter(wanted, lambda w: (w["r"] >= F.col("_before")) & (w["r"] < F.col("_before") + F.col("_rows")))))
    asked = asked.groupBy(*one, "_part").agg(F.first("_before").alias("_before"), F.first("_all").alias("_all"), F.collect_list("_w").alias("_w"))
    inner = parted.join(asked, [*one, "_part"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*one, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hits = inner.withColumn("_to", upto).withColumn("_w", F.explode(F.filter("_w", lambda w: (w["r"] < F.col("_to")) & (w["r"] >= F.col("_to") - F.col("_c")))))
    ends = hits.groupBy(*one).agg(F.first("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_w.k", "_v"))).alias("_m"))

    def between(i: int, p: float) -> Column:
        h = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.element_at("_m", F.lit(2 * i)), F.element_at("_m", F.lit(2 * i + 1))
        return F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return ends.select(*by, F.array(*(between(i, p) for i, p in enumerate(at))).alias("q"))


def by_time(df: DataFrame, sums: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """positions() in the order of (ts, row_id), in buckets of an hour: rows of one time can't be parted."""
    return positions(df, [F.col("ts"), F.col("row_id")], F.date_trunc("hour", "ts"), sums, by)


def sums_at(df: DataFrame, value: str, ends: DataFrame) -> DataFrame:
    """pos, _sum: the sum of a column over the first pos rows of df (ts, row_id and the column; no null times) in the order of (ts, row_id), for
    each pos in ends (from 1) that df has.

    Rows are counted by time and the first character of row_id. Only the cells that a wanted position falls into are numbered row by row; the
    others aren't shuffled.
    """
    first = F.substring("row_id", 1, 1) if dict(df.dtypes)["row_id"] == "string" else F.lit("")
    df = df.withColumn("_first", first)
    cells = df.groupBy("ts", "_first").agg(F.count("*").alias("_rows"), F.sum(value).alias("_own")).checkpoint()
    told = cells.agg(F.count("*"), F.sum("_rows")).first()
    step = F.lit(max(1, (told[1] or 0) // max(1, told[0])))  # as many chunks of positions as cells
    placed = positions(cells, [F.col("ts"), F.col("_first")], F.date_trunc("hour", "ts"), {"_to": F.col("_rows"), "_upto": F.coalesce("_own", F.lit(0))}).withColumn("_from", F.col("_to") - F.col("_rows"))
    placed = placed.select("ts", "_first", "_from", "_to", "_own", "_upto", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))).alias("_chunk"))
    asked = ends.where("pos > 0").select("pos", F.floor((F.col("pos") - 1) / step).alias("_chunk")).join(placed, "_chunk").where("pos > _from AND pos <= _to").checkpoint()
    inside = asked.where("pos < _to").select("ts", "_first", "pos", (F.col("pos") - F.col("_from")).alias("_n"), (F.col("_upto") - F.coalesce("_own", F.lit(0))).alias("_before")).checkpoint()
    w = Window.partitionBy("ts", "_first").orderBy("row_id")
    near = df.join(small(inside.select("ts", "_first").distinct()), ["ts", "_first"], "left_semi")
    near = near.select("ts", "_first", F.row_number().over(w).alias("_n"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_own"))
    within = near.join(small(inside), ["ts", "_first", "_n"]).select("pos", (F.col("_before") + F.coalesce("_own", F.lit(0))).alias("_sum"))
    return asked.where("pos = _to").select("pos", F.col("_upto").alias("_sum")).union(within)


def by_hash(df: DataFrame, key: Column, by: list[str] | None = None) -> DataFrame:
    """positions() in the order of a hash (hex digits), ties by row_id, in 4,096 buckets of like size."""
    return positions(df.withColumn("_key", key), [F.col("_key"), F.col("row_id")], F.substring("_key", 1, 3), by=by).drop("_key")


def with_count(df: DataFrame, name: str = "n", by: list[str] | None = None) -> DataFrame:
    """df with the number of its rows, or of its group's."""
    if by:
        return df.join(df.groupBy(*by).agg(F.count("*").alias(name)), by)
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def time_split(df: DataFrame, cuts: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """df with split: train, validation and test by position in time order; a time may straddle a cut."""
    return _split(df, ["ts", "row_id"], F.date_trunc("hour", "ts"), cuts)


def random_split(df: DataFrame, seed: int, cuts: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """df with split by position in the order of a hash of seed and row."""
    keyed = df.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), "row_id")))
    return _split(keyed, ["_key", "row_id"], F.substring("_key", 1, 3), cuts).drop("_key")


def _split(df: DataFrame, order: list[str], bucket: Column, cuts: tuple[float, float]) -> DataFrame:
    """df with split by position. Only the last row before each cut is sought: the buckets' totals tell where it is, so one bucket a cut is
    sorted and all other rows are compared with it, without a shuffle. Rows alike in their order on both sides of a cut need positions."""
    total = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows")).where("_bucket IS NOT NULL")
    along = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    placed = total.withColumns({"_before": F.coalesce(F.sum("_rows").over(along), F.lit(0)), "n": F.sum("_rows").over(Window.partitionBy())})
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col("n") * c).alias("at")) for i, c in enumerate(cuts)))).alias("_w")
    wanted = placed.select("_bucket", "_before", "_rows", wanted).where("_w.at > _before AND _w.at <= _before + _rows").select("_bucket", "_w.i", (F.col("_w.at") - F.col("_before")).alias("_k"))
    wanted = wanted.checkpoint()
    at = [r[0] for r in wanted.select(F.col("_bucket").cast("string")).collect()]  # one a cut; as values they are sought before df's joins and hashes
    near = df.select(*order, bucket.alias("_bucket")).where(bucket.cast("string").isin(at)).join(F.broadcast(wanted), "_bucket")
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("i").orderBy(*order))).where("_n IN (_k, _k + 1)")
    row = lambda i, k: F.max(F.when((F.col("i") == i) & (F.col("_n") == F.col("_k") + k), F.struct(*order)))
    edges = near.agg(*(row(i, k).alias(f"_e{i}{k}") for i in (0, 1) for k in (0, 1))).checkpoint()
    if edges.where("_e00 = _e01 OR _e10 = _e11").count():
        df = with_count(positions(df, [*map(F.col, order)], bucket))
        first, second = (F.floor(F.col("n") * c) for c in cuts)
        return df.withColumn("split", F.when(F.col("pos") <= first, "train").when(F.col("pos") <= second, "validation").otherwise("test")).drop("pos", "n")
    upto = lambda e: (F.col(order[0]) < F.col(e)[order[0]]) | ((F.col(order[0]) == F.col(e)[order[0]]) & (F.col(order[1]) <= F.col(e)[order[1]]))
    told = F.when(upto("_e00"), "train").when(upto("_e10"), "validation").otherwise("test")
    return df.where(F.col(order[0]).isNotNull()).crossJoin(F.broadcast(edges.select("_e00", "_e10"))).withColumn("split", told).drop("_e00", "_e10")


def systematic_sample(df: DataFrame, k: int) -> DataFrame:
    """k rows at equal steps of the time order, first and last included; all rows if there are no more than k."""
    placed = by_time(with_count(df.where("ts IS NOT NULL")))
    at = F.floor(F.floor((F.col("pos") - 1) * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1))) * (F.col("n") - 1) / (k - 1))
    up = F.floor(F.ceil((F.col("pos") - 1) * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1))) * (F.col("n") - 1) / (k - 1))
    here = F.col("pos") - 1
    return placed.where((F.col("n") <= k) | (at == here) | (up == here)).drop("pos", "n")


def class_cap(df: DataFrame, most: int, seed: int, label: str = "y") -> DataFrame:
    """At most so many rows, each class by its share, the rows of lowest hash in each."""
    total = df.agg(F.count("*").alias("_all"))
    size = df.groupBy(label).agg(F.count("*").alias("_class")).crossJoin(F.broadcast(total))
    quota = size.select(label, F.when(F.col("_all") <= most, F.col("_class")).otherwise(F.greatest(F.lit(1), F.floor(F.col("_class") * most / F.col("_all")))).alias("_quota"))
    placed = by_hash(df, F.md5(F.concat_ws("|", F.lit(str(seed)), "row_id")), by=[label])
    return placed.join(F.broadcast(quota), label).where("pos <= _quota").drop("pos", "_quota")


def nested_fractions(df: DataFrame, fractions: list[float], seed: int) -> DataFrame:
    """A row of df for each fraction that it is in, with fraction; smaller fractions are within larger ones and have four rows at least."""
    placed = by_hash(with_count(df), F.md5(F.concat_ws("|", F.lit(str(seed)), "row_id")))
    placed = placed.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    return placed.where(F.col("pos") <= F.greatest(F.lit(4), F.floor(F.col("fraction") * F.col("n")))).drop("pos", "n")


def permuted(df: DataFrame, columns: list[str], seed: int, by: str = "split") -> DataFrame:
    """df with the columns dealt out anew among the rows of each group: rank in one hash order takes the row of that rank in another."""
    key = lambda s: F.md5(F.concat_ws("|", F.lit(f"{seed}{s}"), "row_id"))
    to = by_hash(df.drop(*columns), key("a"), by=[by])
    source = by_hash(df.select(by, "row_id", *columns), key("b"), by=[by]).drop("row_id")
    return to.join(source, [by, "pos"]).drop("pos")


def top_k(df: DataFrame, by: list[str], score: str, k: int | Column, tie: str = "position") -> DataFrame:
    """The k rows of highest score in each group, of equal ones those of larger tie, with rank."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).desc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def random_k(df: DataFrame, by: list[str], item: str, k: int | Column, seed: int | str) -> DataFrame:
    """k rows of each group by a hash of seed, group and item."""
    w = Window.partitionBy(*by).orderBy("_h", item)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by), F.col(item).cast("string")))
    return df.withColumn("_h", h).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_h")
