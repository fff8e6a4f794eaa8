"""Helpers that the text operators share: the shared scratch folder, graph components, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of a few numbers each that are broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: White space that separates words, as the body of a character class of Java's, RE2's and Python's patterns.
SPACE = r"\x20\x09-\x0D"


_kept: dict[str, Any] = {}


def keep(name: str, make: Callable[[], Any] = lambda: None) -> Any:
    """In a Python worker: make(), remembered for the worker's next tasks of this name; what it remembered for another name is let go.

    Spark hands workers on from stage to stage, so each operator's tasks begin with this: tables of an earlier one take no memory then.
    """
    if name not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)
        _kept[name] = make()
    return _kept[name]


def free(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores at its end until no column (of any case) has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests on one machine), one in the warehouse folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Narrow rows with their lineage cut by a checkpoint in the shared folder; Spark removes the files when the result is no longer in use."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps whose results are checkpointed, before the next step writes its own."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Wide intermediate tables as Parquet in the shared folder, gone when the block that made them ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/fieldaudit-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.top}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_) -> None:
        self.drop()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a few numbers a row, already computed) marked for broadcast if it has few enough rows, else as it is: then Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of edges (a, b): comp is the smallest node that can be reached.

    Alternating large-star and small-star rounds: every round is joins and minima over all edges, a star of any size is taken in one
    round, and the number of rounds grows with the logarithm of the longest chain.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u")
        e = cut(step.select("u", F.col("m").alias("v")).union(step.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        seen = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == mark:
            break
        mark = seen
    ends = e.groupBy("u").agg(F.min("v").alias("comp"))
    return ends.select(F.col("u").alias("node"), "comp").union(ends.select("comp", "comp").distinct())
