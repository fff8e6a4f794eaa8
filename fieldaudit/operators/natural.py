"""Natural panels: a table of records becomes a labelled, ordered, sampled, encoded and split panel by a specification of its source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from fieldaudit.operators import order
from fieldaudit.operators.ledger import GateError
from fieldaudit.sources import files

#: Codes of values that are missing and of values that no train row has.
MISSING, UNSEEN = -1, -2
#: The place of a record in its source, as file_rows() makes it.
SOURCE = ["_file", "_block", "_row"]
LEGITIMATE, LATE = "LEGITIMATE", "POST_OUTCOME"


@dataclass(frozen=True)
class Source:
    """What makes a panel of a table.

    label gives 1, 0 or null (no outcome yet: the record goes); time orders the records, those without one last and ties by `rows`, the
    columns that tell where a record stands in its source. first keeps the first records of the source, most a systematic sample along the
    order. A feature is late if its name holds one of late_parts, is in late, or isn't in known where that is given. codes says which rows
    text values are coded by: "table", or "train", where values that no train row has become UNSEEN.
    """

    name: str
    prefix: str
    label: Callable[[DataFrame], Column]
    rows: tuple[str, ...]
    outcome: tuple[str, ...] = ()
    time: Callable[[DataFrame], Column] | None = None
    time_name: str | None = None
    renames: dict[str, str] = field(default_factory=dict)
    late_parts: tuple[str, ...] = ()
    late: tuple[str, ...] = ()
    known: tuple[str, ...] | None = None
    dropped: tuple[str, ...] = ()
    first: int | None = None
    most: int | None = None
    codes: str = "table"
    cuts: tuple[float, float] = (0.6, 0.8)
    checked: bool = False

    def is_late(self, column: str) -> bool:
        low = column.lower()
        return any(p in low for p in self.late_parts) or column in self.late or (self.known is not None and column not in self.known)


@dataclass(frozen=True)
class Panel:
    """rows: pos, split, y and a number for each feature, named by its id; registry: a row for each feature; audit: one row of counts and times."""

    rows: DataFrame
    registry: DataFrame
    audit: DataFrame
    codes: DataFrame
    features: list[str]


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of the names that the table has; none of them is an error."""
    for name in names:
        if name in df.columns:
            return name
    raise GateError(f"none of {names} is a column")


def words(column: str, yes: tuple[str, ...], no: tuple[str, ...]) -> Callable[[DataFrame], Column]:
    """1 and 0 for texts in two lists, trimmed and in lower case; null for others."""
    text = lambda: F.lower(F.trim(F.col(column).cast("string")))
    return lambda _: F.when(text().isin(*yes), F.lit(1)).when(text().isin(*no), F.lit(0))


def flags(*columns: str) -> Callable[[DataFrame], Column]:
    """1 where any of the columns is 1 or more, else 0; a null one is 0."""
    return lambda _: F.greatest(*((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) >= 1).cast("int") for c in columns), F.lit(0))


def starts(column: str, text: str) -> Callable[[DataFrame], Column]:
    """1 where a text starts so, in any case; else 0, for null too."""
    return lambda _: F.coalesce(F.lower(F.col(column).cast("string")).startswith(text), F.lit(False)).cast("int")


def within_days(later: str, earlier: str, days: int) -> Callable[[DataFrame], Column]:
    """1 where at most so many whole days lie between two times, else 0; 0 where one is missing."""
    from fieldaudit.operators.columns import day_difference

    moment = lambda c: F.col(c).try_cast("timestamp")
    return lambda _: F.coalesce(day_difference(moment(later), moment(earlier)) <= days, F.lit(False)).cast("int")


def file_rows(df: DataFrame) -> DataFrame:
    """A table read from files with SOURCE: file, block of the file and a number that rises within it. The order of a file's records."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))


def _kinds(df: DataFrame, names: list[str]) -> tuple[list[str], list[str]]:
    """Columns that hold texts, and those that a number can stand for; others can't be features."""
    texts = [c for c in names if isinstance(df.schema[c].dataType, StringType)]
    numbers = [c for c in names if isinstance(df.schema[c].dataType, NumericType | BooleanType | TimestampType | TimestampNTZType | DateType)]
    return texts, numbers


def code_table(df: DataFrame, columns: list[str], seen: Column | None = None) -> DataFrame:
    """feature, value, code: places from 0 of the different texts of each column in their binary order, of the rows seen only.

    All columns are one table of different values, ranked through ranges: a column of as many values as rows is no window of its own.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns))).alias("_e")
    values = (df if seen is None else df.where(seen)).select(each).select("_e.*").where("value IS NOT NULL").distinct()
    return order.ranked(values, ["feature"], [F.col("value")]).select("feature", "value", (F.col("pos") - 1).alias("code"))


def coded(df: DataFrame, columns: list[str], codes: DataFrame) -> DataFrame:
    """df with each column's texts replaced by their codes: MISSING for null, UNSEEN for values without one.

    A column of few values is looked up by broadcast, which a count of its codes decides; one of many is joined by a shuffle.
    """
    for c in columns:
        own = codes.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("code").alias("_code"))
        code = F.when(F.col(c).isNull(), MISSING).otherwise(F.coalesce("_code", F.lit(UNSEEN))).cast("double")
        df = df.join(order.small(own), c, "left").withColumn(c, code).drop("_code")
    return df


def number(column: Column, kind) -> Column:
    """A feature's number: seconds of a time, 1 and 0 of a boolean, MISSING for null and NaN."""
    if isinstance(kind, TimestampType | TimestampNTZType | DateType):
        column = F.unix_micros(column.cast("timestamp")) / 1e6
    return F.coalesce(F.nanvl(column.cast("double"), F.lit(None)), F.lit(float(MISSING)))


def panel(df: DataFrame, source: Source) -> Panel:
    """The panel that a source's specification makes of its records.

    Records without an outcome go first, so positions, sample and split are of resolved ones. Two tables are checkpointed on the way: the
    ordered keys, and the sampled records; the audit reads them again. Raises where no record has an outcome, a declared column is missing,
    or (checked) a label is neither of its words.
    """
    df = df.withColumnsRenamed({a: b for a, b in source.renames.items() if a in df.columns})
    if absent := [c for c in (*source.outcome, *source.rows, *source.dropped) if c not in df.columns]:
        raise GateError(f"{source.name}: no columns {absent}")
    if source.first is not None:
        df = order.ranked(df, [], [*map(F.col, source.rows)]).where(F.col("pos") <= source.first).drop("pos")
    names = [c for c in df.columns if c not in (*source.outcome, *source.dropped, *SOURCE)]
    texts, numbers = _kinds(df, names)
    kept = [c for c in names if c in texts or c in numbers]
    when = (source.time(df) if source.time else F.lit(None)).cast("timestamp")
    df = df.withColumns({"_y": source.label(df).cast("int"), "_at": when})
    keys = df.select(*source.rows, "_y", "_at")
    if source.checked and not keys.where("_y IS NULL").isEmpty():
        raise GateError(f"{source.name}: a label is not supported")
    placed = order.ranked(keys.where("_y IS NOT NULL"), [], [F.col("_at").asc_nulls_last(), *map(F.col, source.rows)]).checkpoint()
    counts = placed.agg(F.count("*").alias("n"), F.count("_at").alias("dated")).first()
    if not counts.n:
        raise GateError(f"{source.name}: no record has an outcome")
    chosen = _sampled(placed, counts.n, source.most)
    size = min(counts.n, source.most or counts.n)
    a, b = (int(size * c) for c in source.cuts)
    split = F.when(F.col("pos") <= a, "train").when(F.col("pos") <= b, "validation").otherwise("test")
    records = df.drop("_y", "_at").join(chosen, [*source.rows]).withColumn("split", split).checkpoint()
    codes = code_table(records, texts, F.col("split") == "train" if source.codes == "train" else None).checkpoint() if texts else df.sparkSession.createDataFrame([], "feature string, value string, code long")
    rows = coded(records, texts, codes)
    ids = [f"{source.prefix}{c}" for c in kept]
    values = [(F.col(c) if c in texts else number(F.col(c), records.schema[c].dataType)).alias(i) for c, i in zip(kept, ids)]
    entries = [(i, c, k, not source.is_late(c), LATE if source.is_late(c) else LEGITIMATE, c in texts) for k, (c, i) in enumerate(zip(kept, ids))]
    registry = df.sparkSession.createDataFrame(entries, "feature_id string, name string, position int, available boolean, label string, coded boolean")
    ordered = "chronologically_sorted" if counts.dated else "source_order"
    rule = f"systematic_over_{ordered}_resolved_outcomes" if source.most and counts.n > source.most else "all_resolved_outcomes"
    audit = placed.join(chosen.select(*source.rows), [*source.rows], "left_semi").agg(
        F.lit(source.name).alias("panel"), F.lit(counts.n).cast("long").alias("resolved_rows"), F.count("*").alias("rows_loaded"), F.lit(source.most).cast("long").alias("row_limit"), F.lit(rule).alias("sampling_rule"),
        F.lit(bool(counts.dated)).alias("chronological_sort"), F.lit(source.time_name if counts.dated else None).cast("string").alias("sort_column"), F.min("_at").alias("time_min"), F.max("_at").alias("time_max"),
        F.sum("_y").alias("positives"),
    )
    return Panel(rows.select("pos", "split", F.col("_y").alias("y"), *values), registry, audit, codes, ids)


def _sampled(placed: DataFrame, n: int, most: int | None) -> DataFrame:
    """placed, or its `most` rows at equal steps, the first and last among them, numbered anew from 1."""
    if most is None or n <= most:
        return placed
    at = placed.sparkSession.range(most).select(F.floor(F.col("id") * F.lit(n - 1) / F.lit(max(1, most - 1))).alias("_p"), F.col("id").alias("_k"))
    return placed.join(at, F.col("pos") - 1 == F.col("_p")).withColumn("pos", F.col("_k") + 1).drop("_p", "_k")


def melted(p: Panel) -> DataFrame:
    """pos, split, y, feature_id, value: a row for each row and feature of the panel."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("feature_id"), F.col(f"`{i}`").alias("value")) for i in p.features))).alias("_e")
    return p.rows.select("pos", "split", "y", each).select("pos", "split", "y", "_e.*")


def unseen(p: Panel) -> DataFrame:
    """feature_id, split, n_unseen: rows of each split whose value no train row has, for coded features."""
    coded_ids = [r.feature_id for r in p.registry.where("coded").select("feature_id").collect()]  # names of columns
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("feature_id"), (F.col(f"`{i}`") == UNSEEN).cast("int").alias("u")) for i in coded_ids))).alias("_e")
    return p.rows.select("split", each).groupBy("_e.feature_id", "split").agg(F.sum("_e.u").alias("n_unseen"))


def mapping_digest(p: Panel) -> DataFrame:
    """feature, n_codes, digest: codes of each coded feature and a digest of (text, code) pairs, whatever order they are read in: two panels
    with equal digests were coded alike."""
    pair = F.conv(F.substring(F.sha2(F.concat_ws("|", "value", "code"), 256), 1, 10), 16, 10).cast("decimal(38,0)")
    return p.codes.groupBy("feature").agg(F.count("*").alias("n_codes"), F.sum(pair).cast("string").alias("digest"))


def contamination(registry: DataFrame, forbidden: tuple[str, ...] = (LATE,)) -> DataFrame:
    """registry with is_leak: the label is forbidden, or the feature isn't available at prediction time."""
    return registry.withColumn("is_leak", F.col("label").isin(*forbidden) | ~F.col("available"))


def from_files(spark: SparkSession, path: str, schema: str, source: Source, choose: dict, archive: bool = False) -> tuple[Panel, DataFrame]:
    """The panel of the file that choose (arguments of files.choose_file) finds at path, and its lineage: the audit with name, SHA-256 and size of the file."""
    at = files.choose_file(spark, path, **choose)
    if archive:
        df = files.read_zip(spark, at, schema).withColumns({"_file": F.lit(at), "_block": F.lit(0), "_row": F.monotonically_increasing_id()})
    else:
        df = file_rows(files.read_csv(spark, at, schema))
    made = panel(df, source)
    return made, made.audit.crossJoin(F.broadcast(files.lineage(spark, at)))
