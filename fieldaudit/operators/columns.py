"""Column preparation: labels, dates, numbers, codes, availability and views by a registry of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.operators.ledger import GateError
from fieldaudit.operators.order import quantiles, ranked, small


def binary_label(text: Column, yes: list[str], no: list[str]) -> Column:
    """1 or 0 for trimmed, lower-cased words; null for others."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*yes), F.lit(1)).when(t.isin(*no), F.lit(0))


def day_difference(later: Column, earlier: Column) -> Column:
    """Whole days between two times, rounded down: not calendar days."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000)).cast("int")


def tolerant_date(text: Column, *formats: str) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def number_or(text: Column, other: float = -1.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(other))


def factor_filter(df: DataFrame, column: str, choice: str | list, universe: list) -> DataFrame:
    """Rows of chosen levels: "all", a list, or "a:b" for the half-open range of places in universe. An unknown level raises."""
    if choice == "all":
        levels = universe
    elif isinstance(choice, str):
        a, b = (int(x) if x else None for x in choice.split(":"))
        levels = universe[a:b]
    else:
        levels = choice
    if unknown := set(levels) - set(universe):
        raise GateError(f"unknown levels of {column}: {sorted(unknown)}")
    return df.where(F.col(column).isin(*levels))


def train_codes(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """df with column_code: the place of a value among the sorted values of train rows, -2 for others, -1 for null."""
    seen = ranked(df.where((F.col(split) == "train") & F.col(column).isNotNull()).select(column).distinct(), [], [F.col(column)])
    seen = small(seen.withColumn("_code", F.col("pos") - 1).drop("pos"))
    return df.join(seen, column, "left").withColumn(f"{column}_code", F.when(F.col(column).isNull(), -1).otherwise(F.coalesce("_code", F.lit(-2)))).drop("_code")


def train_medians(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """feature_id, median, n_missing: of each column's train rows; 0 for a column without a value. Null and NaN are missing."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature_id"), number(c).alias("value")) for c in columns))).alias("_e")
    long = df.where(F.col(split) == "train").select(each).select("_e.*")
    middle = quantiles(long, ["feature_id"], "value", [0.5]).select("feature_id", F.get("q", F.lit(0)).alias("median"))
    count = long.groupBy("feature_id").agg(F.sum(F.col("value").isNull().cast("long")).alias("n_missing"))
    return count.join(middle, "feature_id", "left").select("feature_id", F.coalesce("median", F.lit(0.0)).alias("median"), "n_missing")


def imputed(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """df with the missing numbers of the columns replaced by train_medians(): one row of medians, broadcast."""
    wide = train_medians(df, columns, split).groupBy().pivot("feature_id", columns).agg(F.first("median"))
    row = wide.select(*(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"_m_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(row))
    return out.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.col(f"_m_{c}")) for c in columns}).drop(*(f"_m_{c}" for c in columns))


def scaled(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """df with the columns less their mean over the train rows, in its standard deviations there; nulls stay, a column without spread is only
    centred. One pass over the train rows gives all figures, as one row."""
    fit = df.where(F.col(split) == "train").agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    placed = df.crossJoin(F.broadcast(fit))
    spread = {c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return placed.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / spread[c] for c in columns}).select(*df.columns)


def availability(columns: DataFrame, patterns: DataFrame) -> DataFrame:
    """columns with available: false where a pattern (a part of a name) is in feature_id."""
    hit = columns.join(F.broadcast(patterns), columns.feature_id.contains(patterns.pattern)).select("feature_id").distinct().withColumn("_hit", F.lit(True))
    return columns.join(hit, "feature_id", "left").withColumn("available", F.col("_hit").isNull()).drop("_hit")


def view(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """df with its keys and the named columns; a name that isn't there raises."""
    if missing := set(names) - set(df.columns):
        raise GateError(f"no columns {sorted(missing)}")
    return df.select(*keep, *names)


def opaque_id(name: Column, salt: str = "") -> Column:
    return F.concat(F.lit("fid_"), F.substring(F.sha2(F.concat(F.lit(salt), name), 256), 1, 16))


def regime(columns: DataFrame, level: str) -> DataFrame:
    """The registry as a detector may see it: O0 numbered ids in hash order and no names, O1 names, O2 names and availability."""
    if level == "O0":
        placed = ranked(columns.select("feature_id", F.sha2("feature_id", 256).alias("_h")), [], [F.col("_h"), F.col("feature_id")])
        return placed.select(F.format_string("a%03d", F.col("pos") - 1).alias("shown_id"), "feature_id")
    shown = [F.col("feature_id").alias("shown_id"), "feature_id"]
    if level == "O1":
        return columns.select(*shown)
    if level == "O2":
        return columns.select(*shown, "available")
    raise ValueError(f"no regime {level!r}")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with columns renamed by a map; a name that isn't there, or one that would then be there twice, is an error."""
    out = [names.get(c, c) for c in df.columns]
    if (absent := set(names) - set(df.columns)) or len(set(out)) < len(out):
        raise ValueError(f"can't rename: absent {sorted(absent)}, columns {out}")
    return df.withColumnsRenamed(names)
