"""Contracts on tables and columns: what is to hold before a panel is scored or a summary is published, and views of a panel by its registry."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fieldaudit.operators.ledger import GateError, require
from fieldaudit.operators.order import ranked

# The parameter of each strength level, by mechanism
STRENGTHS = {"M02": {"S1": 0.1, "S2": 0.3, "S3": 0.5, "S4": 0.7, "S5": 1.0}}
# The texts that are booleans, in lower case and without white space around
TRUE, FALSE = "true", "false"


def any_flag(df: DataFrame, flags: list[str], name: str = "y") -> DataFrame:
    """df with name: 1 where any flag holds, 0 where none does; a null flag doesn't hold."""
    held = [F.coalesce(F.col(c), F.lit(False)) for c in flags]
    return df.withColumn(name, F.greatest(*(h.cast("int") for h in [*held, F.lit(False)])))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without declared columns; one that isn't there is an error, as the declaration is then of another table."""
    if absent := [c for c in names if c not in df.columns]:
        raise ValueError(f"declared columns that aren't there: {absent}")
    return df.drop(*names)


def views(registry: DataFrame, forbidden: set[str], quarantined: list[str]) -> dict[str, list[str]]:
    """Names of the columns of each view, in order: strict (without forbidden ones), full, governed and contaminated.

    A registry is a table of column names; only these come to the driver.
    """
    names = [r.feature_id for r in registry.orderBy("position").select("feature_id").collect()]
    bad = [c for c in names if c in forbidden]
    return {"strict": [c for c in names if c not in bad], "full": names, "governed": [c for c in names if c not in quarantined], "contaminated": bad}


def ordered(df: DataFrame, ts: str, tie: list[str]) -> DataFrame:
    """df with pos: the place from 1 by time, rows without a time last, ties by source row. Ranges of (time, source row) are numbered apart, so
    neither a busy day nor the rows without a time are one task's."""
    return ranked(df, [], [F.col(ts).asc_nulls_last(), *(F.col(c) for c in tie)])


def column_difference(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the registry left (by, feature_id ..) whose column the registry right lacks in the same group."""
    return left.join(right.select(*by, "feature_id"), [*by, "feature_id"], "left_anti")


def differing(recorded: DataFrame, found: DataFrame, key: list[str], a: str, b: str, tolerance: float) -> DataFrame:
    """Keys of both tables whose values differ by more than the tolerance, or where only one is null."""
    gap = F.abs(F.col(a) - F.col(b))
    return recorded.join(found, key).where((gap > tolerance) | (F.col(a).isNull() != F.col(b).isNull()))


def strict_boolean(df: DataFrame, column: str, refuse: bool = False) -> DataFrame:
    """df with parsed (null where not valid) and valid. Booleans are taken, whole numbers 0 and 1, and the texts true and false in any case;
    with refuse, anything else (null too) raises."""
    kind = df.schema[column].dataType
    t = F.lower(F.trim(F.col(column).cast("string")))
    yes, no = (F.lit("1"), F.lit("0")) if isinstance(kind, IntegralType) else (F.lit(TRUE), F.lit(FALSE))
    out = df.withColumns({"parsed": F.when(t == yes, True).when(t == no, False), "valid": F.coalesce((t == yes) | (t == no), F.lit(False))})
    if refuse:
        require(out.where("NOT valid"), f"{column} holds what isn't a strict boolean")
    return out


def input_contract(df: DataFrame, features: list[str], by: list[str], label: str = "y") -> DataFrame:
    """by, split, n_rows, n_not_finite, n_not_binary, n_classes and fit: whether a learner may have these rows; train and validation rows need both classes."""
    finite: Column = F.lit(True)
    for c in features:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    binary = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    out = df.groupBy(*by, "split").agg(F.count("*").alias("n_rows"), F.count_if(~finite).alias("n_not_finite"), F.count_if(~binary).alias("n_not_binary"), F.countDistinct(label).alias("n_classes"))
    broken = (F.col("n_not_finite") > 0) | (F.col("n_not_binary") > 0) | (F.col("split").isin("train", "validation") & (F.col("n_classes") < 2))
    return out.withColumn("fit", ~broken)


def same_features(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Raises unless two views have the same feature columns in the same order: a learner fitted on one can then score the other."""
    a, b = ([c for c in df.columns if c not in keys] for df in (left, right))
    if a != b:
        raise GateError(f"feature columns differ: {sorted(set(a) ^ set(b)) or 'their order'}")


def nested_document(df: DataFrame, unit: str, method: str, figures: list[str]) -> DataFrame:
    """unit, document, spread, robust: a JSON object of methods in order, each an object of figures rounded to four places (the value and the ends
    of its interval, in this order); the range of the values; whether no interval holds 0."""
    v, lo, hi = (F.round(c, 4) for c in figures)
    entry = F.struct(F.col(method), F.struct(*(F.round(c, 4).alias(c) for c in figures)))
    return df.groupBy(unit).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("document"), F.round(F.max(v) - F.min(v), 4).alias("spread"), (F.min(lo > 0) | F.min(hi < 0)).alias("robust"),
    )


def canonical_lineage(df: DataFrame, column: str, mask: dict[str, str]) -> DataFrame:
    """df with the JSON object in column rewritten: the texts in mask replace the values of its keys, keys at every depth are in order and numbers
    stay numbers, so that equal documents are equal texts. Broken JSON, what isn't an object, and null give null."""
    whole = F.try_parse_json(F.col(column))
    fields = F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole).cast("map<string,variant>")
    value = lambda k, v: F.coalesce(*(F.when(k == name, F.parse_json(F.lit(json.dumps(text)))) for name, text in mask.items()), v)
    return df.withColumn(column, F.to_json(F.to_variant_object(F.transform_values(fields, value))))


def public_path(task: Column, path: Column, root: str = "external_sources") -> Column:
    """A path without the folders of the machine it came from: root, task and the file's own name; null where the name is missing or is a step up."""
    name = F.element_at(F.split(path, r"[/\\\\]"), -1)
    return F.when(~name.isin("", ".", ".."), F.concat_ws("/", F.lit(root), task, name))


def reporting(df: DataFrame, reports: dict[str, list[str]], value: str) -> DataFrame:
    """report, unit, n, mean, low, high: one table a report, over one pass of the rows each belongs to."""
    tag = F.explode(F.array(*(F.struct(F.lit(n).alias("report"), F.concat_ws("/", *(F.col(c).cast("string") for c in k)).alias("unit")) for n, k in reports.items()))).alias("_r")
    return df.select(tag, value).groupBy("_r.report", "_r.unit").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high"))
