"""Files as tables: delimited text, archives, result files, choice and lineage of files, ledgers that are appended to."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldaudit.operators.ledger import GateError, require


def delimiter(spark: SparkSession, path: str) -> str:
    """; or , by which is more frequent in the first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str | None = None) -> DataFrame:
    """A delimited file (gzip by its name), with explicit types; a bad value is null."""
    return spark.read.schema(schema).option("header", True).option("sep", sep or delimiter(spark, path)).option("mode", "PERMISSIVE").csv(path)


def read_chosen(spark: SparkSession, path: str, schema: str, keys: DataFrame, key: str) -> DataFrame:
    """Only the rows whose key is among keys."""
    return read_csv(spark, path, schema).join(keys.select(key).distinct(), key, "left_semi")


#: Rows of an archive's member that are in a task's memory at once.
ZIP_ROWS = 100_000


def read_zip(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the first .csv member (by name) of each archive at path; one archive is one task's, its rows are read ZIP_ROWS at
    a time."""
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(schema).fields]

    def run(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = sorted(n for n in z.namelist() if n.lower().endswith(".csv"))[0]
                    for part in pd.read_csv(z.open(member), usecols=lambda c: c in names, dtype=str, chunksize=ZIP_ROWS):
                        yield part.reindex(columns=names)

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{n}` string" for n in names))
    return text.select(*(F.expr(f"TRY_CAST(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in _parse_datatype_string(schema).fields))


def read_results(spark: SparkSession, path: str, schema: str, status: str = "COMPLETED") -> DataFrame:
    """Result files in JSON (one object each) of that status; broken files are left out, and named by broken_results()."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where(F.col("status") == status)


def choose_file(spark: SparkSession, path: str, suffixes: list[str], like: str = "", first: tuple[str, ...] = ()) -> str:
    """The file at path (folders below it included) whose name, in lower case, fits the pattern `like` and ends as one of suffixes.

    Names in `first` come before others, in their order; then the largest file, then that of the first suffix, then by name. Only names and
    sizes are read. No such file is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    files = files.withColumn("_name", F.lower(F.element_at(F.split(F.url_decode("path"), "/"), -1)))
    ends = F.coalesce(*(F.when(F.col("_name").endswith(x), F.lit(i)) for i, x in enumerate(suffixes)))
    named = F.coalesce(*(F.when(F.col("_name") == x, F.lit(i)) for i, x in enumerate(first)), F.lit(len(first)))
    best = files.where(ends.isNotNull() & F.col("_name").rlike(like)).orderBy(named, F.col("length").desc(), ends, "_name", "path").first()
    if best is None:
        raise GateError(f"no file at {path} ends as one of {suffixes} and fits {like!r}")
    return best.path


def lineage(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 and bytes of each file at path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def time_lineage(df: DataFrame, column: str) -> DataFrame:
    """sort_column, time_min and time_max of the values of a column that aren't null, as texts of ISO 8601; null where there are none. One row."""
    iso = lambda c: F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return df.agg(F.lit(column).alias("sort_column"), iso(F.min(column)).alias("time_min"), iso(F.max(column)).alias("time_max"))


def broken_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """name of each result file that read_results() leaves out as it isn't one JSON object of the schema."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    parsed = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    return whole.withColumn("_parsed", parsed).where("_parsed IS NULL OR _parsed._broken IS NOT NULL").select("name")


def append_ledger(done: str, plan: DataFrame, evaluate, key: str = "run_id") -> DataFrame:
    """Evaluates the planned rows that the ledger at done lacks and appends them to it; the whole ledger."""
    spark = plan.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(done)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    todo = plan.join(spark.read.parquet(done).select(key), key, "left_anti") if exists else plan
    evaluate(todo).write.mode("append").parquet(done)
    return spark.read.parquet(done)


def export(df: DataFrame, key: list[str], path: str) -> None:
    """df in key order as Parquet and CSV, which must hold the same rows."""
    ordered = df.orderBy(*key)
    ordered.write.parquet(f"{path}/parquet")
    ordered.write.option("header", True).csv(f"{path}/csv")
    spark = df.sparkSession
    a, b = spark.read.parquet(f"{path}/parquet"), spark.read.schema(df.schema).option("header", True).csv(f"{path}/csv")
    require(a.exceptAll(b).union(b.exceptAll(a)), "Parquet and CSV differ")
