"""The panel, its melted form, column registry and ledger that the queries work on, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.functions.draws import uniform

FEATURES = ["x_quantity", "x_discount", "x_tax", "x_size", "x_price"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their supplier and part: row_id, dataset_id, entity_id, ts, source_id, y and five features."""
    line = read(spark, sf_dir, "lineitem")
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", uniform("ent", F.col("s_suppkey")).alias("ent"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd"))
    out = line.join(supplier, "l_suppkey").join(part, "l_partkey").withColumn("row_key", key)
    out = out.select(
        F.md5("row_key").alias("row_id"), F.col("s_nationkey").cast("int").alias("dataset_id"), F.col("l_suppkey").alias("entity_id"), F.col("l_shipdate").alias("ts"),
        (2 * (F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1) + F.instr(F.lit("FO"), F.col("l_linestatus")) - 1).alias("source_id"),
        F.col("l_quantity").alias("x_quantity"), F.col("l_discount").alias("x_discount"), F.col("l_tax").alias("x_tax"), F.col("p_size").cast("double").alias("x_size"), F.col("p_retailprice").alias("x_price"),
        "row_key", F.col("l_linenumber").alias("line"), "ent",
    )
    score = F.col("x_quantity") + F.lit(40.0) * (uniform("lab", F.col("row_key")) - F.lit(0.5)) + F.lit(30.0) * (F.col("ent") - F.lit(0.5))
    return out.withColumn("y", (score > 32).cast("int")).drop("row_key", "ent")


def u_sql(text: str, at: int = 1) -> str:
    return f"((CAST(CAST('0x' || substr(md5({text}), {at}, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296.0 AS DOUBLE))"


def normal_sql(seed: int, name: str) -> str:
    text = f"'{seed}|{name}|' || row_id"
    return f"(sqrt(CAST(-2.0 AS DOUBLE) * ln({u_sql(text)})) * cos(CAST(6.283185307179586 AS DOUBLE) * {u_sql(text, 9)}))"


PANEL = f"""WITH RECURSIVE raw AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS row_key, CAST(s_nationkey AS INT) AS dataset_id, l_suppkey AS entity_id,
         l_shipdate AS ts, 2 * (instr('ANR', l_returnflag) - 1) + instr('FO', l_linestatus) - 1 AS source_id, l_quantity AS x_quantity, l_discount AS x_discount, l_tax AS x_tax,
         CAST(p_size AS DOUBLE) AS x_size, p_retailprice AS x_price, l_linenumber AS line
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
panel AS (
  SELECT md5(row_key) AS row_id, * EXCLUDE (row_key),
         CAST(x_quantity + CAST(40.0 AS DOUBLE) * ({u_sql("'lab|' || row_key")} - CAST(0.5 AS DOUBLE)) + CAST(30.0 AS DOUBLE) * ({u_sql("'ent|' || entity_id")} - CAST(0.5 AS DOUBLE)) > 32 AS INT) AS y
  FROM raw),
stats AS (SELECT count(*) AS n, sum(y) AS ys FROM panel),
placed AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) AS pos, sum(y) OVER (ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) AS c, (SELECT n FROM stats) AS n,
                  (SELECT (ys - y) / CAST(n - 1 AS DOUBLE) FROM stats) AS prior FROM panel),
splitted AS (SELECT *, CASE WHEN pos <= floor(n * 0.6) THEN 'train' WHEN pos <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM placed)"""


def melted(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per row and column: keep, feature_id, position, value."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature_id"), F.lit(i).alias("position"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns))))
    return df.select(*keep, each.alias("_f")).select(*keep, "_f.feature_id", "_f.position", "_f.value")


def melted_sql(table: str, columns: list[str], keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature_id, {i} AS position, CAST({c} AS DOUBLE) AS value FROM {table}" for i, c in enumerate(columns))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell (dataset, mechanism, strength, model, seed) with the figures of its order lines in the place of fitted scores."""
    p = panel(spark, sf_dir)
    p = p.select(
        "dataset_id", F.format_string("M%02d", F.col("source_id") + 1).alias("mechanism"), (F.pmod("line", F.lit(2)) + 1).cast("int").alias("strength"),
        F.element_at(F.array(*map(F.lit, ("lr", "rf", "gbt"))), (F.pmod(F.col("x_size").cast("int"), F.lit(3)) + 1).cast("int")).alias("model"),
        F.when(F.substring("row_id", 1, 1) < "8", F.lit(1)).otherwise(F.lit(2)).alias("seed"), "y", "x_quantity", "x_discount", "x_tax",
    )
    cell = p.groupBy("dataset_id", "mechanism", "strength", "model", "seed").agg(
        F.count("*").alias("n_rows"), F.round(F.avg(F.col("x_quantity") / 50.0), 9).alias("clean_auc"), F.round(F.avg(F.col("y").cast("double")), 9).alias("full_auc"),
        F.round(F.avg(F.col("x_discount") * 10), 9).alias("diagnostic_ap"), F.round(F.avg(F.col("x_tax") * 8), 9).alias("governed_auc"),
    )
    return cell.withColumn("paired_harm", F.round(F.col("full_auc") - F.col("clean_auc"), 9))


LEDGER = PANEL + """,
cells AS (SELECT dataset_id, printf('M%02d', source_id + 1) AS mechanism, CAST(line % 2 + 1 AS INT) AS strength, ['lr', 'rf', 'gbt'][CAST(x_size AS INT) % 3 + 1] AS model,
                 CASE WHEN substr(row_id, 1, 1) < '8' THEN 1 ELSE 2 END AS seed, y, x_quantity, x_discount, x_tax FROM panel),
ledger0 AS (SELECT dataset_id, mechanism, strength, model, seed, count(*) AS n_rows, round(avg(x_quantity / 50.0), 9) AS clean_auc, round(avg(CAST(y AS DOUBLE)), 9) AS full_auc,
                  round(avg(x_discount * 10), 9) AS diagnostic_ap, round(avg(x_tax * 8), 9) AS governed_auc FROM cells GROUP BY ALL),
ledger AS (SELECT *, round(full_auc - clean_auc, 9) AS paired_harm FROM ledger0)"""

# What kind each mechanism is of
CATEGORY = {
    "M01": "simple", "M02": "simple", "M03": "boundary", "M04": "structured", "M05": "structured", "M06": "simple", "M07": "boundary", "M08": "structured", "M09": "structured", "M10": "simple",
    "M11": "boundary",
}
CATEGORIES = "(VALUES " + ", ".join(f"('{m}', '{c}')" for m, c in CATEGORY.items()) + ") k(mechanism, category)"


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORY.items()), "mechanism string, category string")
