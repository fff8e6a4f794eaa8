"""Natural panels of the driver's tables: orders, events and customers, each by its own specification, with SQL for rows, registry and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.operators import natural
from fieldaudit.plans.tables import read

QUERIES, ORACLE = {}, {}

#: Finished orders (F) against open ones (O), others have no outcome; at most 5,000 along the dates; the price is known late.
ORDERS = natural.Source(
    "orders", "o_", natural.words("o_orderstatus", ("f",), ("o",)), ("o_orderkey",), ("o_orderstatus",), lambda df: F.col("o_orderdate"), "o_orderdate", late_parts=("price",), dropped=("o_orderdate",), most=5_000,
)
#: Events of high value; only the user and the properties are known before, texts are coded by train rows.
EVENTS = natural.Source("events", "e_", lambda df: (F.col("value") > 20).cast("int"), ("event_id",), (), lambda df: F.col("ts"), "ts", known=("user_id", "props", "event_type"), codes="train")
#: Customers of one kind of segment, in the order of their keys, as they have no time; the segment is the outcome itself.
CUSTOMERS = natural.Source("customers", "c_", natural.starts("c_mktsegment", "a"), ("c_custkey",), late=("c_mktsegment",), renames={"c_name": "title"}, codes="train")
SOURCES = {"orders": ORDERS, "events": EVENTS, "customer": CUSTOMERS}


def panels(s, d) -> dict[str, natural.Panel]:
    return {source.name: natural.panel(read(s, d, table), source) for table, source in SOURCES.items()}


def _each(of):
    """One table of what `of` makes of every panel, with the panel's name."""
    return lambda s, d: reduce(DataFrame.unionByName, [of(p).withColumn("panel", F.lit(name)) for name, p in panels(s, d).items()])


def _coded(name: str, column: str, seen: str = "true") -> str:
    """Codes of a column of a table of sampled rows by the different texts of the rows seen."""
    return f"{name} AS (SELECT {column} AS v, CAST(row_number() OVER (ORDER BY {column}) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT {column} FROM {{}} WHERE {column} IS NOT NULL AND {seen}))"


_split = lambda n: f"CASE WHEN pos <= CAST(floor({n} * 0.6) AS BIGINT) THEN 'train' WHEN pos <= CAST(floor({n} * 0.8) AS BIGINT) THEN 'validation' ELSE 'test' END AS split"
_code = lambda codes, column, miss="-2": f"CASE WHEN {column} IS NULL THEN -1 ELSE coalesce((SELECT code FROM {codes} WHERE v = {column}), {miss}) END"
_num = lambda column: f"coalesce(CAST({column} AS DOUBLE), -1)"
NATURAL = f"""WITH o0 AS (SELECT *, row_number() OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey) - 1 AS p, count(*) OVER () AS n, CASE lower(trim(o_orderstatus)) WHEN 'f' THEN 1 ELSE 0 END AS y
  FROM orders WHERE lower(trim(o_orderstatus)) IN ('f', 'o')),
o1 AS (SELECT o0.*, row_number() OVER (ORDER BY p) AS pos, least(n, 5000) AS m FROM o0 WHERE n <= 5000 OR p IN (SELECT i * (SELECT count(*) - 1 FROM o0) // 4999 FROM range(5000) t(i))),
o2 AS (SELECT *, {_split("m")} FROM o1), {_coded("oc", "o_orderpriority").format("o2")},
e1 AS (SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, event_id) AS pos, count(*) OVER () AS n, CAST(value > 20 AS INT) AS y FROM events WHERE value IS NOT NULL),
e2 AS (SELECT *, {_split("n")} FROM e1), {_coded("et", "event_type", "split = 'train'").format("e2")}, {_coded("ep", "props", "split = 'train'").format("e2")},
c1 AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS pos, count(*) OVER () AS n, CAST(coalesce(starts_with(lower(c_mktsegment), 'a'), false) AS INT) AS y FROM customer),
c2 AS (SELECT *, {_split("n")} FROM c1), {_coded("cn", "c_name", "split = 'train'").format("c2")}, {_coded("cm", "c_mktsegment", "split = 'train'").format("c2")},
wide AS (
  SELECT 'orders' AS panel, pos, split, y, MAP {{'o_o_orderkey': {_num("o_orderkey")}, 'o_o_custkey': {_num("o_custkey")}, 'o_o_totalprice': {_num("o_totalprice")}, 'o_o_orderpriority': {_code("oc", "o_orderpriority")}}} AS f FROM o2
  UNION ALL SELECT 'events', pos, split, y, MAP {{'e_event_id': {_num("event_id")}, 'e_ts': epoch_us(ts) / 1e6, 'e_user_id': {_num("user_id")}, 'e_event_type': {_code("et", "event_type")}, 'e_value': {_num("value")}, 'e_props': {_code("ep", "props")}}} FROM e2
  UNION ALL SELECT 'customers', pos, split, y, MAP {{'c_c_custkey': {_num("c_custkey")}, 'c_title': {_code("cn", "c_name")}, 'c_c_nationkey': {_num("c_nationkey")}, 'c_c_acctbal': {_num("c_acctbal")}, 'c_c_mktsegment': {_code("cm", "c_mktsegment")}}} FROM c2),
long AS (SELECT panel, pos, split, y, unnest(map_keys(f)) AS feature_id, unnest(map_values(f)) AS value FROM wide)"""
_LATE = ["o_o_totalprice", "e_event_id", "e_ts", "e_value", "c_c_mktsegment"]
_CODED = ["o_o_orderpriority", "e_event_type", "e_props", "c_title", "c_c_mktsegment"]
_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


def add(name, run, sql):
    QUERIES[name], ORACLE[name] = run, NATURAL + "\n" + sql


add("f19_natural_panels", _each(lambda p: natural.melted(p).withColumn("value", F.round("value", 6))), "SELECT panel, pos, split, y, feature_id, round(value, 6) AS value FROM long")


def _registered(p: natural.Panel) -> DataFrame:
    """The registry with what a model would be told by: the correlation of each feature with the label on train rows."""
    from fieldaudit.operators.rankers import correlation

    score = correlation(natural.melted(p).where("split = 'train'"), ["feature_id"])
    return natural.contamination(p.registry).join(score, "feature_id", "left").select("feature_id", "position", "available", "label", "is_leak", F.round("corr", 6).alias("corr"))


add("f14_natural_registry", _each(_registered), f"""SELECT panel, feature_id, CAST(row_number() OVER (PARTITION BY panel ORDER BY i) - 1 AS INT) AS position, feature_id NOT IN {_in(_LATE)} AS available,
  CASE WHEN feature_id IN {_in(_LATE)} THEN 'POST_OUTCOME' ELSE 'LEGITIMATE' END AS label, feature_id IN {_in(_LATE)} AS is_leak, corr
  FROM (SELECT panel, unnest(map_keys(any_value(f))) AS feature_id, unnest(range(len(map_keys(any_value(f))))) AS i FROM wide GROUP BY panel)
  JOIN (SELECT panel, feature_id, CASE WHEN stddev_pop(value) > 0 AND stddev_pop(y) > 0 THEN round(abs(covar_pop(value, y) / (stddev_pop(value) * stddev_pop(y))), 6) ELSE 0 END AS corr FROM long WHERE split = 'train' GROUP BY ALL) USING (panel, feature_id)""")  # fmt: skip
add("f10_unseen_counts", _each(natural.unseen), f"SELECT panel, feature_id, split, CAST(count(*) FILTER (value = -2) AS BIGINT) AS n_unseen FROM long WHERE feature_id IN {_in(_CODED)} GROUP BY ALL")
_digest = lambda panel, feature, codes: f"SELECT '{panel}' AS panel, '{feature}' AS feature, count(*) AS n_codes, CAST(sum(CAST('0x' || substr(sha256(v || '|' || CAST(code AS BIGINT)), 1, 10) AS BIGINT)) AS VARCHAR) AS digest FROM {codes}"
add("f10_mapping_digest", _each(natural.mapping_digest), " UNION ALL ".join(_digest(*x) for x in (("orders", "o_orderpriority", "oc"), ("events", "event_type", "et"), ("events", "props", "ep"), ("customers", "title", "cn"), ("customers", "c_mktsegment", "cm"))))
add("s8_natural_audit", _each(lambda p: p.audit.drop("panel")), """SELECT 'orders' AS panel, (SELECT count(*) FROM o0) AS resolved_rows, count(*) AS rows_loaded, CAST(5000 AS BIGINT) AS row_limit,
  CASE WHEN (SELECT count(*) FROM o0) > 5000 THEN 'systematic_over_chronologically_sorted_resolved_outcomes' ELSE 'all_resolved_outcomes' END AS sampling_rule, true AS chronological_sort,
  'o_orderdate' AS sort_column, min(o_orderdate) AS time_min, max(o_orderdate) AS time_max, CAST(sum(y) AS BIGINT) AS positives FROM o2
  UNION ALL SELECT 'events', count(*), count(*), NULL, 'all_resolved_outcomes', true, 'ts', min(ts), max(ts), CAST(sum(y) AS BIGINT) FROM e2
  UNION ALL SELECT 'customers', count(*), count(*), NULL, 'all_resolved_outcomes', false, NULL, NULL, NULL, CAST(sum(y) AS BIGINT) FROM c2""")  # fmt: skip
