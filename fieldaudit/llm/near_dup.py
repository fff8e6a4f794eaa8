"""Operator 7: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by parity sketches.

A set's hashes are XORed into a sketch; every element of the symmetric difference flips one place, so the Hamming distance of two sketches
is a lower bound of the symmetric difference d, and similar sets of sizes a and b have 9 d <= a + b. Sets of a size band share a number of
blocks so much above the largest d that some block of two similar sets has no difference and isn't empty: its value is the join key.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.llm.common import SPACE, Scratch, components, cut, keep, release, small
from fieldaudit.llm.hashing import SHINGLE, mix, shingled

#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of the sketch by which candidates are compared, and the growth of the size bands.
BITS, GROWTH = 1024, 1.6
#: Sets over this size also have a wide sketch, of about as many bits as elements: so many flip most of a narrow one.
WIDE = 800
#: Documents whose sketches are made at once.
ROWS = 2_500
#: A key of more rows than this is hot.
HOT = 64
_WORD = re.compile(f"[^{SPACE}]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def spare(most: int) -> int:
    """Blocks without a difference that two similar sets have in common beyond the first: so many hot keys of a set can be done without."""
    return 2 + most // 20


@cache
def bands() -> np.ndarray:
    """Lower edges of the size bands."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
    return np.array(edges)


def parity(u: np.ndarray, bits: int) -> np.ndarray:
    """The XOR of one place of so many (a power of two) for each hash, packed. Halves XORed are the sketch of half as many bits."""
    return np.packbits((np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def block_keys(u: np.ndarray) -> np.ndarray:
    """Join keys of a set of hashes. Two similar sets have one in common.

    In each band that the set's partners can be the larger set of, d is at most 2 * (upper edge - 1) / 9 = most. There are about 1.35
    times as many blocks; a set gives the values of its first most + 1 + spare blocks that aren't empty. Of these, 1 + spare have no
    difference: and the set of the two whose row of blocks ends first is within the other's. A set with fewer such blocks also gives its
    empty ones among the first most + 1 + spare, which serves two such sets.
    """
    n = len(u)
    edges = bands()
    out = []
    for j in range(int(np.searchsorted(edges, n, "right")) - 1, int(np.searchsorted(edges, n * 100 // PERCENT, "right"))):
        most = 2 * (int(edges[j + 1]) - 1) // 9
        first = most + 1 + (spare(most) if most else 0)
        blocks = max(int(1.35 * (most + 1)) + 2 * (most > 0), first)
        value = np.zeros(blocks, np.uint64)
        np.bitwise_xor.at(value, ((u >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64), u)
        full = np.flatnonzero(value)
        use = full[:first] if len(full) >= first else np.union1d(full, np.arange(first))
        out.append(mix(value[use] ^ mix((use + (j << 40)).astype(np.uint64))))
    return np.concatenate(out)


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: uid, doc_id, hash (of id and text), n (set size), print (of the set), s0.. (sketch), keys, twin.

    Among those made at once, the first of equal sets has the keys and is the others' twin: very many copies leave each task few times.
    """
    words = BITS // 64
    schema = f"uid long, doc_id long, hash long, n long, print binary, {', '.join(f's{i} long' for i in range(words))}, keys array<long>, twin long, wide binary"

    def run(batches):
        keep("near_dup")
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            uid = batch.column("uid").to_numpy()
            size, prints, sketch, own, twin, wide = [], [], [], [], [], []
            first: dict[bytes, int] = {}
            for k, s in enumerate(shingled(batch.column("text"))):
                u = np.unique(s)
                size.append(len(u))
                prints.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                sketch.append(parity(u, BITS).view(np.int64))
                wide.append(parity(u, 1 << (len(u) - 1).bit_length()).tobytes() if len(u) > WIDE else None)
                f = first.setdefault(prints[-1], k) if len(u) else k
                twin.append(int(uid[f]) if f != k else None)
                own.append(block_keys(u).view(np.int64) if f == k and len(u) else np.zeros(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            columns = [batch.column("uid"), batch.column("doc_id"), batch.column("hash"), pa.array(size, pa.int64()), pa.array(prints, pa.binary())]
            columns += [pa.array(x) for x in (np.stack(sketch, 1) if sketch else np.zeros((words, 0), np.int64))]
            columns += [pa.ListArray.from_arrays(at, pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))), pa.array(twin, pa.int64()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "hash", "n", "print", *(f"s{i}" for i in range(words)), "keys", "twin", "wide"])

    return keyed(docs).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.withColumn("hash", F.xxhash64("doc_id", "text"))


def may_be_similar(info: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of uids that sizes and sketches don't rule out, with same: whether the sets are equal."""
    side = lambda p: info.select(*(F.col(c).alias(f"{p}_{c}") for c in info.columns))
    both = pairs.join(side("l"), F.col("a") == F.col("l_uid")).join(side("r"), F.col("b") == F.col("r_uid"))
    return both.where(_near("l_", "r_")).select("a", "b", F.col("l_print").eqNullSafe(F.col("r_print")).alias("same"))


def _near(l: str, r: str):  # noqa: E741
    n, m = F.col(f"{l}n"), F.col(f"{r}n")
    apart = sum((F.bit_count(F.col(f"{l}s{i}").bitwiseXOR(F.col(f"{r}s{i}"))) for i in range(1, BITS // 64)), F.bit_count(F.col(f"{l}s0").bitwiseXOR(F.col(f"{r}s0"))))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * apart <= (100 - PERCENT) * (n + m))


def not_far(wides: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) without those that wide sketches (uid, n, wide) rule out."""
    pairs = cut(pairs)
    side = lambda p, u: wides.select(F.col("uid").alias(u), F.col("n").alias(f"{p}n"), F.col("wide").alias(p))
    both = side("x", "a").join(small(pairs), "a", "right").join(side("y", "b"), "b", "left")

    def run(batches):
        keep("near_dup")
        for batch in batches:
            near = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "xn", "yn"))):
                if x is None or y is None:
                    near.append(True)
                    continue
                a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
                near.append((100 + PERCENT) * int(np.bitwise_count(a ^ b).sum()) <= (100 - PERCENT) * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in "ab"], ["a", "b"])

    return both.select("a", "b", "x", "y", "xn", "yn").mapInArrow(run, "a long, b long")


def similar_words(x: str, y: str) -> bool:
    """Whether two texts are similar, by their words themselves."""
    a, b = (_sets(t) for t in (x, y))
    same = len(a & b)
    return same > 0 and 100 * same >= PERCENT * (len(a) + len(b) - same)


def _sets(text: str) -> set[tuple[str, ...]]:
    w = _WORD.findall(text.translate(_LOWER))
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def verified(docs: DataFrame, info: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar, by their whole sets: hashes rule pairs out, words decide. Only the texts that a pair needs are moved."""
    pairs = cut(pairs)
    again = info.groupBy("hash").agg(F.count("*").alias("rows")).where("rows > 1")
    need = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct().join(info.select("uid", "hash"), "uid").join(again, "hash", "left")
    found = keyed(docs).select("hash", "text").join(small(cut(need)), "hash")
    once = found.where("rows IS NOT NULL").dropDuplicates(["uid"])  # rows that are alike in id and text
    texts = found.where("rows IS NULL").union(once.select(found.columns)).select("uid", "text")
    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("x")).join(small(pairs), "a")
    both = left.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        keep("near_dup")
        for batch in batches:
            ok = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for k, (x, y) in enumerate(zip(shingled(part.column("x")), shingled(part.column("y")))):
                    x, y = np.unique(x), np.unique(y)
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    near = 100 * same >= PERCENT * (len(x) + len(y) - same)
                    ok.append(near and similar_words(part.column("x")[k].as_py(), part.column("y")[k].as_py()))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and hash per row of docs: component_id is the smallest doc_id that links reach, itself included.

    Documents with an equal key are compared with the first of them; documents that are then in different components though they have a
    key in common are all compared, so no link that could join two components is left out and copies cost one comparison each.
    Null and empty texts have no shingles and no links; rows with equal ids are separate nodes; a null doc_id gets the smallest id of its
    component, null if alone. Extra columns aren't read.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        s = scratch.table(sketches(docs), "sketches")
        info = cut(s.drop("keys", "twin", "wide"))
        wides = cut(s.where("wide IS NOT NULL").select("uid", "n", "wide"))
        of_key = Window.partitionBy("key")
        key = s.select("uid", F.explode("keys").alias("key")).withColumns({"lead": F.min("uid").over(of_key), "last": F.max("uid").over(of_key)})
        shared = scratch.table(key.where("lead < last").drop("last"), "shared")
        twins = s.where("twin IS NOT NULL").select(F.col("uid").alias("a"), F.col("twin").alias("b"))
        star = cut(twins).union(shared.where("uid > lead").select("uid", F.col("lead").alias("b"))).distinct()
        star = cut(star)
        scratch.drop("sketches")
        release(spark)
        found = cut(may_be_similar(info, star))
        links = cut(found.where("same").select("a", "b").union(verified(docs, info, not_far(wides, found.where("NOT same").select("a", "b")))))
        comp = cut(components(links))
        rest = cut(not_far(wides, across(info, shared, comp)))
        if not rest.isEmpty():
            comp = cut(components(links.union(verified(docs, info, rest))))
        rows = info.select("uid", "doc_id", "hash", F.col("n").alias("n_shingles")).join(small(comp).withColumnRenamed("node", "uid"), "uid", "left")
        alone, linked = rows.where("comp IS NULL"), cut(rows.where("comp IS NOT NULL"))
        low = linked.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("low"))
        linked = linked.join(small(cut(low)), "comp").select("doc_id", "n_shingles", F.col("low.doc_id").alias("component_id"), "hash", (F.col("uid") == F.col("low.uid")).alias("first"))
        return cut(linked.union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "hash", F.lit(True).alias("first"))))


def across(info: DataFrame, shared: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs with a key in common that are in different components, were not compared yet and aren't ruled out by sizes and sketches.

    All rows of a key of up to HOT rows are compared. Two similar sets have 1 + spare keys in common, so a set of spare hot keys or fewer
    shares one with its partner that isn't hot: hot keys are only compared between sets that have more of them.
    """
    of_key = Window.partitionBy("key")
    member = shared.join(small(comp).withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    member = member.withColumns({"low": F.min("comp").over(of_key), "high": F.max("comp").over(of_key), "rows": F.count("*").over(of_key)})
    member = cut(member.where("low < high AND uid > lead").select("key", "uid", "comp", (F.col("rows") > HOT).alias("hot")))
    heavy = member.where("hot").groupBy("uid").agg(F.count("*").alias("hots")).join(info.select("uid", "n"), "uid")
    heavy = cut(heavy.where(F.col("hots") > spare(0) + F.floor(F.floor(2 * F.col("n") / 9) / 20)).select("uid"))
    sides = info.drop("doc_id", "hash", "print")
    found = [_pairs(member.where("NOT hot").select("key", "uid", "comp").join(sides, "uid"))]
    if not heavy.isEmpty():
        found.append(_pairs(member.where("hot").select("key", "uid", "comp").join(small(heavy), "uid").join(sides, "uid")))
    return found[0].union(found[1]).distinct() if len(found) > 1 else found[0].distinct()


def _pairs(wide: DataFrame) -> DataFrame:
    """Pairs of different components with an equal key that sizes and sketches don't rule out."""
    side = lambda p: wide.select(*(F.col(c).alias(f"{p}_{c}") for c in wide.columns))
    on = (F.col("l_key") == F.col("r_key")) & (F.col("l_uid") < F.col("r_uid")) & (F.col("l_comp") != F.col("r_comp")) & _near("l_", "r_")
    return side("l").join(side("r"), on).select(F.col("r_uid").alias("a"), F.col("l_uid").alias("b"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. Columns of any names pass through."""
    found = near_duplicates(docs)
    each = found.groupBy("hash").agg(F.count("*").alias("n"), F.max("first").alias("first")).where("n > 1 OR NOT first").select("hash", "first")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    rows = rows.join(small(cut(each)), "hash", "left")
    return rows.where("first IS NULL").union(rows.where("first").dropDuplicates(["hash"])).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = rf"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS rid, doc_id,
           list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{SPACE}]+'), lambda x: x <> '') AS w
    FROM documents),
s AS (SELECT rid, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
r(rid, c) AS (SELECT rid, rid FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.rid)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (rid) JOIN (SELECT r.rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.c GROUP BY 1) m ON m.rid = w.rid
"""
