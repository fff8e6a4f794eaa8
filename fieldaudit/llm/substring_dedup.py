"""Operator 1: passages that repeat across documents, by compact windows.

For a hash function, a compact window (left, place, right) stands for every run of shingles that begins in [left, place], ends in
[place, right] and so has its smallest hash at place: it is a node of the Cartesian tree over the hashes. Only nodes that span a whole
passage are kept, about two for each passage length of text. Windows of equal smallest hash meet in a join; where the windows of two
documents overlap, their runs have that signature in common, and pairs with enough of them are verified on the texts themselves.

A window is compared with the first of its key only. Where more than two share a key and a context, the runs of a passage's length that
verification left in them are then joined as a whole, so a passage that is word for word in two documents is found whatever came first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.llm.common import Scratch, cut, keep, release, small
from fieldaudit.llm.hashing import _STEP, SHINGLE, chunks, mix, utf8, words
from fieldaudit.llm.near_dup import PERCENT, keyed

#: Words in a passage at least, hash functions, and functions that must agree where the words around the place differ.
PASSAGE, FUNCTIONS, AGREE = 50, 4, 2
#: Shingles in a passage at least, and on one side of a place that make a context: of any place in a passage, one side has as many.
SPAN = PASSAGE - SHINGLE + 1
CONTEXT = (SPAN + 1) // 2 - 2
#: Documents whose windows are combined at once.
ROWS = 2_500
_SEEDS = np.random.default_rng(5).integers(1, 2**62, 16, dtype=np.uint64)


def compact_windows(s: np.ndarray, valid: np.ndarray, seed: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, place, right) of the nodes of the Cartesian tree over hashes of s that span at least so many shingles; trees end where not valid.

    Ties go to the earlier place. Minima over runs of 1, 2, 4.. shingles give first the nodes, then each one's reach to both sides.
    """
    n = len(s)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none
    bits = np.uint64(n.bit_length())
    v = np.where(valid, (((mix(s ^ _SEEDS[seed]) >> bits) | np.uint64(1)) << bits) | np.arange(n, dtype=np.uint64), np.uint64(0))
    levels = [v]
    while 2 << (len(levels) - 1) <= n:
        w = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
        if not levels[-1].any():
            break
    k = span.bit_length() - 1
    if k >= len(levels):
        return none, none, none
    low = np.minimum(levels[k][: n - span + 1], levels[k][span - (1 << k) : span - (1 << k) + n - span + 1])
    place = np.unique(low[low > 0] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    own = v[place]
    left, right = place.copy(), place + 1
    for k in range(len(levels) - 1, -1, -1):
        w, level = 1 << k, levels[k]
        go = right + w <= n
        go &= level[np.minimum(right, len(level) - 1)] > own
        right[go] += w
        go = left >= w
        go &= level[np.clip(left - w, 0, len(level) - 1)] > own
        left[go] -= w
    return left, place, right - 1


def _shingled(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle that begins at each word of several texts, whether it lies within its text, and where texts' words begin."""
    hashes, _, _, first = words(data, at)
    n = len(hashes)
    s = np.full(n, SHINGLE, np.uint64)
    valid = np.ones(n, bool)
    for k in range(SHINGLE):
        s[: n - k] += hashes[k:] * _STEP[k]
    for k in range(1, SHINGLE):
        end = first[1:] - k
        valid[end[end >= first[:-1]]] = False
    return mix(s), valid, first


def windows(docs: DataFrame) -> DataFrame:
    """One row per window: key, right and left (short hashes of its context on each side), f, node (the document's hash), place and
    how far the window reaches below and above it (low, high); places count in words.

    Windows of ROWS documents with the same key and both contexts are combined: that of the smallest hash is in for all, n in number; the others name it
    (of, of_place..).
    """
    schema = "key long, right int, left int, f int, node long, place int, low int, high int, n int, of long, of_place int, of_low int, of_high int"

    def run(batches):
        keep("substring_dedup")
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            data, at = utf8(batch.column("text"))
            node = batch.column("hash").to_numpy()
            found: list[list[np.ndarray]] = [[] for _ in range(8)]
            for i, j in chunks(at):
                s, valid, first = _shingled(data, at[i : j + 1])
                total = np.concatenate([[np.uint64(0)], np.cumsum(s, dtype=np.uint64)])
                for f in range(FUNCTIONS):
                    left, place, right = compact_windows(s, valid, f)
                    if not len(place):
                        continue
                    doc = np.searchsorted(first, place, "right") - 1
                    begin, end = first[doc], first[doc + 1] - SHINGLE + 1
                    alone = mix(place.astype(np.uint64) ^ mix(node[doc + i].view(np.uint64)))
                    r = np.where(place + CONTEXT <= end, total[np.minimum(place + CONTEXT, len(s))] - total[place], alone)
                    l = np.where(place - CONTEXT + 1 >= begin, total[place + 1] - total[np.maximum(place - CONTEXT + 1, 0)], alone)  # noqa: E741
                    key = mix(s[place] + np.uint64(f + 1))
                    for x, y in zip(found, (key, r, l, np.full(len(place), f), node[doc + i], place - begin, place - left, right - place)):
                        x.append(y)
            if not found[0]:
                continue
            order = np.lexsort((np.concatenate(found[5]), np.concatenate(found[4])))  # as in the join: a window is given up for a smaller hash
            key, r, l, f, doc, place, left, right = (np.concatenate(x)[order] for x in found)  # noqa: E741
            _, lead, back = np.unique(mix(key ^ mix(r ^ mix(l))), return_index=True, return_inverse=True)
            n = np.bincount(back)[back]
            lead = lead[back]
            follows = lead != np.arange(len(lead))
            key = np.where(follows, mix(mix(doc.view(np.uint64)) + place.astype(np.uint64) + np.uint64(f.max() + 7)), key)
            of = [pa.array(x[lead], t, mask=~follows) for x, t in ((doc, pa.int64()), (place, pa.int32()), (left, pa.int32()), (right, pa.int32()))]
            columns = [pa.array(key.view(np.int64)), *(pa.array((mix(x) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for x in (r, l)), pa.array(f, pa.int32()), pa.array(doc), *(pa.array(x, pa.int32()) for x in (place, left, right, n)), *of]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return keyed(docs).select("hash", "text").mapInArrow(run, schema)


def partners(docs: DataFrame) -> DataFrame:
    """x with a window (f, place, low, high), one it is compared with (a, whether strong, by a context) and open: whether more than two share a context."""
    w = windows(docs)
    mine = F.struct("node", "place", "low", "high")
    by = {"plain": Window.partitionBy("key"), "after": Window.partitionBy("key", "right"), "before": Window.partitionBy("key", "left")}
    found = {"last": F.max("node").over(by["plain"]), "n_after": F.sum("n").over(by["after"]), "n_before": F.sum("n").over(by["before"])}
    w = w.withColumns(found | {k: F.min(mine).over(c) for k, c in by.items()})
    other = F.struct(F.col("of").alias("node"), F.col("of_place").alias("place"), F.col("of_low").alias("low"), F.col("of_high").alias("high"))
    w = w.withColumn("open", F.col("of").isNotNull() | (F.greatest("n_after", "n_before") > 2)).where("of IS NOT NULL OR open OR plain.node < last")
    tag = lambda c, strong: F.struct(c.alias("a"), F.lit(strong).alias("strong"))
    told = F.when(F.col("of").isNotNull(), F.array(tag(other, True))).otherwise(F.array(tag(F.col("after"), True), F.when(F.expr("before <> after"), tag(F.col("before"), True)), F.when(F.expr("plain <> after AND plain <> before"), tag(F.col("plain"), False))))
    each = w.select(F.col("node").alias("x"), "f", "place", "low", "high", "open", F.explode(told).alias("t")).where("t IS NOT NULL")  # a window that is first in several ways is named once
    each = each.select("x", "f", "place", "low", "high", "open", "t.a", "t.strong")
    # both windows, laid one over the other at their places, have to share a run that a passage fits in
    fits = (F.col("a.node") != F.col("x")) & (F.least("low", "a.low") + F.least("high", "a.high") + 1 >= SPAN * PERCENT // 100)
    return each.withColumn("fits", fits).where("fits OR open")


def candidates(each: DataFrame) -> DataFrame:
    """Pairs of documents x and a (node hashes) with the windows, a list of seeds, by which they may share a passage."""
    seed = F.struct(F.col("place").alias("x_place"), F.col("low").alias("x_low"), F.col("high").alias("x_high"), F.col("a.place").alias("a_place"), F.col("a.low").alias("a_low"), F.col("a.high").alias("a_high"))
    pairs = each.where("fits").groupBy("x", F.col("a.node").alias("a")).agg(F.max("strong").alias("strong"), F.collect_set("f").alias("fs"), F.collect_set(seed).alias("seeds"))
    return pairs.where((F.col("strong")) | (F.size("fs") >= AGREE)).select("x", "a", "seeds")


def run_keys(s: np.ndarray) -> np.ndarray:
    """A hash of the SPAN shingles from each place of s on, in their order: equal where a passage is equal word for word."""
    n = len(s)
    if n < SPAN:
        return np.zeros(0, np.uint64)
    base = int(_SEEDS[-1]) | 1
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - SPAN, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(s * power, dtype=np.uint64)])
    return mix((total[SPAN:] - total[:-SPAN]) * back)


def _structs(lists: pa.Array, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each list of structs of whole numbers begins and ends among all, and their fields. A null list is empty."""
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
    flat = lists.flatten()
    return ends, [flat.field(k).to_numpy(zero_copy_only=False).astype(int) for k in range(fields)]


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places is in one of the ranges."""
    change = np.bincount(np.minimum(begin, n), minlength=n + 1) - np.bincount(np.minimum(end, n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def left_over(docs: DataFrame, each: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Passages, as in found, that are word for word in two documents and not wholly in found: by runs of PASSAGE words in the open windows.

    Each run names the smallest hash of those that have it; runs that found covers aren't asked, so a document's rows are bounded by its words.
    """
    at = each.where("open").groupBy("x").agg(F.collect_set(F.struct("place", "low", "high")).alias("at"))
    at = scratch.table(at, "open")
    spans = found.groupBy("x").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    rows = texts_of(docs, at.select(F.col("x").alias("hash"))).withColumnRenamed("hash", "x").join(at, "x").join(spans, "x", "left")

    def run(batches):
        keep("substring_dedup")
        for batch in (b.slice(lo, 200) for b in batches for lo in range(0, b.num_rows, 200)):
            data, text_at = utf8(batch.column("text"))
            keys, nodes, places = [], [], []
            node = batch.column("x").to_numpy()
            (asked_at, (place, low, high)), (known_at, (begin, end)) = _structs(batch.column("at"), 3), _structs(batch.column("spans"), 2)
            asked_lo = np.maximum(place - np.minimum(low, SPAN - 1), 0)
            asked_hi = np.maximum(place + np.minimum(0, high - SPAN + 1) + 1, asked_lo)
            for i, j in chunks(text_at):
                s, valid, first = _shingled(data, text_at[i : j + 1])
                for k, (b, e) in enumerate(zip(first, first[1:]), i):
                    key = run_keys(s[b:e][valid[b:e]])
                    asked, known = slice(asked_at[k], asked_at[k + 1]), slice(known_at[k], known_at[k + 1])
                    use = _covered(asked_lo[asked], asked_hi[asked], len(key))
                    gone = np.concatenate([[0], np.cumsum(_covered(begin[known], end[known], e - b))])
                    place = np.flatnonzero(use & (gone[PASSAGE : PASSAGE + len(key)] - gone[: len(key)] < PASSAGE))
                    keys.append(key[place])
                    nodes.append(np.full(len(place), node[k]))
                    places.append(place)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(places), pa.int32())], ["key", "x", "place"])

    runs = scratch.table(rows.select("x", "text", "at", "spans").mapInArrow(run, "key long, x long, place int"), "runs")
    first = runs.groupBy("key").agg(F.min(F.struct("x", "place")).alias("a"), F.max("x").alias("last")).where("a.x < last").select("key", F.col("a.x").alias("a"), F.col("a.place").alias("a_place"))
    same = runs.join(small(cut(first)), "key").where("x > a").select("x", "a", "place", "a_place")
    line = ["x", "a", F.col("place") - F.col("a_place")]
    same = same.withColumn("_run", F.col("place") - F.row_number().over(Window.partitionBy(*line).orderBy("place")))
    out = same.groupBy(*line, "_run").agg(*(f(c).cast("int").alias(n) for f, c, n in ((F.min, "place", "begin"), (F.max, "place", "end"), (F.min, "a_place", "a_begin"), (F.max, "a_place", "a_end"))))
    return out.select("x", "a", "begin", (F.col("end") + PASSAGE).alias("end"), "a_begin", (F.col("a_end") + PASSAGE).alias("a_end"), F.lit(1.0).alias("similarity"))


def passages(x: np.ndarray, a: np.ndarray, seeds: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(begin, end, begin, end, similarity) in words of x and of a: passages of PASSAGE words or more that are similar by their shingles.

    seeds: rows of (place, reach below, reach above) in x and in a. Equal shingles are sought where two windows overlap; runs of them are joined as long
    as eight in nine shingles are equal (a Jaccard similarity of 0.8) and the places in a go along.
    """
    mate = np.full(len(x), -1)
    for place, low, high, other, a_low, a_high in seeds.tolist():
        d = place - other
        lo, hi = max(place - min(low, a_low), 0, d), min(place + min(high, a_high), len(x) - 1, len(a) - 1 + d)
        if lo > hi or (mate[lo] == lo - d and mate[hi] == hi - d and (mate[lo : hi + 1] >= 0).all()):
            continue
        at = lo + np.flatnonzero(x[lo : hi + 1] == a[lo - d : hi + 1 - d])
        at = at[mate[at] < 0]
        mate[at] = at - d
    hit = np.flatnonzero(mate >= 0)
    if not len(hit):
        return []
    cut_at = np.flatnonzero((np.diff(hit) > 1) | (np.diff(mate[hit]) != 1)) + 1
    runs = [(int(r[0]), int(r[-1]) + 1) for r in np.split(hit, cut_at)]
    out = []
    k = 0
    while k < len(runs):
        begin, end = runs[k]
        equal, start = end - begin, k
        k += 1
        while k < len(runs):
            b, e = runs[k]
            apart = int(mate[b] - mate[end - 1])
            if not 0 < apart <= b - end + 1 + SHINGLE * 4 or 9 * (equal + e - b) < 8 * (e - begin):
                break
            equal, end, k = equal + e - b, e, k + 1
        for begin, end in [(begin, end), *(runs[start:k] if k > start + 1 else [])]:  # if not the whole, then its equal runs
            if end - begin + SHINGLE - 1 < PASSAGE:
                continue
            p, q = int(mate[begin]), int(mate[end - 1]) + 1
            u, v = np.unique(x[begin:end]), np.unique(a[p:q])
            same = len(np.intersect1d(u, v, assume_unique=True))
            if 100 * same >= PERCENT * (len(u) + len(v) - same):
                out.append((begin, end + SHINGLE - 1, p, q + SHINGLE - 1, same / (len(u) + len(v) - same)))
                if (begin, end) not in runs[start:k]:
                    break
    return out


FOUND = "x long, a long, begin int, end int, a_begin int, a_end int, similarity double"


def repeats(docs: DataFrame) -> DataFrame:
    """x, a (hashes of documents), begin, end, a_begin, a_end, similarity: passages of x that are in a too.

    Of all documents with a passage, each names an earlier one in the order of hashes, so the passage stays in at least one if those named
    x give it up; n documents give about n rows, not a row for each pair. What is word for word in two documents is always found. Null, empty and short texts have none. Rows alike in id and
    text are one document. A passage that is only repeated within one document isn't reported.
    """
    with Scratch(docs.sparkSession) as scratch:
        each = scratch.table(partners(docs), "each")
        pairs = scratch.table(candidates(each), "pairs")
        release(docs.sparkSession)
        found = _verified(docs, pairs)
        release(docs.sparkSession)
        return cut(found.union(left_over(docs, each, found, scratch)))


def texts_of(docs: DataFrame, need: DataFrame) -> DataFrame:
    """hash and text of the documents in need (hash, without repeats), once each."""
    rows = keyed(docs).select("hash", "text")
    alike = keyed(docs).groupBy("hash").agg(F.count("*").alias("rows")).where("rows > 1")
    found = rows.join(small(cut(need.join(alike, "hash", "left"))), "hash")
    once = found.where("rows IS NOT NULL").dropDuplicates(["hash"])  # rows alike in id and text
    return found.where("rows IS NULL").union(once.select(found.columns)).select("hash", "text")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    texts = texts_of(docs, pairs.select(F.col("x").alias("hash")).union(pairs.select("a")).distinct())
    both = pairs.join(texts.select(F.col("hash").alias("x"), F.col("text").alias("x_text")), "x").join(texts.select(F.col("hash").alias("a"), F.col("text").alias("a_text")), "a")

    def run(batches):
        keep("substring_dedup")
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sides = []
                for c in ("x", "a"):
                    _, once, back = np.unique(part.column(c).to_numpy(), return_index=True, return_inverse=True)  # a text in several pairs is read once
                    data, at = utf8(part.column(f"{c}_text").take(pa.array(once)))
                    rows: list[np.ndarray] = []
                    for i, j in chunks(at):
                        s, valid, first = _shingled(data, at[i : j + 1])
                        rows += [s[b:e][valid[b:e]] for b, e in zip(first, first[1:])]
                    sides.append([rows[k] for k in back])
                seeds = part.column("seeds")
                flat = np.stack([seeds.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(6)], 1) if part.num_rows else np.zeros((0, 6))
                ends = np.concatenate([[0], np.cumsum(seeds.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
                out = [(k, *p) for k in range(part.num_rows) for p in passages(sides[0][k], sides[1][k], flat[ends[k] : ends[k + 1]])]
                row = pa.array([o[0] for o in out], pa.int64())
                columns = [part.column("x").take(row), part.column("a").take(row), *(pa.array([o[i] for o in out], pa.int32()) for i in range(1, 5)), pa.array([o[5] for o in out], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])

    return cut(both.select("x", "a", "x_text", "a_text", "seeds").mapInArrow(run, FOUND))


def _stripped(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the words of its spans."""
    keep("substring_dedup")
    out = []
    for t, gone_at in zip(text.to_pylist(), spans.to_pylist()):
        data, at = utf8(pa.array([t or ""]))
        _, starts, _, _ = words(data, at)
        starts = np.append(starts, len(data))
        gone = np.zeros(len(data), bool)
        for s in gone_at:
            gone[starts[min(s["begin"], len(starts) - 1)] : starts[min(s["end"], len(starts) - 1)]] = True
        out.append(data[~gone].tobytes().decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the passages of found; what stands between words stays. A text may become empty; n_chars, where there is one, follows.
    Columns of any names pass through."""
    spans = found.groupBy(F.col("x").alias("hash")).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    rows = rows.join(small(cut(spans)), "hash", "left")
    cleaned = rows.where("spans IS NOT NULL").withColumn("cleaned", F.arrow_udf(_stripped, "string")("row.text", "spans"))
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.where("spans IS NULL").select("row.*").union(cleaned.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without passages that stay in another document."""
    return without(docs, repeats(docs))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, source_doc_id and the passage's words in both: begin, end, source_begin, source_end; and similarity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeats(docs)
    name = keyed(docs).select("hash", "doc_id")
    need = small(cut(found.select(F.col("x").alias("hash")).union(found.select("a")).distinct()))
    ids = cut(name.join(need, "hash", "left_semi").distinct())
    out = found.join(ids.select(F.col("hash").alias("x"), "doc_id"), "x").join(ids.select(F.col("hash").alias("a"), F.col("doc_id").alias("source_doc_id")), "a")
    return out.select("doc_id", "begin", "end", "source_doc_id", F.col("a_begin").alias("source_begin"), F.col("a_end").alias("source_end"), "similarity")
