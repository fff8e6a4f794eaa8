"""Operator 4: best-fit packing with bounds that certify each partition, and exchange between the partitions that fall short."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.bpe import encoder, vocabulary
from fieldaudit.llm.common import cut, free, keep

SEQUENCE, END = 1024, 2
#: Documents in a partition that is packed at once, and rounds of exchange at most; after the last one, what is packed stands.
ITEMS, ROUNDS = 20_000, 5


def pieces(docs: DataFrame, path: str = "", sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids and END, cut into pieces of sequence ids from the end if longer.

    A null text is empty and gives one piece, END alone. Repeated rows give their pieces again. Extra columns aren't read.
    """

    def run(batches):
        coder = encoder(vocabulary(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(coder.encode(part.column("text"))):
                    ids = np.append(ids, END).astype("<u4")
                    n = len(ids)
                    first = n if n <= sequence else (n % sequence or sequence)
                    cuts = [0, *range(first, n + 1, sequence)]
                    data = memoryview(ids.tobytes())
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(k)
                        piece.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(data[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins of that size that these lengths need at least, by two families of dual-feasible functions and the total."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)
    x = np.arange(size + 1)
    best = -(-int((count * x).sum()) // size)
    for cutoff in range(0, size // 2 + 1):  # 1 above size - cutoff, 0 below cutoff, in proportion between
        total = int(count[size - cutoff + 1 :].sum()) * size + int((count * x)[cutoff : size - cutoff + 1].sum())
        best = max(best, -(-total // size))
    for k in range(1, 31):  # shares rounded to k-ths, but where (k + 1) x / size is whole
        scaled = (k + 1) * x
        value = np.where(scaled % size == 0, k * x, (scaled // size) * size)
        best = max(best, -(-int((count * value).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each length's bin, place in it and the bin's content, by best-fit decreasing; one set bit for each room that some bin has."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(size + 1)]
    mask, content = 0, []
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = size, len(content)
            content.append(0)
        bins[i], offset[i] = b, content[b]
        content[b] += n
        room[r - n].append(b)
        mask |= 1 << (r - n)
    return bins, offset, np.array(content, np.int64)[bins] if content else bins


def tight_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like best_fit(), but bin by bin: the longest first, then what fills the room exactly, alone or as a pair, else the longest that fits."""
    order = np.argsort(-lengths, kind="stable")
    of: list[list[int]] = [[] for _ in range(size + 1)]
    for i in order[::-1].tolist():
        of[lengths[i]].append(i)
    count = np.bincount(lengths, minlength=size + 1)
    bins, offset, content = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    top, left = size, len(lengths)

    def put(n: int) -> int:
        i = of[n].pop()
        count[n] -= 1
        bins[i], offset[i] = len(content) - 1, content[-1]
        content[-1] += n
        return size - content[-1]

    while left:
        while not count[top]:
            top -= 1
        content.append(0)
        room, left = put(top), left - 1
        while room and left:
            fits = np.flatnonzero(count[: room + 1])
            if not fits.size:
                break
            if fits[-1] == room:
                room, left = put(room), left - 1
                break
            pair = fits[(count[room - fits] > 0) & ((2 * fits != room) | (count[fits] > 1))]
            if pair.size:
                n = int(pair[-1])
                put(n)
                room, left = put(room - n), left - 2
            else:
                room, left = put(int(fits[-1])), left - 1
    return bins, offset, np.array(content, np.int64)[bins] if content else bins


def pack(items: DataFrame, sequence: int = SEQUENCE, per_part: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """items (any columns, with length from 1 to sequence) with sequence_id and offset: items of a sequence lie without gaps from 0.

    Full items are sequences of their own. The others are dealt out at random to partitions of about per_part, each packed by best fit
    decreasing and, where that misses the lower bound, again by tight_fit(). A partition whose bins equal its lower bound is certified and stays; in one with a gap, only full bins stay and the other
    documents are dealt out anew with those of all such partitions. Every round keeps whole bins or hands on rows: none is lost.
    """
    cols = items.columns
    items = cut(items.withColumn("_uid", F.monotonically_increasing_id()))
    done = items.where(F.col("length") >= sequence).select(*cols, (F.col("_uid") + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = items.where(F.col("length") < sequence)
    kinds = ", ".join(f"`{n}` {t}" for n, t in todo.dtypes)

    def run(table: pa.Table) -> pa.Table:
        keep("packing")
        lengths = table.column("length").to_numpy()
        bound = lower_bound(lengths, sequence)
        used = lambda x: int(x[0].max()) + 1 if len(x[0]) else 0
        found = best_fit(lengths, sequence)
        if used(found) > bound:
            found = min(found, tight_fit(lengths, sequence), key=used)
        bins, offset, content = found
        certified = used(found) <= bound
        for name, x in (("_bin", bins), ("offset", offset), ("_stays", certified | (content == sequence))):
            table = table.append_column(name, pa.array(x))
        return table

    for turn in range(rounds):
        parts = max(1, -(-todo.count() // per_part))
        dealt = todo.withColumn("_part", F.pmod(F.xxhash64(F.col("_uid"), F.lit(turn)), F.lit(parts)))
        packed = cut(dealt.groupBy("_part").applyInArrow(run, f"{kinds}, _part long, _bin long, offset long, _stays boolean"))
        last = parts == 1 or turn == rounds - 1
        stays = packed if last else packed.where("_stays")
        done = done.union(stays.select(*cols, (F.lit(turn << 56) + F.shiftleft("_part", 20) + F.col("_bin")).alias("sequence_id"), "offset"))
        if last:
            break
        todo = packed.where("NOT _stays").select(todo.columns)
    return done


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
