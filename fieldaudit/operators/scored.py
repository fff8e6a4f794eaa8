"""Areas under the curve of many scores of the same rows, exact, with a shuffle of packed steps between sorted scores.

A task scores some hundred thousand rows at once, sorts the scores of each fit and passes on a row for each range of scores: the steps from one
score to the next, whose upper bytes are zeros that compress to nothing, and the labels as bits. What falls in one range of one fit meets in one
group of some hundred thousand scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores in a range, about; rows of a unit that are looked at for the ends of its ranges; rows that a task scores at once.
RANGE, SAMPLE, ROWS = 200_000, 4_000, 250_000
#: Shares of rows that a sample by a key is told in.
SHARES = 1 << 20


def _matrix(batches: list[pa.RecordBatch]):
    """unit, x and whether y is 1 of the batches' rows, for each of their units. A missing whole number counts as 0, any other as NaN."""
    table = pa.Table.from_batches(batches)
    lists = table.column("x").combine_chunks()
    flat = lists.flatten()
    flat = flat.fill_null(0) if pa.types.is_integer(flat.type) and flat.null_count else flat
    x = flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))
    unit, y = table.column("unit").to_numpy(), table.column("y").to_numpy() == 1
    order = np.argsort(unit, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
        if len(at):
            yield int(unit[at[0]]), x[at], y[at]


def _held(batches, rows: int):
    """Lists of batches of at least so many rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield held
            held, n = [], 0
    if n:
        yield held


def _collapsed(score: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different scores of sorted ones, with the sums of p and q."""
    if not len(score):
        return score, p, q
    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    return score[first], np.add.reduceat(p, first), np.add.reduceat(q, first)


def ordered(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores s, equal where they are; NaN is the highest, with infinity."""
    if s.dtype.kind != "f":
        return s.astype(np.int64, copy=False)
    bits = (np.where(np.isnan(s), np.inf, s) + 0.0).astype(np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def unordered(key: np.ndarray) -> np.ndarray:
    """The doubles that ordered() made whole numbers of."""
    return np.where(key < 0, key ^ np.int64(2**63 - 1), key).view(np.float64)


def packed(value: np.ndarray) -> bytes:
    """The first of sorted whole numbers and the steps between them, byte by byte: first the lowest of all, at last the highest."""
    return value[:1].tobytes() + np.diff(value.view(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), steps]), dtype=np.uint64).view(np.int64)


def areas(rows: DataFrame, score: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], key: str | None = None) -> DataFrame:
    """unit, fit, n_pos, n_neg, auroc of every fit on rows (unit: whole number, y, x: array of numbers); null where a class is missing.

    score(unit, x) gives the numbers of the unit's fits and their scores of the rows of x, a column each; NaN scores are the highest. It runs in
    the tasks. Ranges end at quantiles of a sample, which decides how evenly the work is spread and nothing else. key: a column that differs by
    row; the sample is then taken by its hash, before x is made.
    """
    spark = rows.sparkSession
    sizes = {r.unit: r.n for r in rows.groupBy("unit").agg(F.count("*").alias("n")).collect() if r.unit is not None}  # units
    rows = rows.where("unit IS NOT NULL").select(F.col("unit").cast("long").alias("unit"), F.col("y").cast("int").alias("y"), "x", *([F.col(key).alias("_key")] if key else []))

    def told(unit: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit, s = score(unit, x)
        return fit, ordered(s)

    def ends(table: pa.Table) -> pa.Table:
        (unit, x, _), = _matrix(table.to_batches())
        fit, s = told(unit, x)
        s = np.sort(s, axis=0)
        n = math.ceil(sizes[unit] / RANGE)
        at = s[np.arange(1, n) * len(s) // n]
        schema = pa.schema([("unit", pa.int64()), ("fit", pa.int64()), ("ends", pa.list_(pa.int64()))])
        return pa.table({"unit": [unit] * len(fit), "fit": fit.tolist(), "ends": [np.unique(at[:, k]).tolist() for k in range(len(fit))]}, schema)

    large = {u: min(1.0, SAMPLE / n) for u, n in sizes.items() if n > RANGE}
    found = []
    if large:
        shares = F.create_map(*(F.lit(v) for u, share in large.items() for v in (u, math.ceil(share * SHARES))))
        seen = rows.where(F.pmod(F.xxhash64("_key"), F.lit(SHARES)) < F.coalesce(F.try_element_at(shares, F.col("unit")), F.lit(0))) if key else rows.sampleBy("unit", large, 1)
        found = seen.drop("_key").groupBy("unit").applyInArrow(ends, "unit long, fit long, ends array<long>").collect()  # fits
    shared = spark.sparkContext.broadcast({(r.unit, r.fit): np.array(r.ends) for r in found})

    schema = pa.schema([("unit", pa.int64()), ("fit", pa.int64()), ("part", pa.int32()), ("score", pa.binary()), ("y", pa.binary())])

    def count(batches):
        for held in _held(batches, ROWS):
            for unit, x, y in _matrix(held):
                fit, s = told(unit, x)
                names, parts, scores, labels = [], [], [], []
                for k, name in enumerate(fit.tolist()):
                    order = np.argsort(s[:, k], kind="stable")
                    value, label = s[order, k], y[order]
                    at = [0, *np.searchsorted(value, shared.value.get((unit, name), value[:0])).tolist(), len(value)]
                    for part, (i, j) in enumerate(zip(at, at[1:])):
                        if i < j:
                            names.append(name)
                            parts.append(part)
                            scores.append(packed(value[i:j]))
                            labels.append(np.packbits(label[i:j]).tobytes())
                if names:
                    yield pa.RecordBatch.from_pydict({"unit": [unit] * len(names), "fit": names, "part": parts, "score": scores, "y": labels}, schema)

    def won(table: pa.Table) -> pa.Table:
        value = [unpacked(v) for v in table.column("score").to_pylist()]
        y = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(v)) for b, v in zip(table.column("y").to_pylist(), value)]
        value, y = np.concatenate(value), np.concatenate(y).astype(np.float64)
        order = np.argsort(value, kind="stable")
        _, p, q = _collapsed(value[order], y[order], 1 - y[order])
        below = np.cumsum(q) - q
        key = {c: table.column(c)[:1].to_pylist() for c in ("unit", "fit", "part")}
        return pa.table(key | {"p": [p.sum()], "q": [q.sum()], "won": [(p * (below + q / 2)).sum()]}, pa.schema([("unit", pa.int64()), ("fit", pa.int64()), ("part", pa.int32()), *((c, pa.float64()) for c in ("p", "q", "won"))]))

    counted = rows.drop("_key").mapInArrow(count, "unit long, fit long, part int, score binary, y binary")
    part = counted.groupBy("unit", "fit", "part").applyInArrow(won, "unit long, fit long, part int, p double, q double, won double")
    lower = F.sum("q").over(Window.partitionBy("unit", "fit").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q")  # a row a range
    out = part.withColumn("won", F.col("won") + F.col("p") * lower).groupBy("unit", "fit").agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("won").alias("_won"))
    return out.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_won") / (F.col("n_pos") * F.col("n_neg")))).drop("_won")
