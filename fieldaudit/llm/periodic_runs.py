"""Operator 12: maximal periodic runs of words, by a dictionary of basic factors (names for the factors of each power-of-two length)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from fieldaudit.llm.common import free, keep
from fieldaudit.llm.hashing import chunks, utf8

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4


def dictionary(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """For k = 0, 1, ..: names[i] of the factor symbols[i:i + 2**k]; equal factors have equal names, and one that occurs once has -1.

    A factor is named by the names of its halves, so factors whose halves aren't both repeated are done with; the dictionary ends at the
    first length without any repeat.
    """
    names, length = symbols, 1
    while True:
        at = np.flatnonzero(names[: max(0, len(names) - (length >> 1))] >= 0) if length > 1 else np.arange(len(names))
        if length > 1:
            half = length >> 1
            at = at[names[at + half] >= 0]
            pair = (names[at].astype(np.int64) << 32) | names[at + half]
        else:
            pair = names.astype(np.int64)
        _, name, count = np.unique(pair, return_inverse=True, return_counts=True)
        twice = count[name] > 1
        if not twice.any():
            return
        out = np.full(len(symbols), -1, np.int32)
        out[at[twice]] = name[twice]
        yield out
        names, length = out, length * 2


def proposals(names: np.ndarray, length: int) -> np.ndarray:
    """Rows (place, period): the first places of progressions of occurrences of one factor whose next is at most twice its length away.

    Neighbouring places with the same distance tell of the same run, so only the first of them is proposed.
    """
    at = np.flatnonzero(names >= 0)
    order = at[np.argsort(names[at], kind="stable")]
    follows = names[order[1:]] == names[order[:-1]]
    place, gap = order[:-1][follows], np.diff(order)[follows]
    near = gap <= 2 * length
    step = np.zeros(len(names) + 1, np.int64)
    step[place[near] + 1] = gap[near]
    first = np.flatnonzero((step[1:] > 0) & (step[1:] != step[:-1]))
    return np.stack([first, step[first + 1]], 1)


def agree(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols agree from places a and b on (back: before them), by the names from the longest length to the shortest, and once
    more from the longest while whole factors agree."""
    total, live = np.zeros(len(a), np.int64), np.arange(len(a))
    n = len(levels[0])
    while live.size:
        grown = np.zeros(len(live), bool)
        for k in range(len(levels) - 1, -1, -1):
            size = 1 << k
            x = (a[live] - total[live] - size) if back else a[live] + total[live]
            y = (b[live] - total[live] - size) if back else b[live] + total[live]
            inside = (x >= 0) & (y < n)
            same = np.zeros(len(live), bool)
            u, v = levels[k][x[inside]], levels[k][y[inside]]
            same[inside] = (u == v) & (u >= 0)
            total[live[same]] += size
            if k == len(levels) - 1:
                grown = same
        live = live[grown]
    return total


def runs(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of symbols (whole numbers from 0 to 2**31), by start, then period.

    A run of period q has at least 4q symbols, so the factors of the first power of two from q on recur after q everywhere in its first
    half, and not sooner, as q is its smallest period: the next occurrence proposes q itself. Extending a proposal both ways gives a whole
    stretch of that period, and if that is long enough the period is its smallest, as a smaller one would have made the next occurrence
    nearer.
    """
    levels, found = [], []
    for k, names in enumerate(dictionary(symbols)):
        levels.append(names)
        found.append(proposals(names, 1 << k))
    if not found:
        return np.zeros((0, 3), np.int64)
    place, period = np.unique(np.concatenate(found), axis=0).T
    start = place - agree(levels, place, place + period, True)
    length = place + agree(levels, place, place + period, False) + period - start
    good = (length >= LEAST) & (length >= TIMES * period)
    out = np.unique(np.stack([start, length, period], 1)[good], axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One row of symbols for all texts, equal words of all of them alike, each text closed by a symbol of its own; and where each text starts in it."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    out = np.zeros(int(at[-1]), np.int64)
    for k, t in enumerate(texts):
        out[at[k] : at[k + 1] - 1] = [known.setdefault(w, len(known)) for w in t]
    out[at[1:] - 1] = len(known) + np.arange(len(texts))
    return out, at


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """words, in one document of ten with a period: from word a on, word i is word a + (i - a) % p. A null id leaves them as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times, rest = divmod(n - a, p)
    unit = words[a : a + p]
    return words[:a] + unit * times + unit[:rest]


def longest(found: np.ndarray) -> tuple:
    """start, length, period, exponent_milli of the run of the greatest length / period, compared exactly; of equal ones the first in found."""
    best = None
    for run in found.tolist():
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """words less those of a run after its first period, joined by a space."""
    if not len(found):
        return b" ".join(words)
    over = np.zeros(len(words) + 1, np.int64)
    np.add.at(over, found[:, 0] + found[:, 2], 1)
    np.add.at(over, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(over)[:-1] == 0).tolist()])


def detect(docs: DataFrame, rewrite: bool = False, texts: bool = True) -> DataFrame:
    """docs with n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 and (texts=True) runs, collapsed.

    A run is a longest stretch of words with a smallest period q, of at least 6 words and 4q. runs are all of them, by start, then period;
    start to exponent_milli tell of the one of the greatest length / period (ties: smallest start, then period) and are null without any.
    collapsed is the text less the words of a run after its first q, a space between words. Words are compared as they are, byte by byte.
    rewrite=True makes one document of ten periodic first (see repeated()). A null or empty text has no words, no runs and an empty
    collapsed text. Every row is worked on alone, repeated ones too: no shuffle, no state. Texts are numbered about a megabyte at a time, one
    longer text by itself. Other columns pass through, those with the name of a result are replaced.
    """
    types = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
    if texts:
        types |= {"runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), "collapsed": pa.string()}
    kept = [c for c in docs.columns if c.lower() not in types]
    id_, text_ = free(kept, "_id", "_text")

    def rows(data: np.ndarray, at: np.ndarray, ids: list) -> Iterator[tuple]:
        words = [repeated(t, i) if rewrite else t for t, i in zip((bytes(data[a:b]).split() for a, b in zip(at, at[1:])), ids)]
        symbols, first = numbers(words)
        all_ = runs(symbols)
        edge = np.searchsorted(all_[:, 0], first)
        for k, w in enumerate(words):
            found = all_[edge[k] : edge[k + 1]] - np.array([first[k], 0, 0])
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
            left = collapsed(w, found)
            more = ([dict(zip(("start", "length", "period"), r)) for r in found.tolist()], left.decode()) if texts else ()
            yield len(found), *longest(found), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), *more

    def work(batches):
        keep("periodic_runs")
        for batch in batches:
            data, at = utf8(batch.column(text_))
            for i, j in chunks(at):
                part = batch.slice(i, j - i)
                columns = zip(*rows(data, at[i : j + 1], part.column(id_).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(c, t) for c, t in zip(columns, types.values())], kept + list(types))

    given = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("doc_id").cast("long").alias(id_), F.col("text").cast("string").alias(text_))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    for name, type_ in types.items():
        schema = schema.add(name, from_arrow_type(type_))
    return given.mapInArrow(work, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return detect(docs, rewrite=True, texts=False).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
