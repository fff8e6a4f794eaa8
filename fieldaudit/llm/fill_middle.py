"""Operator 13: fill-in-middle by a piece table of descriptors over the text and a buffer of sentinels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import free, keep
from fieldaudit.llm.hashing import chunks, utf8

#: The sentinels before prefix, suffix and middle. A text that holds one of them stays as it is.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Of 100 documents, those that stay plain, and of 100 of the others, those with the suffix first.
PLAIN_PCT, SPM_PCT, SEED = 10, 20, 1
#: What a descriptor points into.
TEXT, MARKS = 0, 1
#: Arrangements of the table [prefix, middle, suffix, <P>, <S>, <M>], as places of its rows; plain has no sentinels.
ARRANGED = {"plain": (0, 1, 2), "psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Piece(NamedTuple):
    """Bytes start to end of a buffer that never changes."""

    buffer: int
    start: int
    end: int


def cut(table: list[Piece], at: int) -> list[Piece]:
    """table with the piece that holds place at (counted over the table) split in two there, one of them empty if at is its edge."""
    out, passed = [], 0
    for k, piece in enumerate(table):
        size = piece.end - piece.start
        if passed <= at <= passed + size:
            middle = piece.start + at - passed
            return [*out, Piece(piece.buffer, piece.start, middle), Piece(piece.buffer, middle, piece.end), *table[k + 1 :]]
        out.append(piece)
        passed += size
    raise ValueError(f"no place {at} in a table of {passed}")


def marks() -> list[Piece]:
    return [Piece(MARKS, k, k + 3) for k in range(0, len(SENTINELS), 3)]


def arranged(table: list[Piece], form: str) -> list[Piece]:
    """[prefix, middle, suffix] with the sentinels, in the order of form."""
    rows = table + marks()
    return [rows[k] for k in ARRANGED[form]]


def original(table: list[Piece], form: str) -> list[Piece]:
    """The inverse: an arranged table's [prefix, middle, suffix], sentinels left out."""
    back = dict(zip(ARRANGED[form], table))
    return [back[k] for k in range(3)]


def read_back(output: memoryview, form: str) -> list[Piece]:
    """The arranged table of an output, over the output itself: cut where the form's sentinels stand, in their order.

    A text in form psm or spm holds no sentinel, and none can arise over a sentinel's edge, so each is found at its only place.
    """
    if form == "plain":
        return [Piece(TEXT, 0, 0), Piece(TEXT, 0, 0), Piece(TEXT, 0, len(output))]
    data, places = bytes(output), []
    for row in ARRANGED[form]:
        if row >= 3:
            at = data.index(SENTINELS[3 * (row - 3) : 3 * (row - 2)], places[-1] if places else 0)
            places += [at, at + 3]
    edges = [*places, len(data)]
    return [Piece(TEXT, a, b) for a, b in zip(edges, edges[1:])]


def pour(table: list[Piece], text: memoryview) -> Iterator[memoryview]:
    """The bytes that the table's pieces point at, one after another and not copied."""
    buffers = {TEXT: text, MARKS: memoryview(SENTINELS)}
    for piece in table:
        yield buffers[piece.buffer][piece.start : piece.end]


def digest(table: list[Piece], text: memoryview) -> str:
    sha = hashlib.sha256()
    for part in pour(table, text):
        sha.update(part)
    return sha.hexdigest()


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 from the seed and the id (a null id: none after the colon)."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[k : k + 8], 16) for k in (0, 8, 16, 24)]


def starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts data[at[i]:at[i + 1]]: the bytes where a unit (a run of letters A-Z and a-z, or one other code point) starts, and the code points before each byte."""
    lo, hi = int(at[0]), int(at[-1])
    b = data[lo:hi]
    point, letter = (b & 0xC0) != 0x80, _LETTER[b]
    fresh = point & ~letter
    head = letter.copy()
    head[1:] &= ~letter[:-1]
    edge = at[:-1] - lo
    edge = edge[edge < len(b)]
    head[edge] = letter[edge]
    return np.flatnonzero(fresh | head) + lo, np.concatenate([np.zeros(1, np.int64), np.cumsum(point)])


def transform(docs: DataFrame, plain_pct: int = PLAIN_PCT, spm_pct: int = SPM_PCT, seed: int = SEED, texts: bool = True) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256; texts=False leaves output out, so that no text comes back from Python.

    A text is one descriptor. Two cuts at units drawn by the hash of the seed and doc_id split it into prefix, middle and suffix; the form's
    permutation puts them and the sentinels in order; output is what the descriptors point at. restored_sha256 is of the text that the
    inverse permutation gives from output and form alone. Texts that are empty or null, or hold a sentinel, stay plain, as do plain_pct
    documents in a hundred; plain ones have null prefix_chars and middle_chars. A null doc_id draws from the seed alone. Every row is worked
    on alone, repeated ones too: no shuffle, no state. Other columns pass through, those with the name of a result are replaced.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    if not texts:
        names.remove("output")
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string(), "output_sha256": pa.string(), "restored_sha256": pa.string()}
    kept = [c for c in docs.columns if c.lower() not in names]
    id_, text_ = free(kept, "_id", "_text")

    def rows(data: np.ndarray, at: np.ndarray, ids: list) -> Iterator[tuple]:
        unit, points = starts(data, at)
        first = np.searchsorted(unit, at)
        lo = int(at[0])
        for k, doc_id in enumerate(ids):
            a, b, u = int(at[k]), int(at[k + 1]), int(first[k])
            n = int(first[k + 1]) - u
            text = memoryview(data[a:b])
            h = draws(doc_id, seed)
            place = lambda x: (int(unit[u + x]) if x < n else b) - a
            cuts = sorted(place(x % (n + 1)) for x in h[:2])
            raw = bytes(text)
            form = "plain" if not n or h[2] % 100 >= 100 - plain_pct or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)) else "spm" if h[3] % 100 < spm_pct else "psm"
            table = [Piece(TEXT, 0, b - a)]
            for c in cuts:
                table = cut(table, c)
            out = arranged(table, form)
            output = memoryview(b"".join(pour(out, text)))
            chars = lambda piece: int(points[a - lo + piece.end] - points[a - lo + piece.start])
            sizes = (None, None) if form == "plain" else (chars(table[0]), chars(table[1]))
            yield n, form, *sizes, *([bytes(output).decode()] if texts else []), digest(out, text), digest(original(read_back(output, form), form), output)

    def run(batches):
        keep("fill_middle")
        for batch in batches:
            data, at = utf8(batch.column(text_))
            for i, j in chunks(at):
                part = batch.slice(i, j - i)
                columns = list(zip(*rows(data, at[i : j + 1], part.column(id_).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(c, kinds[name]) for name, c in zip(names, columns)], kept + names)

    given = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("doc_id").cast("long").alias(id_), F.col("text").cast("string").alias(text_))
    types = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "output_sha256": "string", "restored_sha256": "string"}
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    for name in names:
        schema = schema.add(name, types[name])
    return given.mapInArrow(run, schema)


def restore(df: DataFrame) -> DataFrame:
    """df (output, form, ..) with restored: the text before the transformation, by DataFrame functions. A null output or form gives null."""
    out, form = F.col("output"), F.col("form")
    middle = F.substring_index(out, "<M>", -1)
    between = lambda a, b: F.substring_index(F.substring_index(out, b, 1), a, -1)
    psm = F.concat(between("<P>", "<S>"), middle, between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), middle, between("<S>", "<P>"))
    return df.withColumn("restored", F.when(form == "plain", out).when(form == "psm", psm).when(form == "spm", spm))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return transform(docs, texts=False).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, t, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - PLAIN_PCT} THEN 'plain'
                  WHEN h4 % 100 < {SPM_PCT} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS pre, array_to_string(t[a + 1:b], '') AS mid, array_to_string(t[b + 1:n], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p),
k AS (SELECT *, strpos(out, '<P>') AS p, strpos(out, '<S>') AS s, strpos(out, '<M>') AS m FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN len(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(mid) END AS middle_chars,
       sha256(out) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN out[p + 3:s - 1] || out[m + 3:] || out[s + 3:m - 1] ELSE out[p + 3:m - 1] || out[m + 3:] || out[s + 3:p - 1] END) AS restored_sha256
FROM k
"""
