"""Hashes of words and five-word shingles over Arrow columns of texts, a few megabytes at a time in NumPy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words in a shingle.
SHINGLE = 5
#: Bytes of text worked on at once, unless one text is longer.
CHUNK = 1 << 20
#: Bytes of a word that are hashed eight by eight; longer words are hashed one by one.
SHORT = 64

_rng = np.random.default_rng(20240607)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z count as a-z
_KEYS = _rng.integers(1, 2**63, SHORT // 8 + 1, dtype=np.uint64)
_STEP = _rng.integers(1, 2**62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes of padded (which has eight more than are asked for) from each place on, those beyond the left ones as zeros."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    return eight[at] & _MASKS[np.clip(left, 0, 8)]


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words b[starts:ends].

    Eight bytes at a time are scrambled into the hash, with a key for each place, and the length at the end. So different words of one
    length of up to eight bytes never agree, and others only by chance: there is no family of words that agree whatever the keys are.
    """
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    live = np.flatnonzero(size <= SHORT)
    for k in range(SHORT // 8):
        if not live.size:
            break
        left = size[live] - 8 * k
        out[live] = mix((out[live] + _KEYS[k]) ^ lanes(padded, starts[live] + 8 * k, left))
        live = live[left > 8]
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out ^ (_KEYS[-1] + size.astype(np.uint64)))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts and ends; a null text is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if ends and len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def chunks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of CHUNK bytes together, or of one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts data[at[i]:at[i + 1]]: each word's hash (A-Z as a-z), start and end in data, and the number of the first word of each text (and of one past the last)."""
    lo, hi = int(at[0]), int(at[-1])
    b = data[lo:hi]
    inside = ~_SPACE[b]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    over = inside.copy()
    over[:-1] &= ~inside[1:]
    edge = at[1:-1] - lo
    edge = edge[(edge > 0) & (edge < len(b))]
    begin[edge] = inside[edge]
    over[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(over) + 1
    hashes = word_hashes(_LOWER[b], starts, ends)
    return hashes, starts + lo, ends + lo, np.searchsorted(starts, at - lo)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Of one text's words: the hash of each run of five, or of the whole of a shorter text."""
    n = len(hashes)
    if not n:
        return hashes
    m = max(1, n - SHINGLE + 1)
    out = np.full(m, min(n, SHINGLE), np.uint64)
    for k in range(min(n, SHINGLE)):
        out += hashes[k : k + m] * _STEP[k]
    return mix(out)


def shingled(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, in order, repeats included."""
    data, at = utf8(texts)
    for i, j in chunks(at):
        hashes, _, _, first = words(data, at[i : j + 1])
        for k in range(j - i):
            yield shingles(hashes[first[k] : first[k + 1]])
