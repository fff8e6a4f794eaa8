"""Repeatable draws from hashes of a row's key: the same under any partitioning, and in any engine with MD5."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(digest: Column, at: int) -> Column:
    return (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def uniform(*parts: Column | str) -> Column:
    """A number between 0 and 1 that depends on parts (literal strings and columns) only."""
    return _part(digest(*parts), 1)


def normal(*parts: Column | str) -> Column:
    """A standard normal number, by Box and Muller's formula from both halves of one hash."""
    d = digest(*parts)
    return F.sqrt(F.lit(-2.0) * F.log(_part(d, 1))) * F.cos(F.lit(2 * math.pi) * _part(d, 9))


def several(seed: str, normals: list[str], uniforms: list[str], key: Column) -> Column:
    """An array with normal(seed, name, key) for each name, then uniform(seed, name, key): the same numbers up to the last place, a batch at a
    time. As Column expressions they would be hex texts one by one, in more generated code than the JVM compiles."""
    starts, n = [f"{seed}|{name}|".encode() for name in (*normals, *uniforms)], len(normals)

    def draw(keys: pa.Array) -> pa.Array:
        md5, texts = hashlib.md5, keys.cast(pa.binary()).to_pylist()
        raw = b"".join([md5(s + k if k is not None else s[:-1]).digest() for k in texts for s in starts])
        u = (np.frombuffer(raw, ">u4").reshape(len(texts), len(starts), 4) + 0.5) / 4294967296.0
        out = u[:, :, 0].copy()
        out[:, :n] = np.sqrt(-2.0 * np.log(u[:, :n, 0])) * np.cos(2 * math.pi * u[:, :n, 1])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(starts), pa.int32()), pa.array(out.ravel(), pa.float64()))

    return F.arrow_udf(draw, "array<double>")(key)


def pick(n: Column | int, *parts: Column | str) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(*parts) * n).cast("long")
