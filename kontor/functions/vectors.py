"""Vectors as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic unit vector of a text: the bytes of its SHA-256 repeated to ``dim``, less 127.5, normalised."""

    def bound(value: Column, use) -> Column:  # noqa: ANN001
        """``use(value)`` with ``value`` computed once, however often it is used."""
        return F.transform(F.array(value), use)[0]

    digest = bound(F.sha2(text, 256), lambda d: F.transform(F.sequence(F.lit(0), F.lit(min(dim, 32) - 1)), lambda i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5))
    raw = digest if dim <= 32 else F.slice(F.flatten(F.array_repeat(digest, -(-dim // 32))), 1, dim)
    size = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    return bound(raw, lambda r: bound(size(r), lambda n: F.transform(r, lambda x: x / n)))


def vectors_of_digests(digests: pa.Array, dim: int = 64) -> np.ndarray:
    """:func:`hash_embedding` of texts by their SHA-256, as bytes: the same numbers, many rows at once."""
    read = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)
    raw = np.tile(read, (1, -(-dim // 32)))[:, :dim] - 127.5
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
