"""Provider results kept by content: lookups are joins, misses anti joins."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBEDDING_KEY = ["content_hash", "chunk_index", "version", "provider", "model"]
SEMANTIC_KEY = ["key", "version"]


def usable(vector: Column, dimensions: Column) -> Column:
    """Whether a kept vector is whole: its length as declared and every value a number."""
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def lookup(wanted: DataFrame, cache: DataFrame, keys: list[str], valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses). Corrupt entries count as misses."""
    known = (cache if valid is None else cache.where(valid)).dropDuplicates(keys)
    return wanted.join(known, keys, "inner"), wanted.join(known.select(*keys), keys, "left_anti")


def store(cache: DataFrame, new: DataFrame, keys: list[str], valid: Column | None = None) -> DataFrame:
    """New entries replace those of their key, and corrupt ones go."""
    kept = (cache if valid is None else cache.where(valid)).join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new.dropDuplicates(keys))


def clear(cache: DataFrame, which: Column | None = None) -> DataFrame:
    return cache.where(F.lit(False) if which is None else ~which)


def stats(cache: DataFrame, payload: str) -> DataFrame:
    """One row: the number of entries and the bytes of their payloads."""
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length(F.col(payload))), F.lit(0).cast("long")).alias("bytes"))


def encode_vector(values: list[float], version: int = 1, timestamp: int = 0) -> bytes:
    """The portable form: EMB1, version, dimensions and time as little-endian 16 bytes, then 32-bit floats."""
    return b"EMB1" + struct.pack("<III", version, len(values), timestamp) + struct.pack(f"<{len(values)}f", *values)


def decode_vector(raw: bytes) -> list[float]:
    if len(raw) < 16 or raw[:4] != b"EMB1":
        raise ValueError("no vector")
    _, n, _ = struct.unpack("<III", raw[4:16])
    if len(raw) != 16 + 4 * n:
        raise ValueError("a vector is cut off")
    out = list(struct.unpack(f"<{n}f", raw[16:]))
    if any(math.isnan(x) for x in out):
        raise ValueError("a vector holds no number")
    return out
