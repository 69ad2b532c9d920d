"""Pluggable providers of semantics and embeddings, with deterministic offline defaults.

The defaults stand in where no network is: they are no models, and nothing claims that they
agree with one.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Semantics:
    summary: str = ""
    tags: list[str] = field(default_factory=list)
    topics: list[tuple[str, float]] = field(default_factory=list)
    entities: list[tuple[str, str]] = field(default_factory=list)
    references: list[tuple[str, str]] = field(default_factory=list)
    complexity: int = 0


class SemanticProvider(Protocol):
    name: str
    model: str
    max_input_tokens: int

    def analyze(self, text: str) -> Semantics: ...


class EmbeddingsProvider(Protocol):
    name: str
    model: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class KeywordSemantics:
    """Frequent long words as tags and topics, capitalised ones as entities, quoted paths as references."""

    name, model, max_input_tokens = "offline", "keywords-1", 100_000

    def analyze(self, text: str) -> Semantics:
        words = Counter(w.lower() for w in re.findall(r"[^\W\d_]{5,}", text))
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:5]
        total = sum(words.values()) or 1
        names = sorted({m for m in re.findall(r"(?<![.!?\n] )(?<!^)\b[A-Z][a-z]{3,}\b", text)})[:10]
        paths = sorted(set(re.findall(r"[\"'(](/?[\w./-]+\.\w{1,5})[\"')]", text)))
        first = re.split(r"(?<=[.!?])\s", text.strip(), maxsplit=1)[0][:200]
        return Semantics(first, [w for w, _ in top], [(w, round(n / total, 6)) for w, n in top[:3]], [(n, "name") for n in names], [(p, "file") for p in paths], min(10, 1 + len(text) // 2000))


class HashedEmbeddings:
    """Signed feature hashing of words, of unit length."""

    name, model = "offline", "hashed-words-1"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k, text in enumerate(texts):
            for word, n in Counter(text.lower().split()).items():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[k, h % self.dimensions] += n if h >> 63 else -n
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


class RateLimiter:
    """A token bucket of one task: so many calls a minute, with as many in a burst."""

    def __init__(self, per_minute: float, burst: int | None = None, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.most = per_minute / 60, burst or max(1, int(per_minute))
        self.held, self.at, self.clock, self.sleep = float(self.most), clock(), clock, sleep

    def wait(self, n: int = 1) -> None:
        now = self.clock()
        self.held = min(self.most, self.held + (now - self.at) * self.rate)
        self.at = now
        if self.held < n:
            self.sleep((n - self.held) / self.rate)
            self.at, self.held = self.clock(), float(n)
        self.held -= n


def share(df: DataFrame, per_minute: float | None) -> float | None:
    """The part of a job's limit that each of the tasks that run at the same time may use."""
    return per_minute / max(1, df.sparkSession.sparkContext.defaultParallelism) if per_minute else None


def retried(call, retries: int = 3, base: float = 1.0, sleep=time.sleep):
    """call(), again after failures with doubled delays; the last failure is raised."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception:
            if attempt == retries:
                raise
            sleep(base * 2**attempt)


def embed(df: DataFrame, keep: list[str], text_col: str, provider: EmbeddingsProvider, per_minute: float | None = None, batch: int = 128, retries: int = 3) -> DataFrame:
    """keep columns, provider, model, dimensions, embedding and error; a failed batch has errors, not rows lost.

    per_minute is the limit of the whole job: each task takes its share of it (see share)."""
    per_minute = share(df, per_minute)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = RateLimiter(per_minute) if per_minute else None
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                try:
                    if limit:
                        limit.wait()
                    vectors = retried(lambda: provider.embed_batch(texts), retries)
                    made, errors = [v.tolist() for v in vectors], [None] * len(texts)
                except Exception as x:
                    made, errors = [None] * len(texts), [str(x)] * len(texts)
                n = part.num_rows
                more = [pa.array([provider.name] * n), pa.array([provider.model] * n), pa.array([provider.dimensions] * n, pa.int32()), pa.array(made, pa.list_(pa.float32())), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *more], [*keep, "provider", "model", "dimensions", "embedding", "error"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{schema}, provider string, model string, dimensions int, embedding array<float>, error string")


def analyze(df: DataFrame, keep: list[str], text_col: str, provider: SemanticProvider, per_minute: float | None = None, retries: int = 3) -> DataFrame:
    """keep columns, summary, tags, topics, entities, references, complexity and error of each text.

    per_minute is the limit of the whole job, as in embed."""
    per_minute = share(df, per_minute)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    pair = lambda a, b: pa.list_(pa.struct([a, b]))
    kinds = {
        "summary": pa.string(), "tags": pa.list_(pa.string()), "topics": pair(("name", pa.string()), ("confidence", pa.float64())), "entities": pair(("name", pa.string()), ("type", pa.string())),
        "references": pair(("target", pa.string()), ("type", pa.string())), "complexity": pa.int32(), "error": pa.string(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = RateLimiter(per_minute) if per_minute else None
        for rows in batches:
            out = []
            for text in rows.column(rows.num_columns - 1).to_pylist():
                try:
                    if limit:
                        limit.wait()
                    s = retried(lambda t=text: provider.analyze(t or ""), retries)
                    out.append({"summary": s.summary, "tags": s.tags, "topics": [{"name": a, "confidence": b} for a, b in s.topics], "entities": [{"name": a, "type": b} for a, b in s.entities], "references": [{"target": a, "type": b} for a, b in s.references], "complexity": s.complexity, "error": None})
                except Exception as x:
                    out.append(dict.fromkeys(kinds) | {"error": str(x)})
            more = [pa.array([r[k] for r in out], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(keep))), *more], [*keep, *kinds])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{schema}, summary string, tags array<string>, topics array<struct<name:string,confidence:double>>, entities array<struct<name:string,type:string>>, references array<struct<target:string,type:string>>, complexity int, error string")
