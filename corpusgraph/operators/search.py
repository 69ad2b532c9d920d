"""Vector search with filters, ranks and snippets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import paths as P
from corpusgraph.functions.text import compact
from corpusgraph.functions.vectors import cosine
from corpusgraph.operators.filters import score_at_least


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return default if not value else max(low, min(high, value))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "chunk_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest by cosine similarity, ties by id: a scan and a top-k of each task, one merge."""
    if not query:
        raise ValueError("the query vector is empty")
    scored = (vectors if where is None else vectors.where(where)).withColumn("score", cosine(F.col(vector_col), query)).where("score is not null")
    return scored.orderBy(F.desc("score"), F.col(id_col)).limit(k if k > 0 else 10)


@dataclass(frozen=True)
class Query:
    """A search: filters are all optional."""

    vector: list[float]
    top_k: int | None = None
    path_prefix: str | None = None
    include_extensions: list[str] = field(default_factory=list)
    exclude_extensions: list[str] = field(default_factory=list)
    min_score: float | str | None = None
    snippet_chars: int | None = None

    def filtered(self) -> bool:
        return bool(self.path_prefix or self.include_extensions or self.exclude_extensions or self.min_score is not None)


def candidate_k(k: int, filtered: bool) -> int:
    return max(100, min(500, 10 * k)) if filtered else k


def ranked(hits: DataFrame, id_col: str) -> DataFrame:
    """Adds rank 1..n by score. The hits are a top k, so one task is enough."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col(id_col))))


def search(vectors: DataFrame, query: Query, id_col: str = "chunk_id", vector_col: str = "embedding", path_col: str | None = "file_path", mode: str = "exact", where: Column | None = None, candidates: int | None = None) -> DataFrame:
    """The best chunks for a query vector with rank and score.

    mode 'exact' filters before the nearest are taken; 'compat' takes candidates first and filters
    those, so it may return fewer. where is a further filter, such as on remembered roots.
    """
    k = clamp(query.top_k, 1, 50, 10)
    test = where if where is not None else F.lit(True)
    if path_col is not None:
        path = F.col(path_col)
        if query.path_prefix:
            test = test & P.under(path, query.path_prefix)
        if query.include_extensions:
            test = test & P.extension(path).isin(P.extension_set(query.include_extensions))
        if query.exclude_extensions:
            test = test & ~P.extension(path).isin(P.extension_set(query.exclude_extensions))
    scored = vectors.withColumn("score", cosine(F.col(vector_col), query.vector)).where("score is not null")
    enough = score_at_least(F.col("score"), query.min_score) if query.min_score is not None else F.lit(True)
    order = [F.desc("score"), F.col(id_col)]
    if mode == "compat":
        n = candidates or candidate_k(k, query.filtered() or where is not None)
        hits = scored.orderBy(*order).limit(n).where(test & enough).orderBy(*order).limit(k)
    elif mode == "exact":
        hits = scored.where(test & enough).orderBy(*order).limit(k)
    else:
        raise ValueError(f"no such mode: {mode}")
    return ranked(hits, id_col)


def snippet(content: Column, start: Column, end: Column, chars: int | None = None) -> Column:
    """The bytes from start to end of a file as text without runs of white space, cut to so many characters."""
    text = F.substr(content.cast("binary"), start + 1, end - start).cast("string")
    return F.substring(compact(F.make_valid_utf8(text)), 1, clamp(chars, 1, 2000, 400))


def list_roots(roots: DataFrame, placed: DataFrame) -> DataFrame:
    """roots (path, status) with counts of placed (root, analysed and embedded times); null counts unless the status is ok."""
    n = placed.groupBy("root").agg(F.count(F.lit(1)).alias("files"), F.count("semantic_analyzed_at").alias("analyzed"), F.count("embeddings_analyzed_at").alias("embedded"))
    out = roots.join(n, F.col("path") == F.col("root"), "left").drop("root")
    ok = F.col("status") == "ok"
    return out.select(*roots.columns, *[F.when(ok, F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in ("files", "analyzed", "embedded")])
