"""From files to the graph: describe, chunk, analyse, embed, persist; and the services on top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import paths as P
from corpusgraph.functions import text as X
from corpusgraph.functions.vectors import mean_vectors
from corpusgraph.operators import filters as L
from corpusgraph.operators import graph as G
from corpusgraph.operators import search as S
from corpusgraph.operators import state as T
from corpusgraph.operators.chunking import Options
from corpusgraph.operators.chunking.udf import chunk_files
from corpusgraph.operators.export import render
from corpusgraph.providers import EmbeddingsProvider, SemanticProvider, analyze, embed
from corpusgraph.sources.files import described, listed_all, root_health, with_content

Stage = Callable[..., DataFrame]


def chunk_stage(files: DataFrame, options: Options) -> DataFrame:
    """Chunks of the files that are to be chunked; the others have none."""
    own = files.where("ingest_mode = 'chunk'").select("path", "content", "mime_type", "language")
    return chunk_files(own, options)


def semantic_stage(files: DataFrame, chunks: DataFrame, provider: SemanticProvider) -> DataFrame:
    """Semantics of each file: from its chunks in order, or its content where it isn't chunked, cut
    to what the provider takes."""
    text = chunks.groupBy(F.col("file_path").alias("path")).agg(X.joined_in_order(F.col("index"), F.col("content")).alias("text"))
    only = files.where("ingest_mode = 'semantic_only'").select("path", F.lit("").alias("text"))
    budget = max(1, provider.max_input_tokens - 4096)
    every = text.unionByName(only).select("path", F.make_valid_utf8(X.condensed(F.col("text"), budget)).alias("text"))
    return analyze(every, ["path"], "text", provider)


def embedding_stage(chunks: DataFrame, provider: EmbeddingsProvider) -> DataFrame:
    return embed(chunks.select("file_path", F.col("id").alias("chunk_id"), "content"), ["file_path", "chunk_id"], "content", provider)


class Results(dict):
    """The frames of an ingest, and what is persisted for them."""

    held: list[DataFrame]

    def release(self) -> None:
        """Lets go of what is persisted, once the frames are written."""
        for df in self.held:
            df.unpersist()


def ingest(raw: DataFrame, semantic: SemanticProvider | None = None, embeddings: EmbeddingsProvider | None = None, options: Options = Options(), keep: Callable[[DataFrame, str], DataFrame] | None = None, stages: dict[str, Stage] | None = None) -> Results:
    """The frames that `operators.graph.persist_files` takes, of (path, size, mod_time, content) rows.

    keep holds what several outputs read, so that providers are called once; a Store's write and
    read fit. Without one, frames are persisted until `release` of the result is called. stages may replace 'chunk', 'semantic' and 'embed'. Failures of
    providers are columns of the files, not of the run.
    """
    held: list[DataFrame] = []

    def persisted(df: DataFrame, name: str) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    keep = keep or persisted
    stage = {"chunk": chunk_stage, "semantic": semantic_stage, "embed": embedding_stage} | (stages or {})
    files = keep(described(raw), "files")
    chunks = keep(stage["chunk"](files, options), "chunks")
    out = Results({"chunks": chunks.drop("chunker", "warnings")})
    out.held = held
    listed = files.drop("content")
    if semantic is not None:
        s = keep(stage["semantic"](files, chunks, semantic), "semantics")
        listed = listed.join(s.select("path", "summary", "complexity", F.col("error").alias("semantic_error")), "path", "left")
        out["tags"] = s.select("path", F.explode_outer("tags").alias("name"))
        out["topics"] = s.select("path", F.explode_outer("topics").alias("t")).select("path", "t.name", "t.confidence")
        out["entities"] = s.select("path", F.explode_outer("entities").alias("e")).select("path", "e.name", "e.type")
        out["references"] = s.select("path", F.explode("references").alias("r")).select("path", "r.target", "r.type")
    else:
        out["tags"] = listed.select("path", F.lit(None).cast("string").alias("name")).where("false")
        out["topics"] = out["tags"].withColumn("confidence", F.lit(None).cast("double"))
        out["entities"] = out["tags"].withColumn("type", F.lit(None).cast("string"))
        out["references"] = listed.select("path", F.lit("").alias("target"), F.lit("").alias("type")).where("false")
    if embeddings is not None:
        v = keep(stage["embed"](chunks, embeddings), "vectors")
        out["chunk_embeddings"] = v.where("error is null").select("chunk_id", "provider", "model", "dimensions", "embedding")
        listed = listed.join(mean_vectors(v.where("error is null"), "file_path", "embedding").withColumnRenamed("file_path", "path"), "path", "left")
    else:
        out["chunk_embeddings"] = chunks.select(F.col("id").alias("chunk_id"), F.lit("").alias("provider"), F.lit("").alias("model"), F.lit(0).alias("dimensions"), F.array().cast("array<float>").alias("embedding")).where("false")
    out["files"] = listed
    return out


def embedded_query(provider: EmbeddingsProvider, text: str) -> list[float]:
    if not text.strip():
        raise ValueError("the query is empty")
    return [float(x) for x in provider.embed_batch([text])[0]]


def search_memory(frames: dict[str, DataFrame], roots: DataFrame, provider: EmbeddingsProvider, text: str, mode: str = "exact", **query) -> DataFrame:
    """Ranked chunks under remembered roots for a text: rank, score, path, offsets and a snippet."""
    q = S.Query(embedded_query(provider, text), **query)
    own = frames["chunk_embeddings"].where((F.col("provider") == provider.name) & (F.col("model") == provider.model))
    placed = own.join(frames["chunks"].select(F.col("id").alias("chunk_id"), "file_path"), "chunk_id")
    alive = T.remembered_only(frames["chunks"].select(F.col("file_path").alias("path")).distinct(), roots)
    if mode == "exact":
        placed = placed.join(alive.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    hits = S.search(placed, q, mode=mode)
    if mode == "compat":
        hits = hits.join(alive.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    found = G.hits_with_chunks(hits.select("chunk_id", "score", "rank"), frames["chunks"], S.clamp(q.top_k, 1, 50, 10))
    return found.select("rank", "score", F.col("file_path").alias("path"), "chunk_id", "start_offset", "end_offset", F.substring(X.compact(F.col("content")), 1, S.clamp(q.snippet_chars, 1, 2000, 400)).alias("snippet")).orderBy("rank")


def file_resource(frames: dict[str, DataFrame], roots: DataFrame, path: str) -> DataFrame:
    """One row of JSON of a remembered file with its relations; no rows if it isn't remembered or known."""
    own = T.remembered_only(frames["files"].where(F.col("path") == P.clean(path)), roots)
    edges = frames["edges"].where(F.col("src_key") == P.clean(path))
    return G.file_relations(own, edges).select(F.to_json(F.struct("*")).alias("json"))


def remember(roots: DataFrame, path: str, config: L.PathConfig = L.PathConfig()) -> DataFrame:
    """Adds a root; a directory that isn't there or can't be read is an error."""
    import json
    from dataclasses import asdict

    if (status := root_health(path)) != "ok":
        raise ValueError(f"{path}: {status}")
    return T.add_root(roots, path, json.dumps(asdict(config)))


def forget(frames: dict[str, DataFrame], roots: DataFrame, path: str, keep_data: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Removes a root and, unless they are kept, all that is known of the files under it."""
    left = T.remove_root(roots, path)
    if keep_data:
        return frames, left
    out = G.delete_files(frames, P.under(F.col("path"), path))
    for name in ("state", "discovery"):
        if name in frames:
            out[name] = T.delete_under(frames[name], path)
    if "directories" in frames:
        out["directories"] = frames["directories"].where(~P.under(F.col("path"), path))
    return out, left


def rebuild(spark: SparkSession, frames: dict[str, DataFrame], configs: dict[str, L.PathConfig], full: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(files to analyse, frames without stale ones): walks all roots and reconciles.

    Roots that are missing are left out. A full run takes every file, another the changed ones.
    """
    live = {r: c for r, c in configs.items() if root_health(r) != "missing"}
    roots = spark.createDataFrame([(P.clean(r),) for r in live], "path string")
    found = listed_all(spark, live)
    stale = T.stale_paths(frames["state"], frames["discovery"], found.select("path"), roots).select("path")
    out = G.delete_files(frames, F.lit(False)) if stale.isEmpty() else _without(frames, stale)
    return with_content(spark, found if full else L.changed(found, frames["state"])), out


def rebuild_periodically(spark: SparkSession, run: Callable[[], object], every: str = "1 hour", checkpoint: str | None = None):
    """A query that calls run() at every interval: the schedule is Spark's own trigger, over a source of
    one row a second, and ends with the query's stop()."""
    ticks = spark.readStream.format("rate").load()
    out = ticks.writeStream.foreachBatch(lambda df, n: run()).trigger(processingTime=every)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def _without(frames: dict[str, DataFrame], stale: DataFrame) -> dict[str, DataFrame]:
    marked = frames | {"files": frames["files"].join(stale.withColumn("__stale", F.lit(True)), "path", "left")}
    out = G.delete_files(marked, F.coalesce("__stale", F.lit(False)))
    out["files"] = out["files"].drop("__stale")
    for name in ("state", "discovery"):
        out[name] = frames[name].join(stale, "path", "left_anti")
    return out


def read(frames: dict[str, DataFrame], fmt: str = "toon", wrap: str = "none", **filters) -> str:
    """An export as one string, for a reader of a small graph; see export.save for large ones."""
    return render(frames, fmt, wrap, **filters)


def throughput(results: DataFrame, millis_col: str = "millis", capacity: int = 1000) -> DataFrame:
    """One row: processed items, their average time and the share of the capacity in use."""
    return results.agg(F.count(F.lit(1)).alias("processed"), F.avg(millis_col).alias("average_millis"), (F.count(F.when(F.col("status") == "pending", 1)) / capacity).alias("load"))
