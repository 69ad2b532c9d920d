"""The property graph as node and edge frames: upserts, deletes, relations and counts.

Every operation returns new frames. Writes of whole tables go to a new version directory, see
sources.store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import paths as P
from corpusgraph.functions.text import normal_name


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """Rows of new replace those of old with equal keys; of rows of new with equal keys the last by
    order_by stays, or any if none is named."""
    if order_by:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_by).alias("__r")).select(*keys, "__r.*")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def contains_edges(files: DataFrame) -> DataFrame:
    return edges(files.select(P.directory(F.col("path")).alias("s"), F.col("path").alias("d")), "Directory", "s", "CONTAINS", "File", "d")


def edges(df: DataFrame, src_label: str, src: str, rel: str, dst_label: str, dst: str, confidence: Column | None = None, kind: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(src_label).alias("src_label"), F.col(src).alias("src_key"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), F.col(dst).alias("dst_key"),
        (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"), (kind if kind is not None else F.lit(None)).cast("string").alias("type"),
    )


def directory_tree(files: DataFrame, remembered: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(directories, CONTAINS edges between them and to the files): all ancestors, with their direct file counts.

    Ancestors are deduplicated after directories are, so a directory with many files costs one row.
    """
    direct = files.groupBy(P.directory(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("file_count"))
    every = direct.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    roots = [P.clean(r) for r in remembered or []]
    dirs = every.join(direct, "path", "left").select("path", P.base(F.col("path")).alias("name"), (F.col("path").isin(roots) if roots else F.lit(False)).alias("is_remembered"), F.coalesce("file_count", F.lit(0).cast("long")).alias("file_count"))
    up = edges(every.where("path != '/'").select(P.directory(F.col("path")).alias("s"), F.col("path").alias("d")), "Directory", "s", "CONTAINS", "Directory", "d")
    return dirs, up.unionByName(contains_edges(files))


def upsert_files(files: DataFrame, edge_frame: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files by path, and the CONTAINS edge of each new one."""
    return upsert(files, new, ["path"]), upsert(edge_frame, contains_edges(new), ["src_label", "src_key", "rel", "dst_label", "dst_key"])


def upsert_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks by (file_path, index), as equal chunks of two files are two chunks."""
    return upsert(chunks, new, ["file_path", "index"])


def has_chunk_edges(chunks: DataFrame) -> DataFrame:
    return edges(chunks, "File", "file_path", "HAS_CHUNK", "Chunk", "id")


def upsert_embeddings(embeddings: DataFrame, new: DataFrame, decimals: int | None = None) -> DataFrame:
    if decimals is not None:
        new = new.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, decimals).cast("float")))
    return upsert(embeddings, new, ["chunk_id", "provider", "model"])


def delete_embeddings(embeddings: DataFrame, chunk_id: str, provider: str | None = None, model: str | None = None) -> DataFrame:
    """All of a chunk, those of a provider, or those of a provider's model; a model alone is not looked at."""
    gone = F.col("chunk_id") == chunk_id
    if provider is not None:
        gone = gone & (F.col("provider") == provider)
        if model is not None:
            gone = gone & (F.col("model") == model)
    return embeddings.where(~gone)


def delete_files(frames: dict[str, DataFrame], gone: Column) -> dict[str, DataFrame]:
    """Takes files of which `gone` (over path) holds out of files, chunks, chunk_embeddings and edges."""
    files, chunks, vectors, edge_frame = (frames[k] for k in ("files", "chunks", "chunk_embeddings", "edges"))
    dead_files = files.where(gone).select("path")
    dead_chunks = chunks.join(dead_files, F.col("file_path") == F.col("path"), "left_semi").select("id")
    keys = dead_files.select(F.lit("File").alias("l"), F.col("path").alias("k")).unionByName(dead_chunks.select(F.lit("Chunk").alias("l"), F.col("id").alias("k")))
    left = edge_frame.join(keys, (F.col("src_label") == F.col("l")) & (F.col("src_key") == F.col("k")), "left_anti")
    left = left.join(keys, (F.col("dst_label") == F.col("l")) & (F.col("dst_key") == F.col("k")), "left_anti")
    return frames | {
        "files": files.where(~gone),
        "chunks": chunks.join(dead_files, F.col("file_path") == F.col("path"), "left_anti"),
        "chunk_embeddings": vectors.join(dead_chunks, F.col("chunk_id") == F.col("id"), "left_anti"),
        "edges": left,
    }


def delete_file(frames: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    return delete_files(frames, F.col("path") == path)


def delete_subtree(frames: dict[str, DataFrame], prefix: str) -> dict[str, DataFrame]:
    """Files and directories strictly under the prefix."""
    below = F.col("path").startswith(prefix.rstrip("/") + "/")
    out = delete_files(frames, below)
    if "directories" in frames:
        out["directories"] = frames["directories"].where(~below)
    return out


def upsert_directories(directories: DataFrame, new: DataFrame) -> DataFrame:
    """Directories by path; name, is_remembered and file_count of new ones are as given."""
    return upsert(directories, new, ["path"])


def delete_directory(directories: DataFrame, edge_frame: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """One directory, not what lies under it, and every edge at either end of it."""
    p = P.clean(path)
    at = lambda end: (F.col(f"{end}_label") == "Directory") & (F.col(f"{end}_key") == p)
    return directories.where(F.col("path") != p), edge_frame.where(~(at("src") | at("dst")))


#: The edge and node of each kind of label that files carry.
LABELS = {"tags": ("HAS_TAG", "Tag"), "topics": ("COVERS_TOPIC", "Topic"), "entities": ("MENTIONS", "Entity")}


def set_labels(edge_frame: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Replaces the tags, topics or entities of the files in new.

    new: path, name, and for topics confidence, for entities type. Files with a null name lose
    all of theirs. Names are compared in ASCII lower case.
    """
    rel, label = LABELS[kind]
    key = normal_name(F.col("name")) if kind != "entities" else F.concat_ws("\u0001", normal_name(F.col("name")), F.col("type"))
    made = edges(new.where("name is not null").withColumn("__k", key), "File", "path", rel, label, "__k", F.col("confidence") if kind == "topics" else None, F.col("type") if kind == "entities" else None)
    made = made.dropDuplicates(["src_key", "dst_key"])
    files = new.select(F.col("path").alias("__p")).distinct()
    kept = edge_frame.join(files, (F.col("src_label") == "File") & (F.col("rel") == rel) & (F.col("src_key") == F.col("__p")), "left_anti")
    return kept.unionByName(made)


def label_usage(edge_frame: DataFrame, kind: str) -> DataFrame:
    """(key, usage_count): in how many files each tag, topic or entity is."""
    rel, _ = LABELS[kind]
    return edge_frame.where(F.col("rel") == rel).groupBy(F.col("dst_key").alias("key")).agg(F.countDistinct("src_key").alias("usage_count"))


def set_references(files: DataFrame, edge_frame: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces the references of the files in new (path, target, type); only those to files are
    kept, and files that aren't known become stubs."""
    own = new.where("type = 'file'")
    sources = new.select(F.col("path").alias("__p")).distinct()
    kept = edge_frame.join(sources, (F.col("rel") == "REFERENCES") & (F.col("src_key") == F.col("__p")), "left_anti")
    made = edges(own, "File", "path", "REFERENCES", "File", "target", None, F.col("type")).dropDuplicates(["src_key", "dst_key"])
    stubs = own.select(F.col("target").alias("path")).distinct().join(files.select("path"), "path", "left_anti")
    stubs = stubs.withColumn("name", P.base(F.col("path")))
    return files.unionByName(stubs, allowMissingColumns=True), kept.unionByName(made)


def file_relations(files: DataFrame, edge_frame: DataFrame) -> DataFrame:
    """Each file with its sorted tags, topics, entities and references and its number of chunks.

    One aggregate over the edges by file, joined once: no list of one kind multiplies another's.
    """
    of = lambda rel, value: F.array_sort(F.collect_set(F.when(F.col("rel") == rel, value)))
    per_file = edge_frame.where(F.col("src_label") == "File").groupBy(F.col("src_key").alias("path")).agg(
        of("HAS_TAG", F.col("dst_key")).alias("tags"),
        of("COVERS_TOPIC", F.struct(F.col("dst_key").alias("name"), "confidence")).alias("topics"),
        of("MENTIONS", F.struct(F.substring_index("dst_key", "\u0001", 1).alias("name"), "type")).alias("entities"),
        of("REFERENCES", F.col("dst_key")).alias("references"),
        F.count(F.when(F.col("rel") == "HAS_CHUNK", 1)).alias("chunk_count"),
    )
    return files.join(per_file, "path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))


#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 200_000


def hits_with_chunks(hits: DataFrame, chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Search hits (chunk_id, score) with their chunks. Where `most` bounds the hits, as a top k does, and
    is small enough, they are broadcast; else Spark chooses by their size."""
    hits = F.broadcast(hits) if most is not None and most <= BROADCAST_ROWS else hits
    return chunks.join(hits, chunks["id"] == hits["chunk_id"])


def has_embedding(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    known = embeddings.select(F.col("chunk_id").alias("id")).distinct().withColumn("has_embedding", F.lit(True))
    return chunks.join(known, "id", "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))


def node_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(label, n) of each node frame."""
    out = None
    for label, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def edge_counts(edge_frame: DataFrame) -> DataFrame:
    return edge_frame.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def persist_files(frames: dict[str, DataFrame], results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One batch of analysed files into all frames.

    results: files (with ingest_mode), chunks, chunk_embeddings, tags, topics, entities and
    references of these files. Files of mode 'skip' go with all they have; the others replace
    their chunks, vectors and labels, with empty ones too.
    """
    new = results["files"]
    touched = new.select("path").distinct()
    gone = new.where("ingest_mode = 'skip'").select("path")
    live = new.join(gone, "path", "left_anti")
    out = dict(frames)
    dead = frames["chunks"].join(touched, F.col("file_path") == F.col("path"), "left_semi").select("id")
    out["chunk_embeddings"] = frames["chunk_embeddings"].join(dead, F.col("chunk_id") == F.col("id"), "left_anti").unionByName(results["chunk_embeddings"], allowMissingColumns=True)
    out["chunks"] = frames["chunks"].join(touched, F.col("file_path") == F.col("path"), "left_anti").unionByName(results["chunks"], allowMissingColumns=True)
    out["files"] = upsert(frames["files"].join(gone, "path", "left_anti"), live, ["path"])
    own = frames["edges"].join(touched.withColumnRenamed("path", "__p"), (F.col("src_label") == "File") & (F.col("src_key") == F.col("__p")), "left_anti")
    own = own.join(touched.withColumnRenamed("path", "__p"), (F.col("rel") == "CONTAINS") & (F.col("dst_key") == F.col("__p")), "left_anti")
    own = own.unionByName(contains_edges(live)).unionByName(has_chunk_edges(results["chunks"]))
    for kind in LABELS:
        own = set_labels(own, results[kind], kind)
    out["files"], out["edges"] = set_references(out["files"], own, results["references"])
    return out
