"""Queries of sources, graph and state operations, exports and services, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import classify as C
from corpusgraph.functions import paths as P
from corpusgraph.functions import text as X
from corpusgraph.operators import cache as K
from corpusgraph.operators import export as E
from corpusgraph.operators import filters as L
from corpusgraph.operators import graph as G
from corpusgraph.operators import search as S
from corpusgraph.operators import state as T
from corpusgraph.plans import ingest as I
from corpusgraph.plans import views as V
from corpusgraph.session import shared_folder
from corpusgraph.sources import files as W
from corpusgraph.sources.store import Store
from corpusgraph.streaming.coalesce import notifications

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = "2024-01-01 00:00:00"


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(views) + " " if views else "") + sql
        return f

    return add


def day(text: str = DAY):
    return F.lit(text).cast("timestamp_ntz")


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


# --- sources


def _written(spark: SparkSession, d: str) -> str:
    """The documents as text files in a folder per language, all of a size that a walk reads: lines are
    dealt out by their bytes, a sixth of that size to a task on average, and those of more than a
    hundredth of it are files of their own."""
    path = shared_folder(spark)
    rows = V.table(spark, d, "documents").select("lang", F.regexp_replace("text", "[\r\n]", " ").alias("value"), (F.octet_length("text").cast("long") + 1).alias("n"))
    long = F.coalesce(F.col("n"), F.lit(1)) > W.LARGEST_READ // 100
    total, n_long = rows.agg(F.sum("n"), F.count_if(long)).first()
    rows.where(~long).drop("n").repartition(max(4, -(-(total or 0) * 6 // W.LARGEST_READ))).write.partitionBy("lang").text(path)
    if n_long:
        rows.where(long).drop("n").write.mode("append").option("maxRecordsPerFile", 1).partitionBy("lang").text(path)
    return path


def _folders(found: DataFrame) -> DataFrame:
    return found.groupBy(P.base(P.directory(F.col("path"))).alias("folder")).agg(F.sum("size").alias("bytes"), F.sum(F.octet_length("content").cast("long")).alias("read"))


_FOLDERS = "SELECT 'lang=' || lang AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(strlen(text) + 1) AS BIGINT) AS \"read\" FROM documents WHERE {} GROUP BY lang"


@query(_FOLDERS.format("lang <> 'fr'"))
def walk_tree(spark: SparkSession, d: str) -> DataFrame:
    """A walk that leaves out a directory and the writer's own hidden and mark files."""
    root = W.plain_path(F.lit(_written(spark, d)))
    path = spark.range(1).select(root).first()[0]
    return _folders(W.walk(spark, path, L.PathConfig(skip_directories=["lang=f*"], skip_files=["_*"])))


@query(_FOLDERS.format("lang IN ('en', 'fr')"))
def walk_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """A walk after which only files that the state doesn't know as they are are read."""
    path = spark.range(1).select(W.plain_path(F.lit(_written(spark, d)))).first()[0]
    config = L.PathConfig(skip_files=["_*"])
    known = W.listed(spark, path, config).where(~F.col("path").contains("lang=en")).select("path", F.when(F.col("path").contains("lang=fr"), F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mod_time", F.current_timestamp().alias("semantic_analyzed_at"))
    return _folders(W.walk_changed(spark, path, known, config))


@query("SELECT 'lang=' || lang AS folder, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY lang")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """A versioned table: a reader of an old version isn't touched by later writes."""
    store = Store(spark, shared_folder(spark))
    docs = V.table(spark, d, "documents").select(F.concat(F.lit("lang="), "lang").alias("folder"))
    store.write("docs", docs)
    first = store.read("docs")
    store.write("docs", docs.where("folder != 'lang=de'"), "folder")
    if first.count() < store.read("docs").count():
        raise AssertionError("a version changed")
    return count_by(store.read("docs"), "folder")


_LISTS = "CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END"


def _listings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = V.files(spark, d).select("doc_id", "path", "size", F.lit(DAY).cast("timestamp").alias("mod_time"))
    before = f.where("doc_id % 3 != 0 and path not like '/corpus/src1/%'").drop("doc_id")
    now = f.where("doc_id % 7 != 0 and path not like '/corpus/src2/%'").withColumn("size", F.expr("if(doc_id % 5 = 0, size + 1, size)")).drop("doc_id")
    return before, now


_HAVE = "o AS (SELECT doc_id FROM files WHERE doc_id % 3 <> 0 AND path NOT LIKE '/corpus/src1/%'), w AS (SELECT doc_id FROM files WHERE doc_id % 7 <> 0 AND path NOT LIKE '/corpus/src2/%')"
_DIRS = "SELECT DISTINCT unnest(['/corpus/' || split_part(path, '/', 3), '/corpus/' || split_part(path, '/', 3) || '/' || split_part(path, '/', 4)]) AS path FROM files JOIN {} USING (doc_id)"


@query(
    f"SELECT path, CASE WHEN o.doc_id IS NULL THEN 'create' WHEN w.doc_id IS NULL THEN 'delete' ELSE 'modify' END AS type FROM files LEFT JOIN o USING (doc_id) LEFT JOIN w USING (doc_id) WHERE (o.doc_id IS NULL) <> (w.doc_id IS NULL) OR (o.doc_id IS NOT NULL AND files.doc_id % 5 = 0) "
    "UNION ALL SELECT path, 'create directory' FROM (SELECT * FROM dw EXCEPT SELECT * FROM dold) UNION ALL SELECT path, 'delete directory' FROM (SELECT * FROM dold EXCEPT SELECT * FROM dw)",
    V.FILES_SQL, _HAVE, f"dold AS ({_DIRS.format('o')})", f"dw AS ({_DIRS.format('w')})",
)
def watch_listings(spark: SparkSession, d: str) -> DataFrame:
    return W.listing_events(*_listings(spark, d))


@query("SELECT path, CASE WHEN doc_id % 7 = 0 OR path LIKE '/corpus/src2/%' THEN 'delete' ELSE 'modify' END AS type FROM files", V.FILES_SQL)
def late_stats(spark: SparkSession, d: str) -> DataFrame:
    return W.late_stat(V.files(spark, d).select("path", F.lit("modify").alias("type")), _listings(spark, d)[1])


@query("SELECT path, regexp_extract(path, '[^/]*$') AS name, ext AS extension, size, sha256(text) AS content_hash FROM files", V.FILES_SQL)
def described_names(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("path", "size", F.lit(DAY).cast("timestamp").alias("mod_time"), F.col("text").cast("binary").alias("content"))
    return W.described(f).select("path", "name", "extension", "size", "content_hash")


@query("SELECT count(*) AS n, min(vec_id) AS first FROM embeddings")
def scan_label(spark: SparkSession, d: str) -> DataFrame:
    return W.label_scan(V.table(spark, d, "embeddings"), ["vec_id"]).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))


# --- the graph


@query("SELECT 'files' AS k, count(*) AS n FROM files UNION ALL SELECT rel, count(*) FROM (SELECT 'CONTAINS' AS rel FROM files) GROUP BY rel", V.FILES_SQL)
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("doc_id", "path", "size")
    old, new = f.where("doc_id % 2 = 0"), f.where("doc_id % 4 != 2").withColumn("size", F.col("size") + 1)
    # half of what is known comes again, with the other half of the files
    files, edges = G.upsert_files(old, G.contains_edges(old), new)
    return G.node_counts({"files": files}).withColumnRenamed("label", "k").unionByName(G.edge_counts(edges).withColumnRenamed("rel", "k"))


@query("SELECT vec_id % 50 AS file, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS versions FROM embeddings GROUP BY 1")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "embeddings").select((F.col("vec_id") % 50).cast("string").alias("file_path"), F.floor(F.col("vec_id") / 50).cast("int").alias("index"), F.lit(1).alias("version"), "vec_id")
    out = G.upsert_chunks(c, c.where("vec_id % 3 = 0").withColumn("version", F.lit(2)))
    edges = G.has_chunk_edges(out.withColumn("id", F.col("vec_id").cast("string"))).groupBy(F.col("src_key").alias("file_path")).agg(F.count(F.lit(1)).alias("chunks"))
    return out.groupBy("file_path").agg(F.sum("version").cast("long").alias("versions")).join(edges, "file_path").select(F.col("file_path").cast("long").alias("file"), "chunks", "versions")


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN round(CAST(embedding[1] AS DOUBLE), 3) ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def upsert_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), "embedding")
    out = G.upsert_embeddings(e, e.where("vec_id % 2 = 0"), decimals=3)
    first = F.get("embedding", F.lit(0)).cast("double")
    return out.select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.round(first, 3)).otherwise(F.round(first, 6)).alias("first"))


def _frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    f = V.files(spark, d).select("path")
    chunks = f.select(F.col("path").alias("file_path"), F.md5("path").alias("id"))
    edges = V.edges(spark, d).unionByName(G.has_chunk_edges(chunks))
    dirs = G.directory_tree(f, ["/corpus"])[0]
    state = V.state(spark, d)
    return {"files": f, "chunks": chunks, "chunk_embeddings": chunks.select(F.col("id").alias("chunk_id")), "edges": edges, "directories": dirs, "state": state, "discovery": state.select("path", "content_hash", "size", "mod_time")}


_COUNTS = (
    "SELECT 'files' AS label, count(*) AS n FROM files WHERE {c} UNION ALL SELECT 'chunks', count(*) FROM files WHERE {c} UNION ALL SELECT 'chunk_embeddings', count(*) FROM files WHERE {c} "
    "UNION ALL SELECT 'edges', (SELECT count(*) FROM edges JOIN files ON src_key = path WHERE {c}) + 2 * (SELECT count(*) FROM files WHERE {c})"
)


def _counts(frames: dict[str, DataFrame], *more: str) -> DataFrame:
    return G.node_counts({k: frames[k] for k in ("files", "chunks", "chunk_embeddings", "edges", *more)})


@query(_COUNTS.format(c="doc_id <> 12"), V.FILES_SQL, V.EDGES_SQL)
def delete_file(spark: SparkSession, d: str) -> DataFrame:
    path = V.files(spark, d).where("doc_id = 12").first().path
    return _counts(G.delete_file(_frames(spark, d), path))


@query("SELECT 'directories' AS label, count(DISTINCT '/corpus/' || source || '/' || lang) + count(DISTINCT source) + 2 + 1 - 1 AS n FROM documents UNION ALL SELECT 'edges', (SELECT count(*) FROM files WHERE path NOT LIKE '/corpus/src1/en/%')", V.FILES_SQL)
def directory_changes(spark: SparkSession, d: str) -> DataFrame:
    """A directory is put in, and another goes with its edges; what lies under it stays."""
    f = _frames(spark, d)
    new = spark.createDataFrame([("/corpus/new", "new", False, 0), ("/corpus", "corpus", True, 5)], "path string, name string, is_remembered boolean, file_count long")
    dirs, edges = G.delete_directory(G.upsert_directories(f["directories"], new), f["edges"].where("rel = 'CONTAINS'"), "/corpus/src1/en/")
    return G.node_counts({"directories": dirs, "edges": edges})


@query("SELECT lower(topic) AS topic, count(*) AS n, round(avg(c), 6) AS confidence FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Ärger ' || upper(lang) ELSE 'toxic ' || toxic END AS topic, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE quality END AS c FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 2 = 0 OR toxic IS NOT NULL) GROUP BY 1".replace("lower(topic)", "translate(topic, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
def set_topics(spark: SparkSession, d: str) -> DataFrame:
    new = V.files(spark, d).where("doc_id % 2 = 0").select("path", F.concat(F.lit("Ärger "), F.upper("lang")).alias("name"), F.lit(0.5).alias("confidence"))
    out = G.set_labels(V.edges(spark, d), new, "topics").where("rel = 'COVERS_TOPIC'")
    return out.groupBy(F.col("dst_key").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT lang || chr(1) || t AS key, count(DISTINCT doc_id) AS usage_count FROM documents, (VALUES ('place'), ('name')) v(t) GROUP BY 1")
def set_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one name and two types are two; the same one twice in a file is one."""
    f = V.files(spark, d)
    new = f.select("path", F.explode(F.array(*[F.struct(F.upper("lang").alias("name"), F.lit(t).alias("type")) for t in ("place", "name", "place")])).alias("e")).select("path", "e.*")
    return G.label_usage(G.set_labels(V.edges(spark, d), new, "entities"), "entities")


@query("SELECT 'files' AS k, count(*) + (SELECT count(DISTINCT doc_id % 10) FROM documents WHERE doc_id % 3 = 0) AS n FROM documents UNION ALL SELECT 'references', count(*) FROM documents WHERE doc_id % 3 = 0")
def set_references(spark: SparkSession, d: str) -> DataFrame:
    """References to files that aren't known make stubs; those to anything else are left out."""
    f = V.files(spark, d).select("doc_id", "path")
    new = f.select("doc_id", "path", F.concat(F.lit("/else/"), (F.col("doc_id") % 10).cast("string")).alias("target"), F.when(F.col("doc_id") % 3 == 0, "file").otherwise("url").alias("type"))
    files, edges = G.set_references(f.select("path"), V.edges(spark, d), new)
    return G.node_counts({"files": files, "references": edges.where("rel = 'REFERENCES'")}).withColumnRenamed("label", "k")


@query("SELECT doc_id, doc_id % 4 = 0 AS has_embedding FROM documents")
def chunks_with_embeddings(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    return G.has_embedding(c, c.where("doc_id % 4 = 0").select(F.col("id").alias("chunk_id"))).select("doc_id", "has_embedding")


_PERSIST = (
    "SELECT 'files' AS k, count(*) FILTER (doc_id % 5 <> 1) AS n FROM files UNION ALL SELECT 'chunks', CAST(sum(CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END) AS BIGINT) FROM files "
    "UNION ALL SELECT 'CONTAINS', count(*) FILTER (doc_id % 5 <> 1) FROM files UNION ALL SELECT 'HAS_CHUNK', CAST(sum(CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END) AS BIGINT) FROM files "
    "UNION ALL SELECT 'HAS_TAG', CAST(sum(CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END) AS BIGINT) FROM files UNION ALL SELECT 'COVERS_TOPIC', count(*) FROM labels WHERE doc_id % 5 > 1"
)


@query(_PERSIST, V.FILES_SQL)
def persist_batch(spark: SparkSession, d: str) -> DataFrame:
    """One batch of analysed files: a fifth of the files is replaced, another fifth is to be skipped and goes."""
    f = V.files(spark, d).select("doc_id", "path")
    chunk = lambda df, n: df.select(F.col("path").alias("file_path"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("index")).withColumn("id", F.md5(F.concat("file_path", F.col("index").cast("string"))))
    old = chunk(f, 1)
    vectors = lambda c: c.select(F.col("id").alias("chunk_id"), F.lit("p").alias("provider"))
    frames = {"files": f.select("path"), "chunks": old, "chunk_embeddings": vectors(old), "edges": V.edges(spark, d).unionByName(G.has_chunk_edges(old))}
    mine = f.where("doc_id % 5 = 0")
    none = mine.select("path", F.lit(None).cast("string").alias("name"))
    results = {
        "files": f.where("doc_id % 5 < 2").select("path", F.when(F.col("doc_id") % 5 == 1, "skip").otherwise("chunk").alias("ingest_mode")), "chunks": chunk(mine, 2), "chunk_embeddings": vectors(chunk(mine, 2)),
        "tags": mine.select("path", F.lit("New").alias("name")), "topics": none.withColumn("confidence", F.lit(None).cast("double")), "entities": none.withColumn("type", F.lit(None).cast("string")),
        "references": mine.select("path", F.lit("x").alias("target"), F.lit("url").alias("type")),
    }
    out = G.persist_files(frames, results)
    return G.node_counts({k: out[k] for k in ("files", "chunks")}).withColumnRenamed("label", "k").unionByName(G.edge_counts(out["edges"]).withColumnRenamed("rel", "k"))


# --- state and queues


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE size END AS size FROM (SELECT doc_id, size FROM files)", V.FILES_SQL)
def upsert_state(spark: SparkSession, d: str) -> DataFrame:
    s = V.state(spark, d)
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    out = T.upsert_state(s.where(number % 2 == 0), s.where(number % 2 == 1))
    return T.upsert_discovery(out, s.where(number % 3 == 0).withColumn("size", F.lit(7).cast("long"))).select(number.alias("doc_id"), "size")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE size END AS size, CASE WHEN doc_id % 4 = 0 THEN '2024-03-01' WHEN metadata_analyzed_at IS NOT NULL THEN '2024-01-01' END AS metadata_day, doc_id % 4 <> 0 AND semantic_analyzed_at IS NOT NULL AS analyzed, CASE WHEN doc_id % 8 = 0 THEN 0 WHEN doc_id % 4 = 0 THEN 0 ELSE semantic_retry_count END AS retries FROM state", V.FILES_SQL, V.STATE_SQL)
def record_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Files with a new content hash start their later stages anew."""
    s = V.state(spark, d)
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    new = s.where(number % 4 == 0).select("path", F.lit("new").alias("content_hash"), F.lit("m").alias("metadata_hash"), F.lit(1).cast("long").alias("size"), "mod_time")
    out = T.record_metadata(s, new, day("2024-03-01 00:00:00"))
    return out.select(number.alias("doc_id"), "size", F.date_format("metadata_analyzed_at", "yyyy-MM-dd").alias("metadata_day"), F.col("semantic_analyzed_at").isNotNull().alias("analyzed"), F.col("semantic_retry_count").alias("retries"))


@query("SELECT doc_id, doc_id % 3 <> 0 AND semantic_analyzed_at IS NOT NULL AS analyzed, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE semantic_retry_count END AS retries FROM state", V.FILES_SQL, V.STATE_SQL)
def clear_analysis(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    return T.clear_analysis(V.state(spark, d), number % 3 == 0).select(number.alias("doc_id"), F.col("semantic_analyzed_at").isNotNull().alias("analyzed"), F.col("semantic_retry_count").alias("retries"))


@query("SELECT source, count(*) AS n FROM files WHERE source <> 'src1' AND doc_id <> 5 GROUP BY source", V.FILES_SQL)
def delete_state(spark: SparkSession, d: str) -> DataFrame:
    path = V.files(spark, d).where("doc_id = 5").first().path
    left = T.delete_one(V.state(spark, d), path)
    return count_by(T.delete_under(left, "/corpus/src1/").withColumn("source", F.element_at(F.split("path", "/"), 3)), "source")


@query("SELECT * FROM (VALUES ('/corpus/src1', '{\"a\": 1}'), ('/corpus/src3', NULL)) t(path, config_json)")
def change_roots(spark: SparkSession, d: str) -> DataFrame:
    """Roots are put in, changed and taken out; paths are cleaned first, and double or missing ones are errors."""
    roots = spark.createDataFrame([], "path string, config_json string")
    for p in ("/corpus//src1/", "/corpus/src2", "/corpus/./src3"):
        roots = T.add_root(roots, p)
    for f, error in ((lambda: T.add_root(roots, "/corpus/src2/"), T.PathExists), (lambda: T.remove_root(roots, "/none"), T.PathNotFound)):
        try:
            f()
            raise AssertionError("no error")
        except error:
            pass
    return T.remove_root(T.change_root(roots, "/corpus/src1", config_json=F.lit('{"a": 1}')), "/corpus/src2")


@query("SELECT doc_id FROM files WHERE source IN ('src1', 'src2')", V.FILES_SQL)
def remembered_files(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("/corpus/src1",), ("/corpus/src2",)], "path string")
    return T.remembered_only(V.files(spark, d).select("doc_id", "path"), roots).select("doc_id")


@query("SELECT doc_id FROM files WHERE path LIKE '/corpus/src1/%'", V.FILES_SQL)
def files_under(spark: SparkSession, d: str) -> DataFrame:
    return V.files(spark, d).where(P.under(F.col("path"), "/corpus//src1/")).select("doc_id")


@query("SELECT event_id, value > 50 OR event_id % 3 = 0 AS stale, event_id % 4 = 0 OR event_id % 5 = 0 AS needs FROM events")
def stale_and_old(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    stale = L.is_stale(F.col("value"), F.col("ts"), F.least(F.col("value"), F.lit(50.0)), F.when(F.col("event_id") % 3 != 0, F.col("ts")))
    needs = L.needs_analysis(F.when(F.col("event_id") % 4 != 0, F.col("ts")), F.when(F.col("event_id") % 5 == 0, "v1").otherwise("v2"), "v2")
    return e.select("event_id", stale.alias("stale"), needs.alias("needs"))


@query("SELECT file_path, result_json, status, retry_count FROM (SELECT file_path, result_json, status, CAST(retry_count AS INT) AS retry_count FROM q WHERE id % 6 <> 0 UNION ALL SELECT file_path, 'new', 'pending', 0 FROM q WHERE id % 6 = 0 UNION ALL SELECT '/fresh/' || id, 'new', 'pending', 0 FROM q WHERE id % 100 = 0)", V.QUEUE_SQL.replace("queue AS", "q AS").replace("AS file_path,", "AS file_path, props AS result_json,"))
def enqueue_results(spark: SparkSession, d: str) -> DataFrame:
    """Known rows start anew as pending, others are put in."""
    q = V.queue(spark, d)
    again = q.where("id % 6 = 0").select("file_path", "content_hash", F.lit("new").alias("result_json"))
    fresh = q.where("id % 100 = 0").select(F.concat(F.lit("/fresh/"), F.col("id").cast("string")).alias("file_path"), "content_hash", F.lit("new").alias("result_json"))
    return T.enqueue(q, again.unionByName(fresh), F.col("updated_at")).select("file_path", "result_json", "status", "retry_count")


@query("SELECT id FROM queue WHERE NOT (status = 'completed' AND enqueued_at < TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR OR status = 'failed' AND enqueued_at < TIMESTAMP '2024-01-15' - INTERVAL 7 DAY)", V.QUEUE_SQL)
def purge_queue(spark: SparkSession, d: str) -> DataFrame:
    return T.purge(V.queue(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id")


_CRITICAL = "c AS (SELECT event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE event_type IN ('purchase', 'signup'))"


@query("SELECT id FROM c WHERE back > 10 AND back <= 50", _CRITICAL)
def critical_events(spark: SparkSession, d: str) -> DataFrame:
    """Of the critical events the queue keeps the newest 60; the ten oldest are taken, and then the ten newest acknowledged."""
    kind = F.when(F.col("event_type") == "purchase", "path_deleted").when(F.col("event_type") == "signup", "file_discovered").otherwise("analysis_complete")
    new = V.table(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("event_type"), F.col("props").alias("payload"), F.col("ts").alias("created_at"))
    queue = T.enqueue_events(new.where("false"), new, 60)
    _, queue = T.dequeue_events(queue, 10)
    return T.acknowledge(queue, queue.orderBy(F.desc("created_at"), F.desc("id")).limit(10)).select("id")


@query("SELECT 'u' || s AS subscriber, topic, event_id FROM (SELECT event_id, unnest(CASE event_type WHEN 'purchase' THEN ['index'] WHEN 'signup' THEN ['file//u/' || user_id, 'index'] ELSE [] END) AS topic FROM events) JOIN (SELECT s, CASE WHEN s % 2 = 0 THEN 'index' ELSE 'file//u/' || s END AS t FROM range(0, 6) r(s)) ON t = topic")
def change_notifications(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "rebuild_complete").when(F.col("event_type") == "signup", "analysis_complete").otherwise("other")
    events = V.table(spark, d, "events").select("event_id", kind.alias("type"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"))
    subscriptions = spark.range(6).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("subscriber"), F.when(F.col("id") % 2 == 0, "index").otherwise(F.concat(F.lit("file//u/"), F.col("id").cast("string"))).alias("topic"))
    return notifications(events, subscriptions)


@query("SELECT max(event_id) % 7 + 7 AS version FROM events")
def schema_version(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").agg(F.max("event_id").alias("m")).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("m") % 7 + 7)).alias("version"))
    return T.schema_version(e)


@query("SELECT count(*) AS processed, round(avg(value), 6) AS average_millis, round(count(*) FILTER (event_type = 'click') / 1000, 6) AS load FROM events")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    r = V.table(spark, d, "events").select(F.col("value").alias("millis"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"))
    return I.throughput(r).select("processed", F.round("average_millis", 6).alias("average_millis"), F.round("load", 6).alias("load"))


# --- scalar rules


@query("SELECT event_id, CASE WHEN event_id > 4096 THEN event_id - 4096 ELSE event_id END AS budget FROM events")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", X.token_budget(F.col("event_id")).alias("budget"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 AND l >= 0.95 THEN 'metadata_only' WHEN event_id % 3 = 0 THEN 'chunk' WHEN event_id % 3 = 1 THEN 'semantic_only' ELSE 'skip' END AS mode, event_id % 3 = 0 AND l < 0.8 AS embed FROM (SELECT event_id, event_id % 100 / 100.0 AS l FROM events)")
def degraded_modes(spark: SparkSession, d: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("chunk"), F.lit("semantic_only"), F.lit("skip")), (F.col("event_id") % 3 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", C.degraded(mode, F.col("event_id") % 100 / 100.0).alias("x")).select("event_id", "x.*")


@query("SELECT * FROM (VALUES ('set', 'c'), ('added', 'A,b,c'), ('extensions', '.go,.md'), ('candidates', '100,120,500,7')) t(k, v)")
def patched_config(spark: SparkSession, d: str) -> DataFrame:
    c = L.PathConfig(skip_files=["A", "b"], include_files=["x"])
    out = L.patched(c, {"include_files": ["c"]}, {"skip_files": ["B", "c", "C"], "include_files": ["d"]})
    ks = [S.candidate_k(5, True), S.candidate_k(12, True), S.candidate_k(80, True), S.candidate_k(7, False)]
    rows = [("set", ",".join(out.include_files)), ("added", ",".join(out.skip_files)), ("extensions", ",".join(P.extension_set(["MD", ".go", "md"]))), ("candidates", ",".join(map(str, ks)))]
    return spark.createDataFrame(rows, "k string, v string")


@query("SELECT doc_id, list_concat(['/', '/corpus', '/corpus/' || source, '/corpus/' || source || '/' || lang], [path]) AS up FROM files", V.FILES_SQL)
def path_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return V.files(spark, d).select("doc_id", P.ancestors(F.col("path")).alias("up"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'kept' ELSE 'new' END AS v FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 OR doc_id % 2 = 0")
def cache_store(spark: SparkSession, d: str) -> DataFrame:
    """New entries replace those of their key; corrupt ones count as missing and go."""
    docs = V.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.lit(1).alias("version"))
    cache = docs.join(V.table(spark, d, "labels"), "doc_id").select("doc_id", "key", "version", F.when(F.col("quality") == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(float("nan")))).alias("vector"), F.lit("kept").alias("v"))
    _, missing = K.lookup(docs.where("doc_id % 2 = 0"), cache, K.SEMANTIC_KEY, K.usable(F.col("vector"), F.lit(1)))
    new = missing.select("doc_id", "key", "version", F.array(F.lit(2.0)).alias("vector"), F.lit("new").alias("v"))
    return K.store(cache, new, K.SEMANTIC_KEY, K.usable(F.col("vector"), F.lit(1))).select("doc_id", "v")


@query("SELECT doc_id FROM documents WHERE lang <> 'de'")
def cache_clear(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    return K.clear(docs, F.col("lang") == "de").select("doc_id")


@query("SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first, 16 + 4 * len(embedding) AS bytes FROM embeddings")
def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through the portable binary form and back."""

    @F.pandas_udf("array<float>")
    def back(raw: pd.Series) -> pd.Series:
        return raw.map(K.decode_vector)

    @F.pandas_udf("binary")
    def there(v: pd.Series) -> pd.Series:
        return v.map(lambda x: K.encode_vector(list(x)))

    e = V.table(spark, d, "embeddings").select("vec_id", there("embedding").alias("raw"))
    out = e.select("vec_id", back("raw").alias("v"), F.octet_length("raw").cast("long").alias("bytes"))
    return out.select("vec_id", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).cast("double").alias("first"), "bytes")


# --- exports


def _world(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Regions as directories, nations as files, and edges from nations to their regions as tags."""
    n = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = n.select(F.concat(F.lit("/w/"), "r_name", F.lit("/"), "n_name", F.lit(".md")).alias("path"), F.concat("n_name", F.lit(".md")).alias("name"), F.lit(".md").alias("extension"), F.lit("text/markdown").alias("mime_type"), F.lit("").alias("language"), F.col("n_nationkey").cast("long").alias("size"), F.concat(F.lit("é|"), "n_name", F.lit("\nin "), "r_name").alias("summary"))
    tags = V.table(spark, d, "region").select(F.lower("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("usage_count"))
    dirs = V.table(spark, d, "region").select(F.concat(F.lit("/w/"), "r_name").alias("path"), F.col("r_name").alias("name"), F.lit(False).alias("is_remembered"), F.lit(5).cast("long").alias("file_count"))
    none = tags.where("false")
    edges = G.edges(n.select(F.concat(F.lit("/w/"), "r_name", F.lit("/"), "n_name", F.lit(".md")).alias("p"), F.lower("r_name").alias("t")), "File", "p", "HAS_TAG", "Tag", "t")
    return {"files": files, "directories": dirs, "tags": tags, "topics": none.select("name", F.lit("").alias("description"), "usage_count"), "entities": none.select("name", F.lit("").alias("type"), "usage_count"), "chunks": files.where("size < 3"), "edges": edges}


_WORLD = (
    "f AS (SELECT '/w/' || r_name || '/' || n_name || '.md' AS path, n_name || '.md' AS name, n_nationkey AS size, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), "
    "tail AS (SELECT count(*) AS f, (SELECT count(*) FROM region) AS d, count(*) FILTER (size < 3) AS c, (SELECT count(*) FROM region) AS t, count(*) AS r FROM f)"
)
_TOON = (
    "'@kg v=1 t=1970-01-01T00:00:00Z' || chr(10) || '#f' || chr(10) || (SELECT string_agg(path || '|' || name || '|.md|md||' || size || '|é\\|' || n_name || '\\nin ' || r_name, chr(10) ORDER BY path) FROM f) || chr(10) "
    "|| '#d' || chr(10) || (SELECT string_agg('/w/' || r_name || '|' || r_name || '|0|5', chr(10) ORDER BY r_name) FROM region) || chr(10) || '#t' || chr(10) || (SELECT string_agg(lower(r_name) || '|' || r_regionkey, chr(10) ORDER BY lower(r_name)) FROM region) || chr(10) "
    "|| '@stats f=' || f || ' d=' || d || ' c=' || c || ' t=' || t || ' p=0 e=0 r=' || r || chr(10)"
)
_XML = (
    "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<knowledge_graph><version>1</version><exported_at>1970-01-01T00:00:00Z</exported_at><files>' "
    "|| (SELECT string_agg('<file><path>' || path || '</path><name>' || name || '</name><extension>.md</extension><mime_type>text/markdown</mime_type><language></language><size>' || size || '</size><summary>é|' || n_name || chr(10) || 'in ' || r_name || '</summary></file>', '' ORDER BY path) FROM f) || '</files><directories>' "
    "|| (SELECT string_agg('<directory><path>/w/' || r_name || '</path><name>' || r_name || '</name><is_remembered>false</is_remembered><file_count>5</file_count></directory>', '' ORDER BY r_name) FROM region) || '</directories><tags>' "
    "|| (SELECT string_agg('<tag><name>' || lower(r_name) || '</name><usage_count>' || r_regionkey || '</usage_count></tag>', '' ORDER BY lower(r_name)) FROM region) || '</tags><total_chunks>' || c || '</total_chunks><total_relationships>' || r || '</total_relationships></knowledge_graph>' || chr(10)"
)
_JSON = (
    "'{\"version\": 1, \"exported_at\": \"1970-01-01T00:00:00Z\", \"files\": [' || (SELECT string_agg('{\"path\": \"' || path || '\", \"name\": \"' || name || '\", \"extension\": \".md\", \"mime_type\": \"text/markdown\", \"language\": \"\", \"size\": ' || size || ', \"summary\": \"é|' || n_name || '\\nin ' || r_name || '\"}', ', ' ORDER BY path) FROM f) "
    "|| '], \"directories\": [' || (SELECT string_agg('{\"path\": \"/w/' || r_name || '\", \"name\": \"' || r_name || '\", \"is_remembered\": false, \"file_count\": 5}', ', ' ORDER BY r_name) FROM region) || '], \"tags\": [' "
    "|| (SELECT string_agg('{\"name\": \"' || lower(r_name) || '\", \"usage_count\": ' || r_regionkey || '}', ', ' ORDER BY lower(r_name)) FROM region) || '], \"topics\": [], \"entities\": [], \"total_chunks\": ' || c || ', \"total_relationships\": ' || r || '}'"
)


def _one(spark: SparkSession, *row: str) -> DataFrame:
    return spark.createDataFrame([row], ", ".join(f"{k} string" for k in ("content", "mime")[: len(row)]))


@query(f"SELECT {_TOON} AS content FROM tail", _WORLD)
def export_toon(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, I.read(_world(spark, d), "toon"))


@query(f"SELECT {_XML} AS content FROM tail", _WORLD)
def export_xml(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, I.read(_world(spark, d), "xml"))


@query(f"SELECT {_JSON} AS content FROM tail", _WORLD)
def export_json(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, I.read(_world(spark, d), "json"))


@query(f"SELECT {_XML} AS content, 'application/xml' AS mime FROM tail UNION ALL SELECT {_XML}, 'application/xml' FROM tail UNION ALL SELECT {_JSON}, 'application/json' FROM tail UNION ALL SELECT {_TOON}, 'text/plain' FROM tail", _WORLD)
def index_resources(spark: SparkSession, d: str) -> DataFrame:
    """The index by each of its URIs."""
    out = None
    for uri in ("graph://index", "graph://index/xml", "graph://index/json", "graph://index/toon"):
        mime, content = E.index_resource(_world(spark, d), uri)
        one = _one(spark, content, mime)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT content FROM (SELECT {_TOON} AS content FROM tail)", _WORLD)
def export_enveloped(spark: SparkSession, d: str) -> DataFrame:
    """The context that both hook envelopes carry is the bare export."""
    bodies = {json.loads(I.read(_world(spark, d), "toon", wrap))["hookSpecificOutput"]["additionalContext"] for wrap in ("session-hook", "context-hook")}
    return spark.createDataFrame([(b,) for b in bodies], "content string")


@query("SELECT section, count(*) AS n FROM (SELECT 0 AS section FROM nation UNION ALL SELECT 1 FROM region UNION ALL SELECT 2 FROM region) GROUP BY section")
def export_saved(spark: SparkSession, d: str) -> DataFrame:
    """An export written by the executors, with a partition per section."""
    path = shared_folder(spark)
    E.save(_world(spark, d), path, "json")
    return spark.read.text(path).groupBy(F.col("section").cast("long").alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT path, name, size, coalesce(s, '') AS summary FROM (SELECT path, regexp_extract(path, '[^/]*$') AS name, CASE WHEN doc_id % 2 = 0 THEN size ELSE 0 END AS size, CASE WHEN doc_id % 3 = 0 THEN lang END AS s FROM files)", V.FILES_SQL)
def export_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A section with nulls as empty values and absent columns as empty strings."""
    f = V.files(spark, d).select("path", P.base(F.col("path")).alias("name"), F.when(F.col("doc_id") % 2 == 0, F.col("size")).alias("size"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("summary"))
    return E.snapshot({"files": f}, "files").where("extension = ''").select("path", "name", "size", "summary")


# --- services


class Given:
    """A provider that gives the same vector for any text: the query of a search by a stored vector."""

    name, model = "given", "1"

    def __init__(self, vector: list[float]):
        self.vector, self.dimensions = vector, len(vector)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.vector for _ in texts]


_SIM = (
    "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT path, vec_id, text, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score, "
    "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS exact FROM embeddings JOIN files ON doc_id = vec_id, q WHERE path LIKE '/corpus/src%' AND source IN ('src1', 'src2', 'src3') AND ext IN ('.md', '.txt', '.py'))"
)


@query("SELECT row_number() OVER (ORDER BY exact DESC, printf('%08d', vec_id)) AS rank, score, path, trim(regexp_replace(text, '[\\s\\p{Z}\\x{85}]+', ' ', 'g'))[1:40] AS snippet FROM s QUALIFY rank <= 20", V.FILES_SQL, _SIM)
def search_memory(spark: SparkSession, d: str) -> DataFrame:
    """The flagship service: the best chunks of remembered roots by a query's vector, path and extension filters."""
    f = V.files(spark, d)
    vectors = V.table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("chunk_id"), F.lit("given").alias("provider"), F.lit("1").alias("model"), "embedding")
    chunks = f.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("id"), F.col("path").alias("file_path"), F.col("text").alias("content"), F.lit(0).alias("start_offset"), F.lit(1).alias("end_offset"))
    roots = spark.createDataFrame([(f"/corpus/src{k}",) for k in (1, 2, 3)], "path string")
    vector = [float(x) for x in V.table(spark, d, "embeddings").where("vec_id = 0").first().embedding]
    hits = I.search_memory({"chunk_embeddings": vectors, "chunks": chunks}, roots, Given(vector), "any", top_k=20, path_prefix="/corpus", include_extensions=["md", ".TXT", "py"], snippet_chars=40)
    return hits.select(F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "path", "snippet")


@query("SELECT path, list_sort([lang, source]) AS tags, CASE WHEN doc_id = 12 THEN 1 ELSE 0 END AS chunk_count FROM files WHERE doc_id = 12", V.FILES_SQL)
def file_resource(spark: SparkSession, d: str) -> DataFrame:
    """A remembered file with its relations as JSON; one that isn't remembered gives nothing."""
    f = _frames(spark, d)
    paths = {r.doc_id: r.path for r in V.files(spark, d).where("doc_id in (12, 13)").select("doc_id", "path").collect()}
    roots = spark.createDataFrame([(P_dir(paths[12]),)], "path string")
    both = I.file_resource(f, roots, paths[12]).unionByName(I.file_resource(f, roots.where("false"), paths[13]))
    return both.select(F.from_json("json", "path string, tags array<string>, chunk_count long").alias("j")).select("j.*")


def P_dir(path: str) -> str:
    return path.rsplit("/", 1)[0]


_LEFT = _COUNTS.format(c="source <> 'src1'") + " UNION ALL SELECT 'state', count(*) FROM files WHERE source <> 'src1' UNION ALL SELECT 'roots', 1"


@query(_LEFT, V.FILES_SQL, V.EDGES_SQL)
def forget_root(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("/corpus/src1",), ("/corpus/src2",)], "path string")
    out, left = I.forget(_frames(spark, d), roots, "/corpus/src1/")
    return _counts(out, "state").unionByName(G.node_counts({"roots": left}))


@query("SELECT 'todo' AS label, count(*) AS n FROM documents WHERE false UNION ALL SELECT 'files', 3 UNION ALL SELECT 'state', 3")
def rebuild_roots(spark: SparkSession, d: str) -> DataFrame:
    """Roots are walked, what they no longer hold goes, and files as the state knows them are left alone."""
    path = shared_folder(spark)
    root = spark.range(1).select(W.plain_path(F.lit(path))).first()[0]
    spark.range(3).select(F.col("id").cast("string").alias("value"), F.col("id").alias("k")).repartition(1).write.partitionBy("k").text(path)
    config = L.PathConfig(skip_files=["_*"])
    seen = W.listed(spark, root, config)
    gone = spark.createDataFrame([(f"{root}/gone.md",)], "path string")
    state = seen.select("path", "size", "mod_time", F.current_timestamp().alias("semantic_analyzed_at")).unionByName(gone, allowMissingColumns=True)
    chunks = seen.select(F.col("path").alias("file_path"), F.col("path").alias("id"))
    frames = {"files": state.select("path"), "chunks": chunks, "chunk_embeddings": chunks.select(F.col("id").alias("chunk_id")), "edges": G.has_chunk_edges(chunks), "state": state, "discovery": state.select("path")}
    todo, out = I.rebuild(spark, frames, {root: config, f"{root}-none": config})
    return G.node_counts({"todo": todo, "files": out["files"], "state": out["state"]})


@query("SELECT * FROM (VALUES ('ok', 1), ('missing', 1)) t(status, n)")
def root_health(spark: SparkSession, d: str) -> DataFrame:
    kept, dropped = W.healthy_roots(["/", "/no/such/root"])
    return count_by(spark.createDataFrame([(W.root_health(r),) for r in kept + dropped], "status string"), "status")
