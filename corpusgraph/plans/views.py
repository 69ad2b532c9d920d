"""The supplied tables seen as files, nodes, edges and state; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import paths as P
from corpusgraph.operators import graph as G

EXTENSIONS = [".md", ".txt", ".py", ".json", ".html", ".csv", ".log", ".sql", ".pdf", ".png", ".zip", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int = 5000) -> DataFrame:
    """A small table in a task per so many rows: where much is made of each row, tasks by its bytes are too few."""
    n = -(-df.count() // rows)
    return df.repartition(n) if n > 1 else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, source, lang, text, size, content_hash of each document as a file."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return d.select("doc_id", path.alias("path"), "source", "lang", "text", F.octet_length("text").cast("long").alias("size"))


FILES_SQL = (
    "files AS (SELECT doc_id, '/corpus/' || source || '/' || lang || '/doc_' || doc_id || ext AS path, ext, source, lang, text, CAST(strlen(text) AS BIGINT) AS size "
    "FROM (SELECT *, ([" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "])[CAST(doc_id % 12 AS INT) + 1] AS ext FROM documents))"
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of documents to their language and source as tags and to a topic, of labels' toxicity."""
    f = files(spark, sf_dir)
    tags = G.edges(f, "File", "path", "HAS_TAG", "Tag", "lang").unionByName(G.edges(f, "File", "path", "HAS_TAG", "Tag", "source"))
    labels = f.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("topic", F.concat(F.lit("toxic "), F.col("toxic").cast("string")))
    topics = G.edges(labels, "File", "path", "COVERS_TOPIC", "Topic", "topic", F.col("quality").cast("double"))
    return tags.unionByName(topics).unionByName(G.contains_edges(f))


EDGES_SQL = (
    "edges AS (SELECT path AS src_key, 'HAS_TAG' AS rel, lang AS dst_key, CAST(NULL AS DOUBLE) AS confidence FROM files "
    "UNION ALL SELECT path, 'HAS_TAG', source, NULL FROM files "
    "UNION ALL SELECT path, 'COVERS_TOPIC', 'toxic ' || toxic, CAST(quality AS DOUBLE) FROM files JOIN labels USING (doc_id) "
    "UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), 'CONTAINS', path, NULL FROM files)"
)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File state of the documents; those with labels are analysed, good ones embedded, bad ones failed once."""
    f = files(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return f.select(
        "path", F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("string").alias("metadata_hash"), "size", day.alias("mod_time"),
        F.when(F.col("doc_id") % 10 != 0, day).alias("metadata_analyzed_at"), F.when(F.col("quality").isNotNull() & (F.col("doc_id") % 10 != 0), day).alias("semantic_analyzed_at"),
        F.when(F.col("quality") == 0, F.lit("bad")).alias("semantic_error"), (F.col("doc_id") % 5).cast("int").alias("semantic_retry_count"),
        F.when((F.col("quality") == 1) & (F.col("doc_id") % 10 != 0), day).alias("embeddings_analyzed_at"), F.lit(None).cast("string").alias("embeddings_error"), F.lit(0).alias("embeddings_retry_count"),
    )


STATE_SQL = (
    "state AS (SELECT path, size, doc_id, CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01' END AS metadata_analyzed_at, "
    "CASE WHEN quality IS NOT NULL AND doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01' END AS semantic_analyzed_at, CAST(doc_id % 5 AS INT) AS semantic_retry_count, "
    "CASE WHEN quality = 1 AND doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01' END AS embeddings_analyzed_at FROM files LEFT JOIN labels USING (doc_id))"
)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of the persistence queue."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "inflight", "completed", "failed")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("file_path"), F.md5(F.col("event_id").cast("string")).alias("content_hash"), F.col("props").alias("result_json"),
        status.alias("status"), (F.col("event_id") % 3).cast("int").alias("retry_count"), F.lit(None).cast("string").alias("error_message"), F.col("ts").alias("enqueued_at"), F.col("ts").alias("updated_at"),
    )


QUEUE_SQL = (
    "queue AS (SELECT event_id AS id, '/u/' || user_id AS file_path, (['pending', 'inflight', 'completed', 'failed'])[CAST(event_id % 4 AS INT) + 1] AS status, "
    "CAST(event_id % 3 AS INT) AS retry_count, ts AS enqueued_at FROM events)"
)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file changes of their users."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for p in {"signup": "create", "click": "modify", "view": "modify", "purchase": "delete"}.items() for x in p])[F.col("event_type")]
    return e.select(F.col("user_id").cast("string").alias("path"), "ts", "event_id", kind.alias("type"))


def parents(df: DataFrame) -> DataFrame:
    return df.withColumn("parent", P.directory(F.col("path")))
