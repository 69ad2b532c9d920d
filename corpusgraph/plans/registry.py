"""The named queries of the engine and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import classify as C
from corpusgraph.functions import paths as P
from corpusgraph.functions import text as X
from corpusgraph.functions.vectors import mean_vectors
from corpusgraph.operators import cache as K
from corpusgraph.operators import export as E
from corpusgraph.operators import filters as L
from corpusgraph.operators import graph as G
from corpusgraph.operators import search as S
from corpusgraph.operators import state as T
from corpusgraph.operators.chunking.udf import chunk_files
from corpusgraph.plans import formats, services
from corpusgraph.plans import views as V
from corpusgraph.providers import HashedEmbeddings, KeywordSemantics, analyze, embed
from corpusgraph.sources.files import described, lookup, raw_query
from corpusgraph.streaming.coalesce import coalesce_batch, fs_event

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ROOTS = ["/corpus/src1", "/corpus/src1/en", "/corpus/src2/de", "/corpus/src3/fr/doc_3.json", "/corpus"]
CONFIG = L.PathConfig(skip_extensions=["log", ".zip"], skip_files=["doc_1*.md"], include_files=["doc_2?.m*"], skip_directories=["f*"], include_directories=["fr"])
FROM = "SELECT {} FROM "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with the SQL that says the same."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_(*views: str, body: str) -> str:
    return "WITH " + ", ".join(views) + " " + body


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in V.table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


_SCORES = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS score FROM embeddings, q WHERE vec_id <> 0)"


# --- search


@query(f"WITH {_SCORES} SELECT vec_id, label, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = S.top_k(V.table(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", where=F.col("vec_id") != 0)
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


def _search(spark: SparkSession, d: str, mode: str, **kw) -> DataFrame:
    found = S.search(V.table(spark, d, "embeddings").where("vec_id != 0"), S.Query(_first_vector(spark, d), top_k=kw.pop("k", 10), min_score=kw.pop("least", None)), "vec_id", path_col=None, mode=mode, where=F.col("label").isin(2, 3), **kw)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SCORES}, h AS (SELECT * FROM s WHERE label IN (2, 3) ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, label, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM h")
def search_exact(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "exact")


@query(f"WITH {_SCORES}, c AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 100), h AS (SELECT * FROM c WHERE label IN (2, 3) ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, label, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM h")
def search_compat(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "compat")


@query(f"WITH {_SCORES}, h AS (SELECT * FROM s WHERE label IN (2, 3) AND score >= 0.1 ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, label, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM h")
def search_min_score(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "exact", k=80, least="0.1")


@query("SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label")
def centroid_by_label(spark: SparkSession, d: str) -> DataFrame:
    out = mean_vectors(V.table(spark, d, "embeddings"), "label", "embedding")
    return out.select("label", F.transform("embedding", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"WITH {_SCORES}, h AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10) SELECT doc_id, round(score, 6) AS score, strlen(text) AS size FROM h JOIN documents ON doc_id = vec_id")
def hits_join_chunks(spark: SparkSession, d: str) -> DataFrame:
    hits = S.top_k(V.table(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", where=F.col("vec_id") != 0).select(F.col("vec_id").alias("chunk_id"), "score")
    docs = V.table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return G.hits_with_chunks(hits, docs).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.octet_length("text").cast("long").alias("size"))


def _cut(text: str, start: str, stop: str) -> str:
    """SQL for the bytes start to stop of a text as a string: the bytes of a character that an edge cuts
    are replacement marks, one for each at the start and one for all at the end."""
    piece = f"CASE WHEN e <= {start} OR s >= {stop} THEN '' WHEN s < {start} THEN repeat(chr(65533), CAST(least(e, {stop}) - ({start}) AS BIGINT)) WHEN e > {stop} THEN chr(65533) ELSE c END"
    chars = f"SELECT k, substr({text}, k, 1) AS c, strlen(substr({text}, 1, k - 1)) AS s, strlen(substr({text}, 1, k)) AS e FROM (SELECT unnest(range(1, length({text}) + 1)) AS k)"
    return f"coalesce((SELECT string_agg({piece}, '' ORDER BY k) FROM ({chars}) ch), '')"


@query(f"SELECT doc_id, trim(regexp_replace(cut, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g')) AS snippet FROM (SELECT doc_id, {_cut('t', '10', '70')} AS cut FROM (SELECT doc_id, substr(text, 1, 70) AS t FROM documents))")
def snippet_read(spark: SparkSession, d: str) -> DataFrame:
    """Bytes 10 to 70 of every text, also where an edge lies inside a character."""
    return V.table(spark, d, "documents").select("doc_id", S.snippet(F.col("text"), F.lit(10), F.lit(70)).alias("snippet"))


# --- hashes, strings, numbers


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, sha256(sha256(text) || ':analysis:m1') AS key, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS path FROM documents")
def semantic_cache_key(spark: SparkSession, d: str) -> DataFrame:
    h = X.content_hash(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", X.semantic_key(h, "analysis", "m1").alias("key"), X.cache_path(F.concat(F.lit("sha256:"), h)).alias("path"))


@query(with_(V.FILES_SQL, "b AS (SELECT doc_id, path || '|' || size || '|' || doc_id AS s FROM files)", body="SELECT doc_id, lpad(lower(printf('%x', CAST(h AS UBIGINT))), 16, '0') AS metadata_hash FROM (SELECT doc_id, list_reduce([CAST(0 AS UHUGEINT)] || list_transform(range(1, strlen(s) + 1), lambda k: CAST(ascii(s[k]) AS UHUGEINT)), lambda a, x: (a * 31 + x) % 18446744073709551616) AS h FROM b)"))
def metadata_hash(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d)
    return f.select("doc_id", X.metadata_hash(F.concat_ws("|", "path", F.col("size").cast("string"), F.col("doc_id").cast("string"))).alias("metadata_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_contents(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, CAST((strlen(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


_MARK = "chr(10) || chr(10) || '[...truncated...]' || chr(10) || chr(10)"


@query(
    f"SELECT conv_id, turn, CASE WHEN n > 160 THEN {_cut('head', '0', '112')} || {_MARK} || {_cut('tail', 'strlen(tail) - 48', 'strlen(tail)')} ELSE text END AS text, "
    f"sha256(CASE WHEN n > 160 THEN array_slice(encode(text), 1, 112) || encode({_MARK}) || array_slice(encode(text), n - 47, n) ELSE encode(text) END) AS bytes_sha256 "
    "FROM (SELECT conv_id, turn, text, strlen(text) AS n, substr(text, 1, 112) AS head, right(text, 48) AS tail FROM conversations)"
)
def condense_text(spark: SparkSession, d: str) -> DataFrame:
    """Every turn condensed by bytes: the text with cut characters replaced, and the digest of the bytes."""
    cut = X.condensed(F.col("text"), 40)
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.make_valid_utf8(cut).alias("text"), X.content_hash(cut).alias("bytes_sha256"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}\\x{85}]+', ' ', 'g')) AS text FROM documents")
def compact_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.compact(F.col("text")).alias("text"))


@query("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents")
def normalize_ascii(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.normal_name(F.col("text")).alias("text"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversation_join(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "conversations").groupBy("conv_id").agg(X.joined_in_order(F.col("turn"), F.col("text")).alias("text"))


@query("SELECT event_id, least(greatest(value, 10), 50) AS clamped, CAST(pow(2, event_id % 4) AS DOUBLE) AS delay FROM events")
def clamp_and_backoff(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", X.clamped(F.col("value"), 10.0, 50.0).alias("clamped"), X.backoff(F.lit(1.0), F.col("event_id") % 4 + 1).alias("delay"))


_LEVEL = "CASE WHEN regexp_matches(l, '(?i)\\b(FATAL|CRITICAL)\\b') THEN 'FATAL' WHEN regexp_matches(l, '(?i)\\b(ERROR|ERR|SEVERE)\\b') THEN 'ERROR' WHEN regexp_matches(l, '(?i)\\b(WARN(?:ING)?)\\b') THEN 'WARN' WHEN regexp_matches(l, '(?i)\\b(DEBUG|TRACE|VERBOSE)\\b') THEN 'DEBUG' ELSE 'INFO' END"
_LINE = "(SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || event_type || ' value' AS l, ts FROM events)"


@query(f"SELECT event_id, {_LEVEL} AS level FROM {_LINE}")
def log_levels(spark: SparkSession, d: str) -> DataFrame:
    return _log_lines(spark, d).select("event_id", X.log_level(F.col("l")).alias("level"))


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", "user_id", "ts", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), "event_type", F.lit(" value")).alias("l"))


@query(f"SELECT user_id, {_LEVEL} AS level, count(*) AS n, CAST(epoch_us(date_trunc('second', min(ts))) AS BIGINT) AS first_us FROM {_LINE} GROUP BY ALL")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = _log_lines(spark, d).withColumn("level", X.log_level(F.col("l"))).withColumn("at", X.log_time(F.concat(F.regexp_extract("l", r"^\S+", 0), F.lit("Z "))))
    return lines.groupBy("user_id", "level").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("at")).alias("first_us"))


@query("SELECT doc_id, CASE WHEN s = 0 THEN '' WHEN p = s THEN 'postgresql' ELSE 'oracle' END AS dialect FROM (SELECT doc_id, p, o, greatest(p, o) AS s FROM (SELECT doc_id, CAST(contains(upper(text), '::') AS INT) AS p, CAST(contains(upper(text), 'NVL(') AS INT) AS o FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || '::' WHEN 1 THEN text || ' nvl(' ELSE text END AS text FROM documents)))")
def sql_dialects(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("::"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" nvl("))).otherwise(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", X.sql_dialect(text).alias("dialect"))


# --- classification and filters

_TYPE = "CASE WHEN ext IN ('.json', '.csv') THEN 'structured' WHEN ext IN ('.md', '.html', '.pdf') THEN 'document' WHEN ext = '.png' THEN 'image' WHEN ext = '.zip' THEN 'archive' ELSE 'text' END"
#: A text whose first 4096 bytes end inside a character counts as binary.
_KIND = f"(CASE WHEN {_TYPE} NOT IN ('image', 'archive') AND try(decode(array_slice(encode(text), 1, 4096))) IS NULL THEN 'binary' ELSE {_TYPE} END)"


@query(with_(V.FILES_SQL, body=f"SELECT doc_id, {_KIND} AS kind, CASE ext WHEN '.py' THEN 'python' WHEN '.sql' THEN 'sql' ELSE '' END AS language, CASE {_KIND} WHEN 'image' THEN 'semantic_only' WHEN 'archive' THEN 'metadata_only' WHEN 'binary' THEN 'metadata_only' ELSE 'chunk' END AS mode, CASE WHEN {_KIND} IN ('image', 'archive', 'binary') THEN {_KIND} ELSE '' END AS reason FROM files"))
def classify_files(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("doc_id", "path", "size", F.col("text").cast("binary").alias("content"))
    f = f.withColumn("p", C.probe(F.col("path"), F.col("content")))
    return f.select("doc_id", "p.kind", "p.language", C.decide(F.col("p.kind"), F.col("size")).alias("x")).select("doc_id", "kind", "language", "x.mode", "x.reason")


@query("""
    WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN chr(10) || ' <?xml version="1.0"?>' || html WHEN 2 THEN 'plain ' || html WHEN 3 THEN 'x' || chr(1) || html ELSE substr(html, 1, 300) || repeat('aé', 1400) END AS t FROM pages)
    SELECT page_id, (['text/html', 'text/xml', 'text/plain', 'application/octet-stream', 'text/html'])[CAST(page_id % 5 AS INT) + 1] AS mime, (['document', 'structured', 'text', 'binary', 'document'])[CAST(page_id % 5 AS INT) + 1] AS kind,
           try(decode(array_slice(encode(t), 1, 4096))) IS NOT NULL AS likely_text FROM p""")
def classify_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages, and texts of other types made of them, by their content: a peek that ends inside a character is no text."""
    k, html = F.col("page_id") % 5, F.col("html")
    made = F.when(k == 0, html).when(k == 1, F.concat(F.lit('\n <?xml version="1.0"?>'), html)).when(k == 2, F.concat(F.lit("plain "), html)).when(k == 3, F.concat(F.lit("x\x01"), html)).otherwise(F.concat(F.substring(html, 1, 300), F.lit("aé" * 1400)))
    peek = F.substring(made.cast("binary"), 1, C.PEEK)
    mime = C.mime_type(F.concat(F.lit("/p"), F.col("page_id").cast("string")), peek)
    return V.table(spark, d, "pages").select("page_id", mime.alias("mime"), C.kind_of(mime).alias("kind"), C.likely_text(peek).alias("likely_text"))


@query(with_(V.FILES_SQL, body="SELECT doc_id FROM files WHERE (lang = 'fr' OR lang NOT LIKE 'f%') AND (regexp_matches(path, '/doc_2[^/]\\.m[^/]*$') OR NOT (ext IN ('.log', '.zip') OR regexp_matches(path, '/doc_1[^/]*\\.md$')) AND false)"))
def file_filter_include(spark: SparkSession, d: str) -> DataFrame:
    return V.files(spark, d).where(L.path_passes(F.col("path"), "/corpus", CONFIG)).select("doc_id")


@query(with_(V.FILES_SQL, body="SELECT doc_id FROM files WHERE NOT (ext IN ('.log', '.zip') OR regexp_matches(path, '/doc_1[^/]*\\.md$')) AND lang NOT LIKE 'f%'"))
def file_filter_skip(spark: SparkSession, d: str) -> DataFrame:
    c = L.PathConfig(skip_extensions=CONFIG.skip_extensions, skip_files=CONFIG.skip_files, skip_directories=CONFIG.skip_directories)
    return V.files(spark, d).where(L.path_passes(F.col("path"), "/corpus", c)).select("doc_id")


@query(with_(V.FILES_SQL, body="SELECT doc_id FROM files WHERE path LIKE '%.md' OR path LIKE '/corpus/src1/%'"))
def export_patterns(spark: SparkSession, d: str) -> DataFrame:
    return V.files(spark, d).where(P.any_of([P.export_pattern(p, F.col("path")) for p in ("*.md", "/corpus/src1/*")])).select("doc_id")


@query("SELECT event_id, event_id % 4 = 0 AS noise, CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'create' WHEN 'click' THEN 'modify' END AS type FROM events")
def watch_events(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("/w/f"), F.col("event_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".swp", ".txt", ".go", "")]), (F.col("event_id") % 4 + 1).cast("int")))
    op = F.create_map(*[F.lit(x) for p in {"purchase": "Rename", "signup": "Create", "click": "Write", "view": "Chmod"}.items() for x in p])[F.col("event_type")]
    return V.table(spark, d, "events").select("event_id", P.editor_noise(name).alias("noise"), fs_event(op).alias("type"))


@query(with_(V.FILES_SQL, V.STATE_SQL, body="SELECT path, 'semantic' AS stage FROM state WHERE metadata_analyzed_at IS NOT NULL AND semantic_analyzed_at IS NULL AND semantic_retry_count < 3 UNION ALL SELECT path, 'metadata' FROM state WHERE metadata_analyzed_at IS NULL UNION ALL SELECT path, 'embeddings' FROM state WHERE semantic_analyzed_at IS NOT NULL AND embeddings_analyzed_at IS NULL"))
def needs_work(spark: SparkSession, d: str) -> DataFrame:
    s = V.state(spark, d)
    each = [(L.needs_semantic(s), "semantic"), (L.needs_metadata(s), "metadata"), (L.needs_embeddings(s), "embeddings")]
    out = None
    for df, stage in each:
        one = df.select("path", F.lit(stage).alias("stage"))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_(V.FILES_SQL, V.STATE_SQL, body="SELECT f.doc_id FROM files f LEFT JOIN state s ON s.path = f.path AND s.doc_id % 7 <> 0 WHERE s.path IS NULL OR f.doc_id % 3 = 0 OR s.semantic_analyzed_at IS NULL"))
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    now = V.files(spark, d).select("doc_id", "path", (F.col("size") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("size"), day.alias("mod_time"))
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    return L.changed(now, V.state(spark, d).where(number % 7 != 0)).select("doc_id")


# --- joins, state, reconciling


@query(with_(V.FILES_SQL, "r AS (SELECT unnest([" + ", ".join(f"'{r}'" for r in ROOTS) + "]) AS root)", body="SELECT doc_id, arg_max(root, length(root)) AS root FROM files LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY doc_id"))
def remembered_ancestor(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([(r,) for r in ROOTS], "path string")
    return T.deepest_root(V.files(spark, d).select("doc_id", "path"), roots).select("doc_id", "root")


@query(with_(V.FILES_SQL, body="SELECT doc_id, f.path FROM files f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id)"))
def reconcile_stale(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("doc_id", "path")
    seen = f.join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    roots = spark.createDataFrame([("/corpus",)], "path string")
    stale = T.stale_paths(f.select("path"), f.select("path"), seen.select("path"), roots)
    return stale.join(f, "path").select("doc_id", "path")


@query(with_(V.FILES_SQL, V.STATE_SQL, body="SELECT count(*) AS files, count(semantic_analyzed_at) AS analyzed, count(embeddings_analyzed_at) AS embedded FROM state WHERE starts_with(path, '/corpus/src1/')"))
def list_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.counts_under(V.state(spark, d), "/corpus/src1")


@query(with_(V.FILES_SQL, V.STATE_SQL, "r AS (SELECT unnest(['/corpus/src1', '/corpus/src2', '/gone']) AS path, unnest(['ok', 'denied', 'error']) AS status)", body="SELECT r.path, status, CASE WHEN status = 'ok' THEN count(s.path) END AS files, CASE WHEN status = 'ok' THEN count(semantic_analyzed_at) END AS analyzed, CASE WHEN status = 'ok' THEN count(embeddings_analyzed_at) END AS embedded FROM r LEFT JOIN state s ON starts_with(s.path, r.path || '/') GROUP BY r.path, status"))
def list_roots(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("/corpus/src1",), ("/corpus/src2",), ("/gone",)], "path string")
    health = spark.createDataFrame([("/corpus/src1", "ok"), ("/corpus/src2", "denied")], "path string, status string")
    return S.list_roots(T.with_status(roots, health), T.deepest_root(V.state(spark, d), roots))


@query(with_(V.QUEUE_SQL, body="SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'inflight') AS inflight, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total, epoch_us(min(enqueued_at) FILTER (status = 'pending')) AS oldest_us FROM queue"))
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    out = T.queue_stats(V.queue(spark, d))
    return out.select("pending", "inflight", "completed", "failed", "total", F.unix_micros(F.col("oldest_pending").cast("timestamp")).alias("oldest_us"))


@query(with_(V.QUEUE_SQL, body="SELECT id, file_path, 'inflight' AS status FROM queue WHERE status = 'pending' ORDER BY enqueued_at, id LIMIT 25"))
def dequeue_fifo(spark: SparkSession, d: str) -> DataFrame:
    return T.dequeue(V.queue(spark, d), 25, F.current_timestamp())[0].select("id", "file_path", "status")


@query(with_(V.QUEUE_SQL, body="SELECT id, CASE WHEN id % 4 <> 1 THEN status WHEN id % 8 = 1 THEN 'completed' WHEN retry_count + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN id % 8 = 5 THEN retry_count + 1 ELSE retry_count END AS retry_count FROM queue"))
def queue_finish(spark: SparkSession, d: str) -> DataFrame:
    q = V.queue(spark, d)
    results = q.where("status = 'inflight'").select("id", F.when(F.col("id") % 8 == 5, F.lit("x")).alias("error"))
    return T.finish(q, results, F.col("updated_at")).select("id", "status", "retry_count")


@query(with_(V.FILES_SQL, V.STATE_SQL, body="SELECT path, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN semantic_analyzed_at IS NOT NULL ELSE semantic_analyzed_at IS NOT NULL END AS done, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN semantic_retry_count + 1 ELSE semantic_retry_count END AS retries FROM state"))
def stage_results(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    s = V.state(spark, d)
    results = s.where(number % 4 < 2).select("path", F.when(number % 4 == 1, F.lit("x")).alias("error"))
    out = T.record_stage(s, results, "semantic", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return out.select("path", F.col("semantic_analyzed_at").isNotNull().alias("done"), F.col("semantic_retry_count").alias("retries"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice + 1 FROM orders WHERE o_orderkey % 100 = 0")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    more = new.where("o_orderkey % 100 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return G.upsert(old, new.unionByName(more), ["o_orderkey"])


# --- the graph


@query(with_(V.FILES_SQL, V.EDGES_SQL, body="SELECT dst_key AS key, count(DISTINCT src_key) AS usage_count FROM edges WHERE rel = 'HAS_TAG' GROUP BY dst_key"))
def tag_usage(spark: SparkSession, d: str) -> DataFrame:
    return G.label_usage(V.edges(spark, d), "tags")


@query(with_(V.FILES_SQL, V.EDGES_SQL, body="SELECT path, CASE WHEN path LIKE '/corpus/src1/%' THEN ['new', 'x'] ELSE [lang, source] END AS tags FROM files WHERE path NOT LIKE '/corpus/src2/%'").replace("[lang, source]", "list_sort([lang, source])"))
def set_tags(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("path")
    own = f.where(F.col("path").startswith("/corpus/src1/")).select("path", F.explode(F.array(F.lit("New"), F.lit("x"), F.lit("X"))).alias("name"))
    none = f.where(F.col("path").startswith("/corpus/src2/")).select("path", F.lit(None).cast("string").alias("name"))
    out = G.set_labels(V.edges(spark, d), own.unionByName(none), "tags").where("rel = 'HAS_TAG'")
    return out.groupBy(F.col("src_key").alias("path")).agg(F.array_sort(F.collect_set("dst_key")).alias("tags"))


@query(with_(V.FILES_SQL, V.EDGES_SQL, body="SELECT path, list_sort([lang, source]) AS tags, coalesce(t.topic, '') AS topic, t.confidence FROM files LEFT JOIN (SELECT src_key, dst_key AS topic, confidence FROM edges WHERE rel = 'COVERS_TOPIC') t ON src_key = path"))
def file_relations(spark: SparkSession, d: str) -> DataFrame:
    out = G.file_relations(V.files(spark, d).select("path"), V.edges(spark, d))
    return out.select("path", "tags", F.coalesce(F.get("topics", F.lit(0))["name"], F.lit("")).alias("topic"), F.get("topics", F.lit(0))["confidence"].alias("confidence"))


@query(with_(V.FILES_SQL, V.EDGES_SQL, body="SELECT rel, count(*) AS n FROM edges GROUP BY rel"))
def rel_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_counts(V.edges(spark, d))


@query("SELECT 'customers' AS label, count(*) AS n FROM customer UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier UNION ALL SELECT 'lineitems', count(*) FROM lineitem")
def node_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.node_counts({k: V.table(spark, d, t) for k, t in (("customers", "customer"), ("parts", "part"), ("suppliers", "supplier"), ("lineitems", "lineitem"))})


@query(with_(V.FILES_SQL, "c AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS n FROM files GROUP BY 1)", body="SELECT path, regexp_extract(path, '[^/]*$') AS name, path = '/corpus' AS is_remembered, coalesce(n, 0) AS file_count FROM (SELECT path FROM c UNION SELECT DISTINCT '/corpus/' || source FROM documents UNION SELECT '/corpus' UNION SELECT '/') LEFT JOIN c USING (path)"))
def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    return G.directory_tree(V.files(spark, d), ["/corpus"])[0]


@query(with_(V.FILES_SQL, V.EDGES_SQL, body="SELECT 'files' AS k, count(*) AS n FROM files WHERE path NOT LIKE '/corpus/src1/%' UNION ALL SELECT 'chunks', count(*) FROM files WHERE path NOT LIKE '/corpus/src1/%' UNION ALL SELECT 'edges', count(*) FROM edges WHERE src_key NOT LIKE '/corpus/src1/%' AND dst_key NOT LIKE '/corpus/src1/%'"))
def delete_subtree(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("path")
    chunks = f.select(F.col("path").alias("file_path"), F.md5("path").alias("id"))
    frames = {"files": f, "chunks": chunks, "chunk_embeddings": chunks.select(F.col("id").alias("chunk_id")), "edges": V.edges(spark, d)}
    out = G.delete_subtree(frames, "/corpus/src1")
    return G.node_counts({k: out[k] for k in ("files", "chunks", "edges")}).withColumnRenamed("label", "k")


@query("SELECT vec_id, label FROM embeddings WHERE NOT (vec_id = 7 AND label = (SELECT label FROM embeddings WHERE vec_id = 7))")
def delete_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "embeddings").select("vec_id", "label", F.col("vec_id").cast("string").alias("chunk_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"))
    return G.delete_embeddings(e, "7", "p", "m").select("vec_id", "label")


@query("SELECT c_custkey, n_name, r_name, count(o_orderkey) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def customer_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: V.table(spark, d, n)
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"))
    out = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.join(n, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 17")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup(V.table(spark, d, "part"), "p_partkey", 17).select("p_partkey", "p_name")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity < 30 GROUP BY l_returnflag")
def raw_sql(spark: SparkSession, d: str) -> DataFrame:
    return raw_query(spark, "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM corpusgraph_lineitem WHERE l_quantity < :most GROUP BY l_returnflag", {"corpusgraph_lineitem": V.table(spark, d, "lineitem")}, most=30)


# --- caches, export


@query("SELECT 'hit' AS what, count(*) AS n FROM documents d JOIN labels l USING (doc_id) UNION ALL SELECT 'miss', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").cast("int").alias("chunk_index"))
    kept = docs.join(V.table(spark, d, "labels"), "doc_id").select("content_hash", "chunk_index", "quality")
    hits, misses = K.lookup(docs, kept, ["content_hash", "chunk_index"])
    return G.node_counts({"hit": hits, "miss": misses}).withColumnRenamed("label", "what")


@query("SELECT count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.stats(V.table(spark, d, "conversations"), "text")


_HEAD = "path || '|' || regexp_extract(path, '[^/]*$') || '|' || ext || '|' || CASE ext WHEN '.py' THEN 'py' WHEN '.md' THEN 'md' WHEN '.json' THEN 'json' WHEN '.html' THEN 'html' WHEN '.csv' THEN 'csv' WHEN '.sql' THEN 'x-sql' WHEN '.pdf' THEN 'pdf' WHEN '.png' THEN 'png' WHEN '.zip' THEN 'zip' WHEN '.txt' THEN 'txt' ELSE 'bin' END || '|' || CASE ext WHEN '.py' THEN 'python' WHEN '.sql' THEN 'sql' ELSE '' END || '|' || size || '|'"
_SAFE = "replace(replace(replace({}, '|', '\\|'), chr(10), '\\n'), chr(13), '')"


@query(with_(
    V.FILES_SQL, f"h AS (SELECT {_HEAD} AS head, text, substr(text, 1, 97) AS t, strlen(text) > 100 AS long FROM files)",
    "w AS (SELECT *, (SELECT coalesce(max(k), 0) FROM (SELECT unnest(range(1, length(t) + 1)) AS k) WHERE strlen(substr(t, 1, k)) <= 97) AS whole FROM h)",
    body=f"SELECT head || CASE WHEN long THEN {_SAFE.format(_cut('t', '0', '97'))} || '...' ELSE {_SAFE.format('text')} END AS line, "
    f"sha256(encode(head) || CASE WHEN long THEN encode({_SAFE.format('substr(t, 1, whole)')}) || array_slice(encode(t), strlen(substr(t, 1, whole)) + 1, 97) || encode('...') ELSE encode({_SAFE.format('text')}) END) AS bytes_sha256 FROM w",
))
def export_toon_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all files: the line with cut characters replaced, and the digest of its bytes."""
    return _toon_rows(V.files(spark, d)).select(F.make_valid_utf8("line").alias("line"), X.content_hash(F.col("line")).alias("bytes_sha256"))


def _toon_rows(f: DataFrame) -> DataFrame:
    f = f.select("path", P.base(F.col("path")).alias("name"), P.extension(F.col("path")).alias("extension"), C.mime_type(F.col("path")).alias("mime_type"), C.language(F.col("path")).alias("language"), "size", F.col("text").alias("summary"))
    return f.select(E.toon_line("files").alias("line"))


@query(with_(V.FILES_SQL, body="SELECT count(*) AS files, (SELECT count(DISTINCT lang) + count(DISTINCT source) FROM documents) AS tags, (SELECT count(*) FROM labels) AS chunks FROM files"))
def export_stats(spark: SparkSession, d: str) -> DataFrame:
    tags = G.label_usage(V.edges(spark, d), "tags")
    return E.stats({"files": V.files(spark, d), "tags": tags, "chunks": V.table(spark, d, "labels")}).select("files", "tags", "chunks")


@query(with_(V.FILES_SQL, body="SELECT path FROM files WHERE lang = 'de' AND (path LIKE '%.md' OR path LIKE '%.txt') ORDER BY path LIMIT 20"))
def export_filtered(spark: SparkSession, d: str) -> DataFrame:
    return E.filtered({"files": V.files(spark, d).select("path"), "edges": V.edges(spark, d)}, ["*.md", "*.txt"], ["DE"], max_files=20)["files"]


# --- streaming twin


@query("""
    WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) AS ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'delete' ELSE 'modify' END AS type,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'error'),
    f AS (SELECT path, k, ts, type AS kind, CAST(NULL AS VARCHAR) AS out_type, CAST(NULL AS BIGINT) AS out_due FROM e WHERE k = 1
          UNION ALL
          SELECT path, k, ts, CASE WHEN live IS NULL THEN type WHEN live = 'create' AND type = 'modify' THEN 'create' WHEN live = 'create' AND type = 'delete' THEN NULL WHEN live = 'delete' AND type = 'create' THEN 'modify' ELSE type END,
                 CASE WHEN over THEN before END, CASE WHEN over THEN due END
          FROM (SELECT e.path, e.k, e.ts, e.type, f.kind AS before, f.ts + d AS due, f.kind IS NOT NULL AND e.ts - f.ts >= d AS over,
                       CASE WHEN f.kind IS NOT NULL AND e.ts - f.ts >= d THEN NULL ELSE f.kind END AS live
                FROM (SELECT *, CASE WHEN kind = 'delete' THEN 28800000000 ELSE 7200000000 END AS d FROM f) f JOIN e ON e.path = f.path AND e.k = f.k + 1))
    SELECT path, out_type AS type, out_due AS due FROM f WHERE out_type IS NOT NULL
    UNION ALL SELECT path, kind, ts + CASE WHEN kind = 'delete' THEN 28800000000 ELSE 7200000000 END FROM f JOIN (SELECT path, max(k) AS k FROM e GROUP BY path) USING (path, k) WHERE kind IS NOT NULL""")
def coalesce_events(spark: SparkSession, d: str) -> DataFrame:
    hour = 3_600_000_000
    return coalesce_batch(V.changes(spark, d), 2 * hour, 8 * hour).select("path", "type", "due")


# --- chunking and providers; chunkers of single formats are in plans.formats


def _chunks(spark: SparkSession, d: str, ext: str) -> DataFrame:
    f = V.files(spark, d).where(F.col("path").endswith(ext) if ext else ~P.base(F.col("path")).contains("."))
    f = f.select("path", F.col("text").alias("content"), C.mime_type(F.col("path"), F.substring(F.col("text").cast("binary"), 1, C.PEEK)).alias("mime_type"), C.language(F.col("path")).alias("language"))
    return chunk_files(f).select("file_path", "chunker", "index", "chunk_type", "start_offset", "end_offset", "token_estimate", "content_hash")


def _chunk_query(name: str, ext: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _chunks(spark, d, ext)

    run.__name__ = name
    QUERIES[name] = run


for _name, _ext in (("chunk_markdown", ".md"), ("chunk_recursive", ".txt")):
    _chunk_query(_name, _ext)
for _format in formats.FORMATS:
    QUERIES[_format.name] = functools.partial(formats.run, _format)
    ORACLE_SQL[_format.name] = formats.oracle(_format)
QUERIES |= services.QUERIES
ORACLE_SQL |= services.ORACLE_SQL


@query()
def chunk_fallback(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("path", F.col("text").alias("content"), F.lit("application/x-unknown").alias("mime_type"), F.lit("").alias("language")).withColumn("path", F.regexp_replace("path", r"\.\w+$", ""))
    return chunk_files(f).select("file_path", "chunker", "index", "start_offset", "end_offset", "token_estimate", "content_hash")


@query()
def chunk_html(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "pages").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"), F.lit("text/html").alias("mime_type"), F.lit("").alias("language"))
    return chunk_files(p).select("file_path", "index", F.col("document.heading").alias("heading"), F.col("document.heading_level").alias("level"), F.col("document.section_path").alias("section_path"), "token_estimate", "content_hash")


@query()
def described_files(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("path", "size", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mod_time"), F.col("text").cast("binary").alias("content"))
    return described(f).drop("content")


@query()
def embed_offline(spark: SparkSession, d: str) -> DataFrame:
    return embed(V.table(spark, d, "documents"), ["doc_id"], "text", HashedEmbeddings())


@query(r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}{5,}')) AS word FROM documents),
    n AS (SELECT doc_id, lower(word) AS word, count(*) AS n FROM w GROUP BY doc_id, lower(word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k, sum(n) OVER (PARTITION BY doc_id) AS total FROM n)
    SELECT doc_id, coalesce(string_agg(word, ',' ORDER BY k) FILTER (k <= 5), '') AS tags, coalesce(string_agg(word || ' ' || n || '/' || total, ',' ORDER BY k) FILTER (k <= 3), '') AS topics,
           least(10, 1 + length(any_value(text)) // 2000) AS complexity
    FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id""")
def analyze_offline(spark: SparkSession, d: str) -> DataFrame:
    out = analyze(V.table(spark, d, "documents").withColumn("n_words", F.size(F.regexp_extract_all("text", F.lit(r"\p{L}{5,}"), F.lit(0)))), ["doc_id", "n_words"], "text", KeywordSemantics())
    share = F.transform("topics", lambda t: F.concat(t["name"], F.lit(" "), F.round(t["confidence"] * F.col("n_words")).cast("long").cast("string"), F.lit("/"), F.col("n_words").cast("string")))
    return out.select("doc_id", F.array_join("tags", ",").alias("tags"), F.array_join(share, ",").alias("topics"), F.col("complexity").cast("long").alias("complexity"))
