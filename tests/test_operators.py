"""Operators on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from corpusgraph import schemas
from corpusgraph.functions import paths as P
from corpusgraph.functions import text as X
from corpusgraph.operators import cache as K
from corpusgraph.operators import export as E
from corpusgraph.operators import filters as L
from corpusgraph.operators import graph as G
from corpusgraph.operators import search as S
from corpusgraph.operators import state as T
from corpusgraph.providers import HashedEmbeddings, KeywordSemantics, RateLimiter, analyze, embed, retried
from corpusgraph.sources import files as W
from corpusgraph.sources.store import Store
from corpusgraph.streaming.coalesce import fold, merged


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").orderBy("k").select(f(F.col("v"))).collect()]


def test_schemas_parse(spark):
    assert {"code", "log"} <= set(schemas.schema("CHUNKS").names)
    for name in ("FILES", "CHUNK_EMBEDDINGS", "DIRECTORIES", "TAGS", "TOPICS", "ENTITIES", "EDGES", "REMEMBERED_PATHS", "FILE_STATE", "FILE_DISCOVERY", "CRITICAL_EVENTS", "PERSISTENCE_QUEUE"):
        assert schemas.schema(name).names


def test_paths(spark):
    assert column(spark, ["/a/b.TXT", "/.bashrc", "x", "/a/"], P.extension) == [".txt", ".bashrc", "", ""]
    assert column(spark, ["/a/b", "/a", "a"], P.directory) == ["/a", "/", "."]
    assert column(spark, ["/a/b", "/a", "/ab"], lambda c: P.under(c, "/a/")) == [True, True, False]
    assert column(spark, ["/a", "b"], lambda c: P.under(c, "/")) == [True, False]
    assert column(spark, ["a.go", "a.got", "x/a.go", "b1.c"], lambda c: P.glob("*.go", c)) == [True, False, False, False]
    assert column(spark, ["b1.c", "bx.c"], lambda c: P.glob("b[0-9]*", c)) == [True, False]
    assert column(spark, ["a?c", "abc"], lambda c: P.glob("a?c", c)) == [True, False]
    assert column(spark, ["/x/y"], P.ancestors) == [["/", "/x", "/x/y"]]
    assert column(spark, ["a.swp", "4913", "#x#", "x~", "x.go", "a4913"], P.editor_noise) == [True, True, True, True, False, False]
    with pytest.raises(ValueError):
        P.extension_set([""])


def test_text(spark):
    assert column(spark, ["ÀB", None], X.normal_name) == ["Àb", None]
    assert column(spark, ["abcdef", "abc"], lambda c: X.truncated(c, 5)) == ["ab...", "abc"]
    assert column(spark, ["a|b\nc\r"], X.escaped_row) == ["a\\|b\\nc"]
    assert column(spark, ["text/x-go", "image/png", "odd"], X.short_mime) == ["go", "png", "odd"]
    assert column(spark, [" a\u00a0\n b "], X.compact) == ["a b"]
    assert column(spark, ["x" * 50], lambda c: X.condensed(c, 5)) == ["x" * 14 + X.CUT + "x" * 6]
    assert column(spark, ["sha256:abcdef", "ab"], X.cache_path) == ["ab/cd/abcdef", "ab"]
    assert column(spark, ['{"level":"alert"}', "SEVERE x"], X.log_level) == ["FATAL", "ERROR"]
    assert column(spark, [1, 2, 4], lambda c: X.backoff(F.lit(1.0), c), "int") == [1.0, 2.0, 8.0]


def test_filters(spark):
    c = L.PathConfig(skip_extensions=["log"], include_extensions=["go"], skip_directories=["node*"])
    assert column(spark, ["/r/a.go", "/r/a.txt", "/r/.h.go", "/r/node_x/a.go", "/q/a.go"], lambda p: L.path_passes(p, "/r", c)) == [True, False, True, False, False]
    p = L.patched(L.PathConfig(skip_files=["A"]), {"skip_hidden": False}, {"skip_files": ["a", "b"]})
    assert p.skip_files == ["A", "b"] and not p.skip_hidden
    with pytest.raises(ValueError):
        L.score_at_least(F.lit(1.0), "1.5")


def frames(spark):
    files = spark.createDataFrame([("/a/1.md", "chunk"), ("/a/b/2.md", "chunk"), ("/c/3.md", "chunk")], "path string, ingest_mode string")
    chunks = spark.createDataFrame([("c1", "/a/1.md", 0), ("c2", "/a/b/2.md", 0), ("c3", "/c/3.md", 0)], "id string, file_path string, index int")
    vectors = spark.createDataFrame([("c1", "p", "m"), ("c3", "p", "m")], "chunk_id string, provider string, model string")
    return {"files": files, "chunks": chunks, "chunk_embeddings": vectors, "edges": G.contains_edges(files).unionByName(G.has_chunk_edges(chunks))}


def keys(df, c):
    return sorted(r[c] for r in df.collect())


def test_deletes_cascade(spark):
    out = G.delete_subtree(frames(spark), "/a")
    assert keys(out["files"], "path") == ["/c/3.md"] and keys(out["chunks"], "id") == ["c3"] and keys(out["chunk_embeddings"], "chunk_id") == ["c3"]
    assert {r.dst_key for r in out["edges"].collect()} == {"/c/3.md", "c3"}
    assert keys(G.delete_file(frames(spark), "/c/3.md")["chunks"], "id") == ["c1", "c2"]


def test_persist_replaces_what_a_file_had(spark):
    old = frames(spark)
    old["edges"] = G.set_labels(old["edges"], spark.createDataFrame([("/a/1.md", "x")], "path string, name string"), "tags")
    results = {
        "files": spark.createDataFrame([("/a/1.md", "chunk"), ("/c/3.md", "skip"), ("/n.md", "chunk")], "path string, ingest_mode string"),
        "chunks": spark.createDataFrame([("n1", "/n.md", 0)], "id string, file_path string, index int"),
        "chunk_embeddings": spark.createDataFrame([], "chunk_id string, provider string, model string"),
        "tags": spark.createDataFrame([("/n.md", "New")], "path string, name string"),
        "topics": spark.createDataFrame([("/n.md", "T", 0.5)], "path string, name string, confidence double"),
        "entities": spark.createDataFrame([("/n.md", "E", "org")], "path string, name string, type string"),
        "references": spark.createDataFrame([("/n.md", "/stub.md", "file"), ("/n.md", "http://x", "url")], "path string, target string, type string"),
    }
    out = G.persist_files(old, results)
    assert keys(out["files"], "path") == ["/a/1.md", "/a/b/2.md", "/n.md", "/stub.md"]
    assert keys(out["chunks"], "id") == ["c2", "n1"] and out["chunk_embeddings"].count() == 0
    assert [r.key for r in G.label_usage(out["edges"], "tags").collect()] == ["new"]
    r = G.file_relations(out["files"], out["edges"]).where("path = '/n.md'").first()
    assert r.tags == ["new"] and r.topics[0].confidence == 0.5 and r.entities[0].name == "e" and r.references == ["/stub.md"] and r.chunk_count == 1


def test_upsert_takes_the_latest(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in G.upsert(old, new, ["k"], "t").collect()) == [(1, "c"), (2, "d")]


def test_roots(spark):
    roots = spark.createDataFrame([("/projects", None), ("/projects/my_app", None)], "path string, config_json string")
    f = spark.createDataFrame([("/projects/my_app/x",), ("/projects/myXapp/x",), ("/projects",), ("/q/x",)], "path string")
    got = {r.path: r.root for r in T.deepest_root(f, roots).collect()}
    assert got == {"/projects/my_app/x": "/projects/my_app", "/projects/myXapp/x": "/projects", "/projects": "/projects", "/q/x": None}
    assert T.deepest_root(f, spark.createDataFrame([("/",)], "path string")).where("root = '/'").count() == 4
    with pytest.raises(T.PathExists):
        T.add_root(roots, "/projects/")
    with pytest.raises(T.PathNotFound):
        T.remove_root(roots, "/none")
    assert T.add_root(roots, "/new").count() == 3 and T.remove_root(roots, "/projects").count() == 1


def test_stale_paths_leave_roots_alone_that_list_nothing(spark):
    known = spark.createDataFrame([("/a/1",), ("/a/2",), ("/b/1",)], "path string")
    seen = spark.createDataFrame([("/a/1",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/b",)], "path string")
    got = T.stale_paths(known, known.where("path != '/b/1'"), seen, roots).collect()
    assert [(r.path, r.in_state, r.in_discovery) for r in got] == [("/a/2", True, True)]


def test_queue_life(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    q = spark.createDataFrame([], schemas.PERSISTENCE_QUEUE)
    q = T.enqueue(q, spark.createDataFrame([("/a", "h", "{}"), ("/b", "h", "{}")], "file_path string, content_hash string, result_json string"), now)
    batch, q = T.dequeue(q, 1, now)
    assert batch.count() == 1 and {r.status for r in q.collect()} == {"inflight", "pending"}
    first = batch.first().id
    q = spark.createDataFrame(q.collect(), q.schema)
    for n in range(3):
        q = T.finish(q, spark.createDataFrame([(first, "x")], "id long, error string"), now)
        assert q.where(F.col("id") == first).first().status == ("failed" if n == 2 else "pending")
    s = T.queue_stats(q).first()
    assert (s.pending, s.failed, s.total) == (1, 1, 2)
    assert T.purge(q, F.lit("2024-01-09 00:00:00").cast("timestamp")).count() == 1
    again = T.enqueue(q, spark.createDataFrame([(q.where(F.col("id") == first).first().file_path, "h", "{}")], "file_path string, content_hash string, result_json string"), now)
    assert again.where("status = 'pending'").count() == 2


def test_state_stages(spark):
    state = spark.createDataFrame([("/a", "h1"), ("/b", "h1")], "path string, content_hash string").select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("metadata_hash", "string"), ("size", "long"), ("mod_time", "timestamp"), ("metadata_analyzed_at", "timestamp"), ("semantic_analyzed_at", "timestamp"), ("semantic_error", "string"), ("semantic_retry_count", "int"), ("embeddings_analyzed_at", "timestamp"), ("embeddings_error", "string"), ("embeddings_retry_count", "int"))])
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    s = T.record_stage(state, spark.createDataFrame([("/a", None), ("/b", "x")], "path string, error string"), "semantic", now)
    assert {r.path: (r.semantic_analyzed_at is not None, r.semantic_error, r.semantic_retry_count) for r in s.collect()} == {"/a": (True, None, 0), "/b": (False, "x", 1)}
    s = T.record_metadata(s, spark.createDataFrame([("/a", "h2", "m", 1), ("/c", "h", "m", 1)], "path string, content_hash string, metadata_hash string, size long").withColumn("mod_time", now), now)
    assert s.count() == 3 and s.where("path = '/a'").first().semantic_analyzed_at is None
    assert T.clear_analysis(s, F.lit(True)).where("semantic_error is not null").count() == 0


def test_search_modes(spark):
    v = spark.createDataFrame([(f"c{k}", f"/p/{k}.{'md' if k % 2 else 'go'}", [1.0, k / 10]) for k in range(10)], "chunk_id string, file_path string, embedding array<float>")
    q = S.Query([1.0, 0.0], top_k=3, include_extensions=["MD"], min_score=0.5)
    got = S.search(v, q).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c1", "c3", "c5"] and [r["rank"] for r in got] == [1, 2, 3]
    assert S.search(v, q, mode="compat", candidates=2).count() == 1
    assert S.candidate_k(3, True) == 100 and S.candidate_k(80, True) == 500 and S.candidate_k(7, False) == 7
    with pytest.raises(ValueError):
        S.top_k(v, [])


def test_export(spark):
    fr = {
        "files": spark.createDataFrame([("/a.md", "a.md", ".md", "text/markdown", "", 3, "s|x\ny"), ("/b.go", "b.go", ".go", "text/x-go", "go", 5, None)], "path string, name string, extension string, mime_type string, language string, size long, summary string"),
        "directories": spark.createDataFrame([("/", "", False, 2)], "path string, name string, is_remembered boolean, file_count long"),
        "tags": spark.createDataFrame([("t", 2)], "name string, usage_count long"),
        "chunks": spark.range(4), "edges": spark.range(5),
    }
    text = E.render(fr)
    assert text.splitlines() == ["@kg v=1 t=1970-01-01T00:00:00Z", "#f", "/a.md|a.md|.md|md||3|s\\|x\\ny", "/b.go|b.go|.go|go|go|5|", "#d", "/||0|2", "#t", "t|2", "@stats f=2 d=1 c=4 t=1 p=0 e=0 r=5"]
    assert json.loads(E.render(fr, "json", patterns=["*.md"]))["files"][0]["path"] == "/a.md"
    assert "<file><path>/a.md</path>" in E.render(fr, "xml", max_files=1)
    assert json.loads(E.render(fr, wrap="session-hook"))["hookSpecificOutput"]["additionalContext"] == text
    with pytest.raises(ValueError):
        E.render(fr, max_files=-1)
    with pytest.raises(KeyError):
        E.render(fr, "none-such")


def test_cache(spark):
    c = spark.createDataFrame([("h", 0, 1, "p", "m", [1.0], 1), ("i", 0, 1, "p", "m", [1.0], 2)], "content_hash string, chunk_index int, version int, provider string, model string, embedding array<float>, dimensions int")
    want = c.select(*K.EMBEDDING_KEY)
    hits, misses = K.lookup(want, c, K.EMBEDDING_KEY, K.usable(F.col("embedding"), F.col("dimensions")))
    assert (hits.count(), misses.count()) == (1, 1)
    assert K.store(c, c.limit(1), K.EMBEDDING_KEY).count() == 2 and K.clear(c).count() == 0
    assert K.decode_vector(K.encode_vector([1.0, -2.5])) == [1.0, -2.5]
    with pytest.raises(ValueError):
        K.decode_vector(K.encode_vector([1.0])[:-1])


def test_walk_and_store(spark, tmp_path):
    for name, body in (("a.md", "# A"), ("sub/b.go", "package b"), ("node_x/c.go", "x"), (".hidden", "x"), ("d.log", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    c = L.PathConfig(skip_extensions=["log"], skip_directories=["node*"])
    found = W.described(W.walk(spark, str(tmp_path), c))
    assert sorted(r.name for r in found.collect()) == ["a.md", "b.go"]
    state = found.select("path", "size", "mod_time", F.current_timestamp().alias("semantic_analyzed_at"))
    (tmp_path / "new.md").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in W.walk_changed(spark, str(tmp_path), state, c).collect()] == ["new.md"]
    assert W.root_health(str(tmp_path)) == "ok" and W.healthy_roots([str(tmp_path), str(tmp_path / "no")])[1] == [str(tmp_path / "no")]
    store = Store(spark, str(tmp_path / "store"))
    store.write("t", spark.range(3), "id")
    assert store.write("t", spark.range(5), "id") == 2 and store.read("t").count() == 5 and store.read("t", 1).count() == 3
    store.write("t", spark.range(7))
    assert store.versions("t") == [2, 3]


def test_providers(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, None)], "id int, text string")
    got = {r.id: r for r in embed(df, ["id"], "text", HashedEmbeddings(8)).collect()}
    assert len(got[1].embedding) == 8 and sum(x * x for x in got[1].embedding) == pytest.approx(1, 1e-5)

    class Failing(HashedEmbeddings):
        def embed_batch(self, texts):
            raise RuntimeError("down")

    assert {r.error for r in embed(df, ["id"], "text", Failing(8), retries=0).collect()} == {"down"}
    assert {r.id: r.tags for r in analyze(df, ["id"], "text", KeywordSemantics()).collect()}[1] == ["alpha"]
    slept, now = [], [0.0]
    limit = RateLimiter(60, 1, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    limit.wait()
    limit.wait()
    assert slept == [1.0]
    calls = []
    assert retried(lambda: calls.append(1) or (1 / (len(calls) - 2) if len(calls) < 3 else 7), sleep=lambda s: None) in (7, -1.0)


def test_merge_table_and_fold():
    assert [merged(a, b) for a, b in (("create", "modify"), ("create", "delete"), ("modify", "delete"), ("delete", "create"), ("modify", "modify"), ("delete", "modify"))] == ["create", None, "delete", "modify", "modify", "modify"]
    assert fold([(0, "create"), (1, "modify"), (2, "delete")], 5, 50) == ([], (None, 2))
    assert fold([(0, "modify"), (10, "delete"), (40, "create")], 5, 50) == ([("modify", 5)], ("modify", 40))
    assert fold([(0, "delete"), (60, "create")], 5, 50) == ([("delete", 50)], ("create", 60))
