"""Walks, listings, vectors, hashes and registries against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text as X
from corpusgraph.functions.vectors import cosine, mean_vectors
from corpusgraph.operators import export as E
from corpusgraph.operators.chunking import REGISTRY, Options, Source
from corpusgraph.operators.chunking import code as C
from corpusgraph.operators.chunking.log import level_of, log_format, time_of
from corpusgraph.operators.filters import PathConfig
from corpusgraph.plans import ingest as I
from corpusgraph.sources import files as W


def test_walks_open_only_what_passes(spark, tmp_path):
    (tmp_path / "a[1]*.md").write_text("odd name")
    (tmp_path / "b c.md").write_text("x" * 50)
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "no.md").write_text("no")
    (tmp_path / "locked.log").write_text("unread")
    config = PathConfig(skip_directories=["skip"], skip_extensions=["log"])
    rows = {r.path.rsplit("/", 1)[1]: r for r in W.walk(spark, str(tmp_path), config).collect()}
    assert {k: bytes(r.content) for k, r in rows.items()} == {"a[1]*.md": b"odd name", "b c.md": b"x" * 50}
    large = {r.path.rsplit("/", 1)[1]: r.content for r in W.with_content(spark, W.listed(spark, str(tmp_path), config), most=20).collect()}
    assert large["b c.md"] is None and large["a[1]*.md"] is not None
    described = {r.name: r.ingest_mode for r in W.described(W.with_content(spark, W.listed(spark, str(tmp_path), config), most=20)).collect()}
    assert set(described) == {"a[1]*.md", "b c.md"}
    both = W.walk_all(spark, {str(tmp_path): config, str(tmp_path / "skip"): PathConfig()})
    assert both.count() == 3
    assert W.walk_all(spark, {}).count() == 0


def test_means_of_vectors(spark):
    rng = random.Random(1)
    rows = [(k % 7, [rng.random() for _ in range(rng.choice([3, 3, 5]))]) for k in range(400)] + [(8, None), (9, []), (None, [1.0])]
    got = {r.k: r.v for r in mean_vectors(spark.createDataFrame(rows, "k int, v array<double>").repartition(5), "k", "v").collect()}
    for key in range(7):
        own = [v for k, v in rows if k == key]
        want = [sum(v[i] for v in own if len(v) > i) / sum(len(v) > i for v in own) for i in range(max(map(len, own)))]
        assert got[key] == pytest.approx(want)
    assert 8 not in got and got[9] == [] and got[None] == [1.0]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "k int, v array<double>")
    got = {r.k: r.c for r in df.select("k", cosine(F.col("v"), [3.0, 4.0]).alias("c")).collect()}
    assert got == {1: pytest.approx(1.0), 2: None, 3: None, 4: None}


def test_metadata_hash_against_the_rule(spark):
    def rule(text):
        h = 0
        for b in text.encode():
            h = (h * 31 + b) % 2**64
        return f"{h:016x}"

    texts = ["", "a", "/x/é.md|12|99", "z" * 5000, "", "|"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    assert [r.h for r in rows.select("k", X.metadata_hash("t").alias("h")).orderBy("k").collect()] == [rule(t) for t in [*texts, ""]]


def test_tags_of_a_filter_are_compared_in_ascii_case(spark):
    edges = spark.createDataFrame([("/a", "HAS_TAG", "À x"), ("/b", "HAS_TAG", "à x"), ("/c", "HAS_TAG", "plain")], "src_key string, rel string, dst_key string")
    files = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    found = lambda *tags: sorted(r.path for r in E.filtered({"files": files, "edges": edges}, tags=list(tags))["files"].collect())
    assert found("À X") == ["/a"] and found("PLAIN") == ["/c"]


def test_languages_can_be_added():
    def shouting(text):
        at = text.index("DEF")
        return [(at, len(text), {"language": "loud", "function_name": text[at:].split()[1]})]

    C.register_language("loud", shouting, "text/x-loud", ".loud")
    name, chunks, _ = REGISTRY.chunk(Source(b"head\nDEF f body", path="/a.loud"), Options())
    assert name == "code" and [c.meta["code"].get("function_name") for c in chunks] == [None, "f"]
    C.register_language("braced", C.Language(r"fun\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)", r"type\s+(?P<name>\w+)"), suffixes=".brc")
    assert REGISTRY.chunk(Source(b"fun g(a) { x }\n", path="/a.brc"), Options())[1][0].meta["code"]["function_name"] == "g"


def test_lines_of_logs():
    assert log_format('{"level": "warn", "text": "{"}') == "json" and log_format('{"level": 3}') == "custom" and log_format("{broken") == "custom"
    assert log_format('h - - [15/Jan/2024:10:00:00 +0000] "GET / HTTP/1.1" 200 1') == "apache" and log_format('h - [x] "GET" 200') == "custom"
    assert log_format('h - - [x] "GET /" 200 5\nupstream timed out') == "nginx"
    assert log_format("Jan  5 10:00:00 host app: text") == "syslog" and log_format("Foo 15 10:00:00 host app: text") == "custom"
    assert log_format("2024-01-15 10:00:00,123 text") == "structured" and log_format("2024-01-15 10:00:00 - text") == "custom"
    assert level_of('{"log_level": " notice "}') == "NOTICE" and level_of('{"a": {"level": "x"}}') == "INFO"
    assert time_of('{"@timestamp": "2024-01-15T10:00:00Z"}').hour == 10 and time_of("none") is None


def test_periodic_runs(spark, tmp_path):
    import time

    seen = []
    q = I.rebuild_periodically(spark, lambda: seen.append(1), "1 second", str(tmp_path / "cp"))
    try:
        began = time.time()
        while len(seen) < 2 and time.time() - began < 60:
            time.sleep(0.2)
    finally:
        q.stop()
    assert len(seen) >= 2


def test_released_frames(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext")
    out = I.ingest(W.walk(spark, str(tmp_path)))
    assert out["chunks"].count() == 1 and all(df.is_cached for df in out.held)
    out.release()
    assert not any(df.is_cached for df in out.held)


def test_signed_sums_of_vectors_are_exact(spark):
    rows = [(1, [float(x)]) for x in np.arange(1000)]
    assert mean_vectors(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v").first().v == [499.5]
