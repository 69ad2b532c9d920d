"""Files to graph and back out, on a small tree."""

import json

import pytest
from pyspark.sql import functions as F

from corpusgraph import schemas
from corpusgraph.operators import graph as G
from corpusgraph.operators.filters import PathConfig
from corpusgraph.plans import ingest as I
from corpusgraph.providers import HashedEmbeddings, KeywordSemantics
from corpusgraph.sources.files import walk


def empty(spark):
    out = {k: spark.createDataFrame([], schemas.schema(n)) for k, n in (("files", "FILES"), ("chunks", "CHUNKS"), ("chunk_embeddings", "CHUNK_EMBEDDINGS"), ("edges", "EDGES"), ("state", "FILE_STATE"), ("discovery", "FILE_DISCOVERY"))}
    return out


def test_ingest_search_forget(spark, tmp_path):
    (tmp_path / "a.md").write_text('# Whales\n\nwhales swim in oceans. See "b.md".\n\n# Birds\n\nbirds fly over mountains\n')
    (tmp_path / "b.md").write_text("# Stones\n\nstones are heavy\n")
    (tmp_path / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00")
    root, vectors = str(tmp_path), HashedEmbeddings(256)
    results = I.ingest(walk(spark, root, PathConfig()), KeywordSemantics(), vectors)
    frames = G.persist_files(empty(spark), results)
    frames = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in frames.items()}
    modes = {r.name: r.ingest_mode for r in frames["files"].where("ingest_mode is not null").collect()}
    assert modes == {"a.md": "chunk", "b.md": "chunk", "x.png": "semantic_only"}
    assert frames["chunks"].count() == 3 and frames["chunk_embeddings"].count() == 3
    roots = I.remember(spark.createDataFrame([], schemas.schema("REMEMBERED_PATHS")).select("path", "config_json"), root)
    hits = I.search_memory(frames, roots, vectors, "birds fly", top_k=2, include_extensions=["md"]).collect()
    assert hits[0].snippet.startswith("# Birds") and [h["rank"] for h in hits] == [1, 2]
    assert I.search_memory(frames, roots.where("false"), vectors, "birds fly").count() == 0
    body = json.loads(I.file_resource(frames, roots, f"{root}/a.md").first().json)
    assert body["chunk_count"] == 2 and "whales" in body["tags"] and body["references"] == ["b.md"]
    assert "a.md" in I.read(frames, patterns=["*.md"])
    left, roots = I.forget(frames, roots, root)
    assert left["chunks"].count() == 0 and left["files"].where(F.col("path").startswith(root)).count() == 0 and roots.count() == 0
    with pytest.raises(ValueError):
        I.remember(roots, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        I.embedded_query(vectors, " ")


def test_rebuild(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    root = str(tmp_path)
    frames = empty(spark)
    frames["state"] = spark.createDataFrame([(f"{root}/gone.md",)], "path string").select("path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in frames["state"].schema.fields[1:]])
    frames["files"] = spark.createDataFrame([(f"{root}/gone.md",), ("/other/x.md",)], "path string")
    todo, out = I.rebuild(spark, frames, {root: PathConfig(), str(tmp_path / "none"): PathConfig()})
    assert [r.path for r in todo.select("path").collect()] == [f"{root}/a.md"]
    assert [r.path for r in out["files"].collect()] == ["/other/x.md"] and out["state"].count() == 0
