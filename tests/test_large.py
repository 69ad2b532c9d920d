"""Queries on tables of shapes that the supplied ones don't have."""

import tracemalloc

import duckdb
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from corpusgraph.operators.chunking.base import Options, Part, Source, finish
from corpusgraph.operators.chunking.udf import chunk_files
from corpusgraph.plans import formats, registry
from corpusgraph.sources import files as W


@pytest.mark.parametrize("name", ["walk_tree", "walk_changed_files"])
def test_walks_read_all_of_many_and_of_long_documents(spark, tmp_path, monkeypatch, name):
    most = 32 << 10
    monkeypatch.setattr(W, "LARGEST_READ", most)
    monkeypatch.setattr(W.with_content, "__defaults__", (most,))
    rows = [(k, ("xé " * (k % 60)) + str(k), ("en", "de", "fr")[k % 7 % 3]) for k in range(3000)] + [(k, "long " * (k % 6000), "en") for k in range(4000, 4010)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(registry.QUERIES[name](spark, str(tmp_path)), duck, registry.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """A folder with a part table of 12,000 rows in one small file."""
    path = str(tmp_path_factory.mktemp("parts"))
    copies = spark.read.parquet(f"{sf}/part.parquet").crossJoin(spark.range(60)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 200).drop("id")
    copies.coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", [f.name for f in formats.FORMATS])
def test_chunking_of_a_small_table_is_dealt_out(spark, parts, name):
    assert registry.QUERIES[name](spark, parts).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("name", ["chunk_html_files", "chunk_fallback_files"])
def test_dealt_chunks_agree_with_sql(spark, parts, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{parts}/part.parquet/*.parquet'")
    same_rows(registry.QUERIES[name](spark, parts), duck, registry.ORACLE_SQL[name])


def test_only_the_columns_asked_for_are_made(spark):
    files = spark.createDataFrame([("/a.md", "# A\né", "", "")], "path string, content string, mime_type string, language string")
    every = chunk_files(files)
    some = chunk_files(files, columns=["content_hash", "document", "end_offset"])
    assert some.columns == [c for c in every.columns if c in ("content_hash", "document", "end_offset")]
    assert some.collect() == every.select(*some.columns).collect()


def test_offsets_of_a_large_text_need_no_table_of_its_characters():
    text = "é漢x\n" * 300_000
    source = Source(text.encode())
    parts = [Part(4, 8), Part(0, 4), Part(len(text) - 4, len(text))]
    tracemalloc.start()
    chunks = finish(source, parts, Options())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(c.start_offset, c.end_offset) for c in chunks] == [(7, 14), (0, 7), (2_099_993, 2_100_000)]
    assert peak < 12 * len(text)
