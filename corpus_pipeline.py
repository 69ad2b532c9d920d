"""The corpus pipeline: documents through five filters and encoders, each written and read again.

Every stage takes rows as they come: a null, empty or white text is a row like any other, ids may
repeat or be null, equal rows are separate rows, columns beyond those of documents are passed on
whatever their names, and an empty table stays empty. Rows are told apart by their place in the
table, never by doc_id, so a decision on one row touches no other.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.bpe import encoding_digests
from corpusgraph.llm.common import ROW_KEY, Workspace, join_small, scratch, with_row_key
from corpusgraph.llm.decontaminate import find_overlaps
from corpusgraph.llm.near_dup import duplicate_rows
from corpusgraph.llm.quality import quality
from corpusgraph.llm.secrets import redact
from corpusgraph.session import bound_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage with bounded batches, also where it is run alone and not by the named query."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def without(docs: DataFrame, gone: DataFrame, work: Workspace, columns: list[str]) -> DataFrame:
    """docs less the rows of the given keys. Only where these are too many to broadcast do texts move."""
    gone = work.save(gone.select(*ROW_KEY), "gone")
    return join_small(docs, gone, ROW_KEY, "left_anti", gone.count()).select(*[F.col(f"`{c}`") for c in columns])


@bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: among them null, empty and white texts. Equal rows
    have one verdict."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    judged = quality(docs.select(row, F.col("text").alias("__text"), F.col("lang").alias("__language")), ["__row"], "__text", "__language")
    return judged.where("kept").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


@bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest doc_id, an id before none,
    and of equal rows the first. Null, empty and white texts are like no other, so all of them stay."""
    work = Workspace(spark, "near-dedup")
    keyed = with_row_key(docs, work)
    return without(keyed, duplicate_rows(keyed, ROW_KEY), work, docs.columns)


@bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; proximity matches alone are no reason. Texts
    without words, null ones among them, stay. Without benchmark items all stay."""
    work = Workspace(spark, "decontamination")
    keyed = with_row_key(docs, work)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_overlaps(keyed, benchmark, ROW_KEY, matched_only=True).where(F.size("runs") > 0)
    return without(keyed, found, work, docs.columns)


@bounded
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that are no widely copied examples are masked; n_chars follows the new text. Null texts
    stay null, with null n_chars, and all rows stay."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


@bounded
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document and the digests of its ids and of the decoded text; a null
    text is empty. Every row gives one."""
    return encoding_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Tokenisers and hash minima are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again,
    and what its stage and the one before left there is deleted."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch():
            docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
