"""Exact length histogram of a corpus in tokens, with suffix sums.

One aggregate counts documents by encoded length; everything else is read off that histogram,
which is as long as there are distinct lengths, whatever the number of documents. Its running
sums are made in two levels, so no task reads more than a block of lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.bpe import token_counts
from corpusgraph.llm.common import BROADCAST_ROWS, Workspace

#: Lengths in one block of the running sums.
BLOCK = 1024


def length_histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): rows by length; rows of null length are left out."""
    return counted.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds to each length, for a context limit of that many tokens:

    docs_up_to (documents that fit), docs_over and tokens_over (those longer, and their tokens),
    total_tokens (of all documents) and truncated_tokens (kept if longer ones are cut at the limit).
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    sums = hist.groupBy(block.alias("block")).agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    # one row per 1024 lengths: bounded by the longest document, not by the corpus
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sums = sums.select("block", zero(F.sum("bd").over(above)).alias("docs_above"), zero(F.sum("bt").over(above)).alias("tokens_above"), F.sum("bd").over(all_rows).alias("total_docs"), F.sum("bt").over(all_rows).alias("total_tokens"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.withColumn("block", block).join(sums, "block")
    out = out.withColumn("docs_over", F.col("docs_above") + zero(F.sum("n_docs").over(inner))).withColumn("tokens_over", F.col("tokens_above") + zero(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inner)))
    return out.select(
        "n_tokens", "n_docs", (F.col("total_docs") - F.col("docs_over")).alias("docs_up_to"), "docs_over", "tokens_over", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"),
    )


def token_length_report(docs: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """The histogram of encoded lengths with its suffix sums, one row per distinct length.

    Null and empty texts count as documents of length 0. An empty table gives no rows. A limit
    between two lengths L1 < L2 keeps truncated_tokens(L1) + (limit - L1) * docs_over(L1) tokens.
    """
    work = Workspace(docs.sparkSession, "token-lengths")
    # written once: the running sums read it twice, and the texts must not be encoded twice
    hist = work.save(length_histogram(token_counts(docs.select(text_col), [], text_col, vocabulary)), "histogram")
    return with_suffix_sums(hist)


def answer(report: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """(question, argument, value): total and truncated tokens for any limits, lengths at quantiles.

    The length at quantile q is the least one that a share of at least q of the documents doesn't exceed.
    The arguments are broadcast, so there may be BROADCAST_ROWS of each at most; more raise ValueError.
    """
    spark = report.sparkSession
    if max(len(limits), len(quantiles)) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} arguments")
    asked = spark.createDataFrame([(int(x),) for x in limits] or [(0,)], "context long")
    below = report.join(F.broadcast(asked), F.col("n_tokens") <= F.col("context")).groupBy("context").agg(F.max_by(F.struct("n_tokens", "docs_over", "truncated_tokens"), "n_tokens").alias("h"))
    # a limit below every length cuts all documents
    docs_all = report.agg((F.max(F.col("docs_up_to") + F.col("docs_over"))).alias("n"))
    cut = F.broadcast(asked).join(below, "context", "left").join(F.broadcast(docs_all), how="left")
    kept = F.coalesce(F.col("h.truncated_tokens") + (F.col("context") - F.col("h.n_tokens")) * F.col("h.docs_over"), F.col("context") * F.col("n"))
    out = cut.select(F.lit("truncated_tokens").alias("question"), F.col("context").cast("double").alias("argument"), kept.alias("value")) if limits else None
    if quantiles:
        q = spark.createDataFrame([(float(x),) for x in quantiles], "q double")
        found = report.join(F.broadcast(q), F.col("quantile") >= F.col("q")).groupBy("q").agg(F.min("n_tokens").alias("value"))
        found = found.select(F.lit("length_at_quantile").alias("question"), F.col("q").alias("argument"), "value")
        out = found if out is None else out.unionByName(found)
    total = report.agg(F.max("total_tokens").alias("value")).select(F.lit("total_tokens").alias("question"), F.lit(None).cast("double").alias("argument"), "value")
    return total if out is None else out.unionByName(total)
