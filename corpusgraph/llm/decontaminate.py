"""Benchmark decontamination over a stored, distributed positional inverted index.

Building: one pass over the training texts writes the index in segments. A segment holds the
postings of all tokens of a block of texts: its terms in order, how often each occurs, and the
positions of each. Segments are partitioned by document, so the postings of a frequent term are
spread over all of them and no task ever holds a term's whole list.

Searching: the index tells how often each benchmark term occurs in the corpus, and so the order
of each window's terms from the rarest on. In a segment, the positions of the rarest term, less
its offset in the window, give the alignments; the lists of the next rarer terms are intersected
with them after the same adjustment. What is left after all terms is an exact phrase match; with
a tolerance on each offset it is a proximity match. Texts are read once, whatever the number of
windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, _parse_datatype_string

from corpusgraph.llm import words as w
from corpusgraph.llm.common import BROADCAST_ROWS, LONG_ROWS, Workspace, join_small, map_text, packed, row_blocks, unpacked, utf8_parts

RANGE = pa.struct([("a", pa.int64()), ("b", pa.int64())])
MATCHES = "runs array<struct<a:long,b:long>>, items array<string>, n_near long, near_runs array<struct<a:long,b:long>>, near_items array<string>"


# --- the index


def segment_postings(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, positions): distinct terms in order, and the positions of each, in order."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[first].view(np.int64), np.diff(np.concatenate([first, [len(ranked)]])).astype(np.int32), order.astype(np.int32)


def build_index(docs: DataFrame, keep: list[str], text_col: str, work: Workspace, most: int = 1 << 20) -> DataFrame:
    """Writes and returns the segments: segment, docs (kept columns and number of words of each
    text), terms, counts and positions (of all words, as packed 32-bit numbers)."""
    own = docs.select(packed(keep), F.col(text_col).alias("__text"))
    kept = own.schema["__keep"]
    docs_type = ArrayType(StructType([StructField("keep", kept.dataType), StructField("n_words", LongType())]))
    schema = StructType([StructField("segment", LongType()), StructField("docs", docs_type), *_parse_datatype_string("terms array<long>, counts array<int>, positions binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            for a, b in row_blocks(offsets, most):
                text, ends = w.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                starts, stops, at = w.bounds(text, ends, w.ALNUM)
                terms, counts, positions = segment_postings(w.span_hashes(text, starts, stops))
                rows = pa.StructArray.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at))], ["keep", "n_words"])
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([pa.array([segment]), one(rows), one(pa.array(terms)), one(pa.array(counts)), pa.array([positions.tobytes()], pa.binary())], names=["segment", "docs", "terms", "counts", "positions"])
                segment += 1

    return work.save(own.mapInArrow(run, schema), "index", **LONG_ROWS)


def term_counts(index: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, n): the corpus-wide occurrences of the given terms; one row a term and segment is summed."""
    own = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    return join_small(own, terms, "term", "left_semi", n_terms).groupBy("term").agg(F.sum("n").alias("n"))


# --- the benchmark


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, terms) of each distinct window: an item's runs of `size` words, or all its words if fewer."""

    def work(data, offsets, _):
        data = w.LOWER[data]
        starts, ends, at = w.bounds(data, offsets, w.ALNUM)
        h = w.span_hashes(data, starts, ends).view(np.int64)
        out = []
        for r in range(len(offsets) - 1):
            own = h[at[r] : at[r + 1]]
            n = min(size, len(own))
            out.append([own[k : k + n].tolist() for k in range(len(own) - n + 1)] if n else [])
        return {"windows": pa.array(out, pa.list_(pa.list_(pa.int64())))}

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    every = map_text(items, "text", ["item"], "windows array<array<long>>", work)
    return every.select("item", F.explode("windows").alias("terms")).where("item is not null").distinct()


def ranked_windows(windows: DataFrame, index: DataFrame, work: Workspace) -> DataFrame:
    """(item, terms, freqs) of the windows whose terms all occur, with the corpus-wide count of each term."""
    each = windows.select("terms").distinct().select("terms", F.posexplode("terms").alias("at", "term"))
    terms = work.save(each.select("term").distinct(), "terms")
    counts = work.save(term_counts(index, terms, terms.count()), "counts")
    freqs = join_small(each, counts, "term", "left", counts.count()).groupBy("terms").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("f"))
    freqs = freqs.select("terms", F.transform("f", lambda x: x["n"]).alias("freqs")).where(F.array_min("freqs") > 0)
    return work.save(windows.join(freqs, "terms").select("item", "terms", "freqs"), "windows")


class Queries:
    """Some windows of the benchmark, laid out for matching: each with its terms from the rarest on."""

    def __init__(self, rows: list[tuple[str, list[int], list[int]]]):
        windows = {tuple(t): f for _, t, f in rows}
        terms = sorted(windows)
        number = {t: k for k, t in enumerate(terms)}
        self.vocabulary = np.unique(np.array([x for t in terms for x in t], np.int64).view(np.uint64)) if terms else np.zeros(0, np.uint64)
        size = max(map(len, terms), default=1)
        self.lengths = np.array([len(t) for t in terms], np.int64)
        padded = np.array([list(t) + [t[0]] * (size - len(t)) for t in terms], np.int64).view(np.uint64).reshape(len(terms), size)
        self.terms = np.searchsorted(self.vocabulary, padded).astype(np.int64)
        # places beyond a shorter window's end stand last and are never looked at
        freq = np.array([list(windows[t]) + [1 << 62] * (size - len(t)) for t in terms], np.int64).reshape(len(terms), size)
        self.rarest_first = np.argsort(freq, axis=1, kind="stable")
        items = sorted({i for i, _, _ in rows})
        self.items = pa.array(items, pa.string())
        place = {i: k for k, i in enumerate(items)}
        pairs = np.array(sorted((number[tuple(t)], place[i]) for i, t, _ in rows), np.int64).reshape(-1, 2)
        self.item_of = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))


# --- the search


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices first[k] to first[k] + n[k] - 1 of all k, one after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class Segment:
    """The postings of the benchmark's terms in one segment."""

    def __init__(self, q: Queries, n_words: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slack: int):
        # a gap between texts, so that no match runs over a text's end
        self.gap = gap = q.terms.shape[1] + 2 * slack + 1
        self.first = np.concatenate([[0], np.cumsum(n_words)])[:-1] + np.arange(len(n_words)) * gap
        ends = np.cumsum(n_words)
        terms = terms.view(np.uint64)
        k = np.searchsorted(terms, q.vocabulary)
        k[k == len(terms)] = 0
        mine = terms[k] == q.vocabulary if len(terms) else np.zeros(len(k), bool)
        self.n = np.where(mine, counts[k] if len(terms) else 0, 0).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        at = positions[spread(starts[k[mine]], self.n[mine])].astype(np.int64)
        self.span = int(ends[-1]) + (len(n_words) + 1) * gap if len(n_words) else 1
        self.postings = np.repeat(np.arange(len(k)), self.n) * self.span + at + np.searchsorted(ends, at, "right") * gap
        self.starts = np.concatenate([[0], np.cumsum(self.n)])

    def row_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def near(self, term: np.ndarray, place: np.ndarray, slack: int) -> np.ndarray:
        """Whether each term has a posting within slack of the place."""
        k = np.searchsorted(self.postings, term * self.span + np.maximum(place - slack, 0))
        k = np.minimum(k, len(self.postings) - 1)
        found = self.postings[k] - term * self.span
        return (found >= np.maximum(place - slack, 0)) & (found <= np.minimum(place + slack, self.span - 1))

    def match(self, q: Queries, slack: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, start, row, exact) of every proximity match, exact matches among them."""
        if not len(self.postings):
            return
        have = np.where(np.arange(q.terms.shape[1])[None, :] < q.lengths[:, None], self.n[q.terms], 1)
        alive = np.flatnonzero(have.min(axis=1) > 0)
        first = q.rarest_first[alive, 0]
        lead = q.terms[alive, first]
        n = self.n[lead]
        # whole posting lists, as many windows at a time as give about `most` alignments
        total = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < len(alive):
            b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
            at = self.postings[spread(self.starts[lead[a:b]], n[a:b])] % self.span
            window, row = np.repeat(alive[a:b], n[a:b]), self.row_of(at)
            start = at - np.repeat(first[a:b], n[a:b])
            exact = np.ones(len(start), bool)
            a = b
            for step in range(1, q.terms.shape[1]):
                offset = q.rarest_first[window, step]
                used = q.lengths[window] > step
                hit = ~used | self.near(q.terms[window, offset], start + offset, slack)
                window, start, row, exact, offset, used = window[hit], start[hit], row[hit], exact[hit], offset[hit], used[hit]
                if not len(window):
                    break
                exact &= ~used | self.near(q.terms[window, offset], start + offset, 0)
            yield window, start, row, exact

    def extent(self, q: Queries, window: np.ndarray, start: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """From the first to behind the last place of any term of each match within slack of its own."""
        first, last = np.full(len(window), self.span), np.full(len(window), -1)
        for k in range(q.terms.shape[1]):
            own = np.flatnonzero(q.lengths[window] > k)
            term, at = q.terms[window[own], k] * self.span, start[own] + k
            a = self.postings[np.searchsorted(self.postings, term + np.maximum(at - slack, 0))] - term
            b = self.postings[np.searchsorted(self.postings, term + np.minimum(at + slack, self.span - 1), "right") - 1] - term
            first[own], last[own] = np.minimum(first[own], a), np.maximum(last[own], b)
        return first, last + 1


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges joined where they overlap or meet."""
    order = np.lexsort((stop, start))
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[new], reach[np.concatenate([new[1:], [len(start)]]) - 1] if len(new) else reach


def search_segment(segment: Segment, q: Queries, slack: int) -> dict[str, pa.Array]:
    """row and MATCHES of the segment's texts that have a match."""
    found = [x for x in segment.match(q, slack) if len(x[0])]
    none = np.zeros(0, np.int64)
    window, start, row, exact = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, none.astype(bool))
    n_windows = len(q.lengths) + 1
    pair = row * n_windows + window
    hits = np.unique(pair[exact])
    # proximity: the texts and windows that have no exact match there
    only = ~np.isin(pair, hits)
    near = np.unique(pair[only])
    rows = np.unique(np.concatenate([hits, near]) // n_windows)

    def ranges(a: np.ndarray, b: np.ndarray) -> pa.Array:
        a, b = merged(a, b)
        own = segment.row_of(a)
        at = np.concatenate([np.searchsorted(own, rows), [len(own)]]).astype(np.int32)
        return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(a - segment.first[own]), pa.array(b - segment.first[own])], ["a", "b"]))

    def items(pairs: np.ndarray) -> pa.Array:
        k = pairs % n_windows
        many = q.item_at[k + 1] - q.item_at[k]
        own = np.unique(np.repeat(pairs // n_windows, many) * (len(q.items) + 1) + q.item_of[spread(q.item_at[k], many)])
        at = np.concatenate([np.searchsorted(own // (len(q.items) + 1), rows), [len(own)]]).astype(np.int32)
        return pa.ListArray.from_arrays(at, q.items.take(pa.array(own % (len(q.items) + 1))))

    n_near = np.diff(np.concatenate([np.searchsorted(near // n_windows, rows), [len(near)]]))
    return {
        "row": pa.array(rows), "runs": ranges(start[exact], start[exact] + q.lengths[window[exact]]), "items": items(hits),
        "n_near": pa.array(n_near.astype(np.int64)), "near_runs": ranges(*segment.extent(q, window[only], start[only], slack)), "near_items": items(near),
    }


FOUND = f"segment long, row long, {MATCHES}"
READ = ["segment", "n_words", "terms", "counts", "positions"]


def _search_rows(table: pa.Table | pa.RecordBatch, q: Queries, slack: int) -> Iterator[pa.RecordBatch]:
    """The matches in each segment of a table with READ columns."""
    for k in range(len(table)):
        values = lambda c: table.column(c)[k].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
        segment = Segment(q, values("n_words"), values("terms"), values("counts"), np.frombuffer(table.column("positions")[k].as_buffer(), np.int32), slack)
        got = search_segment(segment, q, slack)
        yield pa.RecordBatch.from_arrays([pa.array([table.column("segment")[k].as_py()] * len(got["row"]), pa.int64()), *got.values()], names=["segment", *got])


def search_index(index: DataFrame, windows: DataFrame, slack: int, slice_windows: int, work: Workspace) -> DataFrame:
    """FOUND: the texts with matches, by segment and row.

    Up to slice_windows windows go to all tasks. More are dealt into slices of about so many, and a
    slice meets a segment only if the segment has the rarest term of one of its windows.
    """
    spark = index.sparkSession
    postings = index.select("segment", F.transform("docs", lambda d: d["n_words"]).alias("n_words"), "terms", "counts", "positions")
    n = windows.count()
    if n <= slice_windows:
        shared = spark.sparkContext.broadcast(Queries([tuple(r) for r in windows.toLocalIterator()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _search_rows(batch, shared.value, slack)

        return postings.mapInArrow(run, FOUND)
    rarest = F.array_min(F.zip_with("freqs", "terms", lambda f, t: F.struct(f.alias("f"), t.alias("t"))))["t"]
    dealt = windows.select("item", "terms", "freqs", rarest.alias("term"), F.pmod(F.xxhash64("terms"), F.lit(-(-n // slice_windows))).alias("slice"))
    meets = index.select("segment", F.explode("terms").alias("term")).join(dealt, "term").select("segment", "slice", "item", "terms", "freqs")
    meets = work.save(meets, "meets")
    segments = postings.join(meets.select("segment", "slice").distinct(), "segment").select(F.col("segment").alias("own"), F.col("slice").alias("part"), *READ)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        q = Queries(list(zip(*(right.column(c).to_pylist() for c in ("item", "terms", "freqs")), strict=True)))
        return pa.Table.from_batches(_search_rows(left, q, slack))

    found = segments.groupBy("own", "part").cogroup(meets.groupBy("segment", "slice")).applyInArrow(both, FOUND)
    runs = [F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "near_runs")]
    items = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
    # a text has as many rows here as slices found something in it
    out = found.groupBy("segment", "row").agg(*runs, *items, F.sum("n_near").alias("n_near"))
    return out.select("segment", "row", joined_ranges(F.col("runs")).alias("runs"), "items", "n_near", joined_ranges(F.col("near_runs")).alias("near_runs"), "near_items")


def joined_ranges(ranges: Column) -> Column:
    """The ranges joined where they overlap or meet."""
    kind = "array<struct<a:long,b:long>>"

    def step(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))))
        return F.when((F.size(out) > 0) & (r["a"] <= F.try_element_at(out, F.lit(-1))["b"]), longer).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), step)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, slack: int = 2, slice_windows: int = BROADCAST_ROWS, matched_only: bool = False) -> DataFrame:
    """keep columns, n_words, runs (word ranges covered by benchmark windows), items, n_near, near_runs and near_items per row.

    A window is `size` consecutive words of an item, or all of a shorter item's. items lists the
    items with a window in the text, as strings, and near_items those of proximity matches; n_near
    counts the windows that occur only nearly: there is a place of the window's rarest word (of
    equally rare ones the first) from which every other word is within `slack` places of its own,
    but nowhere in the text are all in place. near_runs go from the first to the last word within
    slack of its place. With matched_only, texts without any match are left out.

    Null and empty texts have no words; items with no words or null id match nothing; items that
    repeat count once. Rows of docs that repeat are returned as often. Empty tables give no rows, or
    no matches. A kept column named like a returned one is left out.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    index = build_index(docs, keep, text_col, work)
    windows = ranked_windows(work.save(item_windows(benchmark, item_col, item_text_col, size), "items"), index, work)
    found = work.save(search_index(index, windows, slack, slice_windows, work), "found")
    own = index.select("segment", F.posexplode("docs").alias("row", "d")).select("segment", F.col("row").cast("long").alias("row"), F.col("d.keep").alias("__keep"), F.col("d.n_words").alias("n_words"))
    own = work.save(own, "rows")
    work.drop("index", "items", "terms", "counts", "windows", "meets")
    out = join_small(own, found, ["segment", "row"], "inner" if matched_only else "left", found.count())
    empty = lambda c: F.coalesce(c, F.array()).alias(c)
    return out.select(*unpacked(keep, ["n_words", "runs", "items", "n_near", "near_runs", "near_items"]), "n_words", empty("runs"), empty("items"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), empty("near_runs"), empty("near_items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words under runs), n_items, items_sha256, contaminated, and the
    proximity matches: n_near, near_items and near_runs (a:b of word numbers), comma-joined (see find_overlaps)."""
    found = find_overlaps(docs.select(F.col(id_col).alias("doc_id"), F.col(options.get("text_col", "text")).alias("text")), benchmark, ["doc_id"], **options | {"text_col": "text"})
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    spans = F.transform("near_runs", lambda r: F.concat_ws(":", r["a"].cast("string"), r["b"].cast("string")))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), "n_near", F.array_join(F.array_sort("near_items"), ",").alias("near_items"), F.array_join(spans, ",").alias("near_runs"),
    )
