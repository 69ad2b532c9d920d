"""MinHash near-duplicate detection with exact confirmation.

1. One scan of the texts: word shingles, their distinct count, a 128-bit digest of the set, and
   `bands` x `rows` universal hash minima, kept as one key per band. Texts with equal sets are
   one class from here on, so a group of copies costs one row of band keys.
2. Buckets are the band keys that two or more classes share. Buckets with equal members are
   looked at once. Each bucket links its members to a representative: as many pairs as members.
3. The sets of the classes in buckets are computed again from their texts, and each pair is
   confirmed on the full sets. Confirmed links give components (large-star, small-star).
4. A bucket whose members lie in several components may hide links that its representative
   did not show. All members outside its largest component are compared with all members of
   other components, in blocks of bounded size, so no candidate link is lost and no group meets
   in one task. Only links that join two components of a block leave it.
5. Buckets that would take more than a fixed number of blocks are first split by prefixes: of two sets that are similar
   enough, the smaller has one of its rarest shingles among the rarest of the larger. Members
   meet only where such a shingle is shared, so texts on one template, which share the common
   part and little else, are not compared with each other. A set in many such buckets is split once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import words as w
from corpusgraph.llm.common import BROADCAST_ROWS, Workspace, join_small, map_text, packed, unpacked
from corpusgraph.llm.components import connected_components

U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): the sorted distinct shingle hashes of each row's lower-cased words.

    A row of fewer words than a shingle has its whole sequence as one; a row without words none.
    """
    data = w.LOWER[data]
    starts, ends, at = w.bounds(data, offsets, w.SPACED)
    h = w.span_hashes(data, starts, ends)
    windows = w.window_hashes(h, size)
    parts, lens = [], np.zeros(len(offsets), np.int64)
    for r in range(len(offsets) - 1):
        a, b = at[r], at[r + 1]
        if b - a >= size:
            s = np.sort(windows[a : b - size + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
        elif b > a:
            s = w.sequence_hash(h[a:b])[None]
        else:
            continue
        parts.append(s)
        lens[r + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(lens)


def digests(sets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """128-bit digests of the sets as an (n, 2) array; 0 for an empty set."""
    out = np.zeros((len(rows) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(rows))
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(2):
                out[full, k] = w.mix(np.add.reduceat(w.mix(sets ^ w.ORDER[40 + k]), rows[full]) + np.diff(rows)[full].astype(np.uint64))
    return out


def band_keys(sets: np.ndarray, rows: np.ndarray, bands: int, per_band: int, seed: int) -> np.ndarray:
    """(n, bands) keys: each hashes `per_band` minima of universal hashes a * x + b."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 1 << 63, bands * per_band, dtype=np.uint64) * U(2) + U(1)
    b = draw.integers(0, 1 << 63, bands * per_band, dtype=np.uint64) * U(2) + U(1)
    full = np.flatnonzero(np.diff(rows))
    keys = np.zeros((len(rows) - 1, bands), np.uint64)
    if not len(full):
        return keys
    at, hashed = rows[full], np.empty_like(sets)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(full), U(band + 1))
            for k in range(band * per_band, (band + 1) * per_band):
                np.multiply(sets, a[k], out=hashed)
                np.add(hashed, b[k], out=hashed)
                key = w.mix(key * w.ORDER[45] + (np.minimum.reduceat(hashed, at) >> U(16)))
            keys[full, band] = key
    return keys


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, per_band: int, seed: int, keep: list[str]) -> DataFrame:
    """doc_id, __keep, n_shingles, set_id (binary digest) and bands (array of long) of each document."""

    def work(data, offsets, _):
        sets, rows = shingle_sets(data, offsets, shingle)
        keys = band_keys(sets, rows, bands, per_band, seed).view(np.int64)
        flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.reshape(-1))
        return {"n_shingles": np.diff(rows), "set_id": _binary(digests(sets, rows)), "bands": flat}

    # band hashing passes over a block's shingles many times, so blocks stay small
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), packed(keep), F.col(text_col).alias("text"))
    return map_text(own, "text", ["doc_id", "__keep"], "n_shingles long, set_id binary, bands array<long>", work, 1 << 19)


def full_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, n_wanted: int, shingle: int) -> DataFrame:
    """(set_id, shingles) of the classes in `wanted` (set_id, doc_id of one document, which may be null)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    found = texts.join(F.broadcast(ids) if n_wanted <= BROADCAST_ROWS else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def work(data, offsets, _):
        sets, rows = shingle_sets(data, offsets, shingle)
        return {"set_id": _binary(digests(sets, rows)), "shingles": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(rows * 8), pa.py_buffer(sets.tobytes())]).cast(pa.binary())}

    every = map_text(found, "text", [], "set_id binary, shingles binary", work)
    # a repeated doc_id may bring other texts along; equal sets are equal bytes
    return join_small(every, wanted.select("set_id"), "set_id", "left_semi", n_wanted).groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


#: Pairs of one set that meet its shingles in one place.
HUB_PAIRS = 256


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """The pairs (u, v) of set ids whose full sets are similar enough.

    A set with many pairs, such as the representative of a large bucket, is copied once for every
    HUB_PAIRS of them, and its pairs are dealt over the copies.
    """
    hubs = work.save(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("parts")).where("parts > 1"), "hubs")
    n_hubs = hubs.count()
    parts = F.coalesce("parts", F.lit(1))
    left = join_small(sets.select(F.col("set_id").alias("u"), F.col("shingles").alias("a")), hubs, "u", "left", n_hubs).select("u", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "a")
    right = sets.select(F.col("set_id").alias("v"), F.col("shingles").alias("b"))
    dealt = join_small(pairs, hubs, "u", "left", n_hubs).select("u", "v", F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            held = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(held, pa.bool_()))

    return dealt.join(right, "v").join(left, ["u", "part"]).select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def block_links(left_ids: list, left: list[np.ndarray], left_comp: list, right_ids: list, right: list[np.ndarray], right_comp: list, percent: int) -> list[tuple]:
    """Links between the two sides of a block that join components not joined in it before.

    Overlaps of one set with all sets of the other side come from one posting list of the block.
    """
    values = np.concatenate(right) if right else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(x) for x in right])
    up: dict = {}

    def find(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for i, a in enumerate(left):
        lo, hi = np.searchsorted(values, a, "left"), np.searchsorted(values, a, "right")
        n = hi - lo
        if not n.sum():
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        for j in np.flatnonzero((both > 0) & (100 * both >= percent * (len(a) + sizes - both))):
            x, y = find(left_comp[i]), find(right_comp[j])
            if x != y:
                up[x] = y
                out.append((left_ids[i], right_ids[j]))
    return out


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's n shingles can hold the first common one with a set that is similar enough:
    with any smaller or equal set, and with any larger or equal one."""
    smaller = -(-percent * n // 100)
    larger = -(-2 * percent * n // (100 + percent))
    return n - smaller + 1, n - larger + 1


def shingle_counts(sets: DataFrame, cells: int) -> np.ndarray:
    """How many sets have a shingle of each of `cells` hash cells: a fixed-size order from rare to common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) % U(cells)).astype(np.int64), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(cells, np.int64)
    for r in sets.select("shingles").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.cell] = r.n
    return out


def by_prefixes(members: DataFrame, sets: DataFrame, percent: int, cells: int, work: Workspace) -> DataFrame:
    """members (set_id, comp, n_shingles) of large buckets with the keys at which they meet, one for each
    shingle of their longer prefix; `first` is whether it is in the shorter one, as it must be for one
    of every pair. A set in many large buckets stands here once."""
    own = work.save(join_small(sets, members.select("set_id"), "set_id", "left_semi", members.count()), "large")
    counts = members.sparkSession.sparkContext.broadcast(shingle_counts(own, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, flags, at = [], [], []
            for k, x in enumerate(batch.column(3)):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                probe, index = prefix_sizes(len(s), percent)
                order = np.lexsort((s, counts.value[(s % U(cells)).astype(np.int64)]))[:probe]
                keys.append(s[order].view(np.int64))
                flags.append(np.arange(probe) < index)
                at.append(np.full(probe, k))
            if at:
                out = batch.take(pa.array(np.concatenate(at)))
                yield pa.record_batch([pa.array(np.concatenate(keys)), *(out.column(k) for k in range(3)), pa.array(np.concatenate(flags))], ["key", "set_id", "comp", "n_shingles", "first"])

    return members.join(own, "set_id").select("set_id", "comp", "n_shingles", "shingles").mapInArrow(run, "key long, set_id binary, comp binary, n_shingles long, first boolean")


def residual_links(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, block_shingles: int, block_rows: int, most_blocks: int, cells: int, work: Workspace) -> DataFrame | None:
    """Links between components inside the buckets: (u, v), or None if no bucket has two components."""

    def split(placed: DataFrame) -> DataFrame:
        sizes = placed.groupBy("key", "comp").agg(F.sum("n_shingles").alias("s"), F.count(F.lit(1)).alias("c"), F.max("first").alias("first"))
        # the most shingles in one component, ties by its id; the rest of the bucket is compared with all of it
        many = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max_by(F.struct("comp", "s", "c"), F.struct("s", "comp")).alias("major"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.max("first").alias("first"))
        blocks = lambda s, c: F.ceil(F.greatest(s / block_shingles, c / block_rows)).cast("int")
        return many.where("k > 1 and first").select("key", F.col("major.comp").alias("major"), blocks(F.col("s"), F.col("c")).alias("mb"), blocks(F.col("s") - F.col("major.s"), F.col("c") - F.col("major.c")).alias("rb"))

    placed = members.where("n > 2").join(comps, F.col("set_id") == F.col("node"), "left").select("key", "set_id", F.coalesce("root", "set_id").alias("comp"), "n_shingles", F.lit(True).alias("first"))
    placed = work.save(placed, "placed")
    parts = work.save(split(placed), "split")
    n_parts = parts.count()
    if not n_parts:
        return None
    shared = join_small(placed, parts, "key", "inner", n_parts)
    large = parts.where(F.col("mb") * F.col("rb") > most_blocks)
    if n_large := large.count():
        crowd = join_small(placed, large, "key", "left_semi", n_large).select("set_id", "comp", "n_shingles").distinct()
        finer = work.save(by_prefixes(work.save(crowd, "crowd"), sets, percent, cells, work), "finer")
        finer_parts = work.save(split(finer), "finer-split")
        shared = shared.where(F.col("mb") * F.col("rb") <= most_blocks).unionByName(join_small(finer, finer_parts, "key", "inner", finer_parts.count()))
    salt = F.xxhash64("set_id", "key")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = shared.select("key", "set_id", "comp", "first", F.pmod(salt, F.col("mb")).cast("int").alias("mblock"), blocks("rb").alias("rblock"), F.lit(False).alias("rest"))
    left = shared.where("comp != major").select("key", "set_id", "comp", "first", blocks("mb").alias("mblock"), F.pmod(salt, F.col("rb")).cast("int").alias("rblock"), F.lit(True).alias("rest"))
    dealt = left.unionByName(right).join(sets, "set_id")

    def run(table: pa.Table) -> pa.Table:
        ids, comp, rest = table.column("set_id").to_pylist(), table.column("comp").to_pylist(), table.column("rest").to_pylist()
        first = table.column("first").to_pylist()
        got = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        pick = lambda xs, of: [xs[i] for i in of]
        found = []
        a, b = [i for i, x in enumerate(rest) if x], [i for i, x in enumerate(rest) if not x]
        own = [i for i in a if first[i]], [i for i in a if not first[i]]
        # of each pair one at least meets here in its shorter prefix
        for x, y in ((own[0], b), (own[1], [i for i in b if first[i]])):
            if x and y:
                found += block_links(pick(ids, x), pick(got, x), pick(comp, x), pick(ids, y), pick(got, y), pick(comp, y), percent)
        return pa.table({"u": pa.array([x for x, _ in found], pa.binary()), "v": pa.array([y for _, y in found], pa.binary())})

    return dealt.select("key", "mblock", "rblock", "set_id", "comp", "first", "rest", "shingles").groupBy("key", "mblock", "rblock").applyInArrow(run, "u binary, v binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, shingle: int = 5, percent: int = 80, bands: int = 32, per_band: int = 4, seed: int = 7, block_shingles: int = 400_000, block_rows: int = 1000, most_blocks: int = 64, cells: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and component for each row of docs, with `keep` columns.

    Two texts are linked if 100 * intersection >= percent * union of their distinct word-shingle
    sets. With 32 bands of 4 minima a pair of similarity 0.8 shares no band with probability
    (1 - 0.8 ** 4) ** 32 = 5e-8. component_id is the smallest doc_id reachable over links, itself
    included; kept says whether that is the row's own doc_id; component names the component itself
    (null for a text that is like no other).

    Shingles are compared by 64-bit hashes and equal sets by 128-bit digests of them; see
    words.span_hashes for their chance of a clash, the only way to link unequal texts.

    Null and empty texts, and texts of white space, have n_shingles 0 and are linked with nothing.
    Rows that repeat are returned as often; rows of one doc_id with other texts are separate
    documents. A null doc_id takes part in links; it is never the smallest id, and a component of
    null ids only has component_id null and kept null. An empty table gives no rows. Other columns
    are ignored; a kept one named like a returned one is left out.
    """
    keep = keep or []
    work = Workspace(docs.sparkSession, "near-dup")
    signed = work.save(signatures(docs, id_col, text_col, shingle, bands, per_band, seed, keep), "signed")
    plain = signed.select("doc_id", "__keep", "n_shingles", "set_id")
    classes = work.save(signed.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("set_id", "n_shingles", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("key"), "set_id", "n_shingles")
    # a bucket's representative is drawn anew for each key, so that bands vary it
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("who"), F.min_by("set_id", F.xxhash64("set_id", "key")).alias("rep")).where("n > 1")
    buckets = work.save(shared.groupBy("n", "who").agg(F.min_by(F.struct("key", "rep"), "key").alias("b")).select("b.key", "b.rep", "n"), "buckets")
    members = work.save(join_small(keyed, buckets, "key", "inner", buckets.count()), "members")
    # from the representative: a set is at the far end of a pair at most once a band
    stars = work.save(members.where("rep != set_id").select(F.col("rep").alias("u"), F.col("set_id").alias("v")).distinct(), "stars")
    ids = members.select("set_id").distinct()
    wanted = work.save(classes.select("set_id", "doc_id").join(ids, "set_id", "left_semi"), "wanted")
    sets = work.save(full_sets(docs, id_col, text_col, wanted, wanted.count(), shingle), "sets")
    links = work.save(confirm(stars, sets, percent, work), "links")
    comps = work.save(connected_components(links, work, "first"), "comps")
    more = residual_links(members, comps, sets, percent, block_shingles, block_rows, most_blocks, cells, work)
    if more is not None:
        more = work.save(more, "more")
        chain = comps.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        comps = work.save(connected_components(chain.unionByName(more), work, "second"), "comps2")
    # a component's smallest doc_id, over classes; singles with one copy need no row
    named = classes.select("set_id", "doc_id", "copies").join(comps, F.col("set_id") == F.col("node"), "left")
    named = named.where("copies > 1 or root is not null").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = work.save(named.join(least, "root").select("set_id", F.col("root").alias("component"), "component_id"), "named")
    work.drop("members", "sets", "stars", "hubs", "placed", "split", "large", "crowd", "finer", "finer-split", "links", "comps", "comps2", "more", "wanted", "buckets", "classes")
    out = join_small(plain, named, "set_id", "left", named.count())
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    own = ["doc_id", "n_shingles", "component_id", "kept", "component"]
    return out.select(*unpacked(keep, own), "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "component")


def duplicate_rows(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The `keep` columns of all rows but one of each component: of the least doc_id, then the least
    `keep` values; a row with an id comes before one without. keep must tell rows apart. Rows that
    repeat are near duplicates of each other; rows of one doc_id go only if their own text is in a
    component with another."""
    found = near_duplicates(docs, id_col, text_col, keep, **options).where("component is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keep)
    best = found.groupBy("component").agg(F.min(rank).alias("best"))
    return found.join(best, "component").where(~rank.eqNullSafe(F.col("best"))).select(*keep)
