"""Secret scanning with corpus-wide ownership frequency.

One pass finds candidates in every whole text. Each distinct candidate value (by its hash) is
then counted over the corpus by distinct owners and repositories: a value that many owners hold
is a widely copied example, one that stays with an owner or two looks like a live credential.
Candidates of the weaker kind, random-looking tokens without a keyword, are taken for secrets
only if they look live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import ROW_KEY, Workspace, join_small, map_text, packed, strings, unpacked, with_row_key

#: The base kinds in the order that breaks ties of the start, and their patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the method: long runs of mixed characters.
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
KEYWORDS = ("pass", "secret", "token", "key")

SPAN = "array<struct<start:long,kind:int,stop:long,value:string>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, in order; value is what identifies the secret.

    Runs of a single character class are greedy and whole, so a least length in the pattern and
    a test of the whole run find the same; an assignment is tested after its match, as a short
    value still uses up its text.
    """
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(out)


def bits_per_char(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def random_spans(text: str, base: list[tuple[int, int, int, str]], least_bits: float) -> list[tuple[int, int, int, str]]:
    """Runs with upper and lower case and digits, of high entropy, that no base span touches."""
    out, k = [], 0
    for m in RANDOM.finditer(text):
        a, b, v = m.start(), m.end(), m.group()
        while k < len(base) and base[k][2] <= a:
            k += 1
        if any(s < b and e > a for s, _, e, _ in base[k : k + 4]):
            continue
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and bits_per_char(v) >= least_bits:
            out.append((a, 3, b, v))
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")


def candidates(docs: DataFrame, keep: list[str], text_col: str, least_bits: float = 3.5) -> DataFrame:
    """keep columns, base_sha256, base and more (arrays of spans) of each row; null is empty."""

    def work(data, offsets, _):
        shas, base, more = [], [], []
        struct = lambda spans: [{"start": s, "kind": k, "stop": e, "value": hashlib.sha256(v.encode()).hexdigest()} for s, k, e, v in spans]
        for text in strings(data, offsets):
            found = base_spans(text)
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found).encode()).hexdigest())
            base.append(struct(found))
            more.append(struct(random_spans(text, found, least_bits)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("value", pa.string())]))
        return {"base_sha256": shas, "base": pa.array(base, kind), "more": pa.array(more, kind)}

    return map_text(docs, text_col, keep, f"base_sha256 string, base {SPAN}, more {SPAN}", work)


def parts_of(source: Column) -> tuple[Column, Column]:
    """(owner, repository) of a source name: `owner/repository`, with a host or scheme before it left
    out. A name of one part has no owner to tell apart from the repository, so both are that name."""
    path = F.regexp_replace(source, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/|/+$|\.git$", "")
    owner = F.regexp_extract(path, r"^([^/]+)/[^/]", 1)
    return F.when(owner != "", owner).otherwise(path), path


def ownership(found: DataFrame, owner_col: str, repo_col: str) -> DataFrame:
    """(value, n_owners, n_repos, n_uses): in how many owners' and repositories' texts a value stands.

    Repeats within a repository are folded before the shuffle; the value is counted from distinct
    (value, owner, repository) rows, so a value in a third of all texts is no hot key.
    """
    each = found.select(F.explode(F.concat("base", "more")).alias("s"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"))
    by_repo = each.groupBy(F.col("s.value").alias("value"), "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("uses").alias("n_uses"))


JUDGED = "array<struct<start:long,kind:int,stop:long,value:string,live:boolean,example:boolean,n_owners:long,n_repos:long>>"


def scan_secrets(docs: DataFrame, keep: list[str], text_col: str = "text", source_col: str = "source", owner: Column | None = None, repo: Column | None = None, live_owners: int = 2, example_owners: int = 4, example_repos: int = 8, least_bits: float = 3.5) -> DataFrame:
    """keep columns, base_sha256 and spans (start, kind, stop, value, live, example, n_owners, n_repos) of each row.

    A value held by at most live_owners distinct owners, in fewer than example_repos distinct
    repositories, looks live; one held by example_owners owners or in example_repos repositories or
    more is a widely copied example; what lies between is neither. Owner and repository are given
    as Columns or else read off source_col (see parts_of). All base spans are returned;
    random-looking tokens only if live. Null texts are empty, a null owner or repository is one of
    its own, and rows that repeat are returned as often. An empty table gives no rows. A kept
    column named like a returned one is left out.
    """
    work = Workspace(docs.sparkSession, "secrets")
    if owner is None or repo is None:
        own_owner, own_repo = parts_of(F.col(source_col))
        owner, repo = own_owner if owner is None else owner, own_repo if repo is None else repo
    own = docs.select(packed(keep), F.col(text_col).alias("__t"), owner.alias("__owner"), repo.alias("__repo"))
    found = candidates(own, ["__keep", "__owner", "__repo"], "__t", least_bits)
    # narrow and written once: both the counts and the spans come from it, and row ids stay fixed
    found = work.save(found.withColumn("__row", F.monotonically_increasing_id()), "found")
    freq = work.save(ownership(found, "__owner", "__repo"), "ownership")
    spans = found.where("size(base) + size(more) > 0").select("__row", F.explode(F.concat("base", "more")).alias("s")).select("__row", "s.*")
    judged = join_small(spans, freq, "value", "inner", freq.count())
    wide = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    judged = judged.withColumn("example", wide).withColumn("live", (F.col("n_owners") <= live_owners) & ~wide).where("kind < 3 or live")
    # a row's own spans only: as many as its text holds
    per_row = judged.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "value", "live", "example", "n_owners", "n_repos"))).alias("spans"))
    out = found.select("__row", "__keep", "base_sha256").join(per_row, "__row", "left")
    return out.select(*unpacked(keep, ["base_sha256", "spans"]), "base_sha256", F.coalesce("spans", F.array().cast(JUDGED)).alias("spans"))


def secret_digests(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, n_live, n_example, and the most
    owners and repositories (most_owners, most_repos) of any of the row's values; 0 if there is none."""
    found = scan_secrets(docs, [id_col], **options)
    many = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: many(lambda s: s.kind == k)
    most = lambda c: F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0).cast("long"))
    return found.select(
        F.col(id_col).alias("doc_id"), *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], "base_sha256", joined(F.col("spans")).alias("spans"),
        many(lambda s: s.live).alias("n_live"), many(lambda s: s.example).alias("n_example"), most("n_owners").alias("most_owners"), most("n_repos").alias("most_repos"),
    )


def mask_spans(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with the sorted spans (start, stop in code points) replaced; overlapping ones become one mark."""
    out, at = [], 0
    for start, stop in spans:
        if stop <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = stop
    return "".join([*out, text[at:]])


def masked(text: Column, spans: Column, mark: str) -> Column:
    """mask_spans of the rows that have spans; the others' texts don't go to Python."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), starts.to_pylist(), stops.to_pylist(), strict=True)
        return pa.array([None if t is None else mask_spans(t, list(zip(a, b, strict=True)), mark) for t, a, b in rows], pa.string())

    own = F.when(spans.isNotNull(), text)
    return F.coalesce(run(own, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["stop"])), text)


def redact(docs: DataFrame, text_col: str = "text", source_col: str = "source", mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every secret that is no widely copied example replaced by `mark`.

    Overlapping spans become one mark. Texts without such spans stay as they are, null included;
    rows that repeat are returned as often, and an empty table gives no rows. All columns of docs
    are returned, whatever their names. Texts without such spans aren't moved where the spans to
    hide are few; else the spans meet their texts in a sort-merge join by row.
    """
    work = Workspace(docs.sparkSession, "redact")
    columns = docs.columns
    keyed = with_row_key(docs, work)
    found = scan_secrets(keyed, ROW_KEY, text_col, source_col, **options)
    hidden = found.select(*ROW_KEY, F.filter("spans", lambda s: ~s.example).alias("__hidden")).where("size(__hidden) > 0")
    hidden = work.save(hidden.select(*ROW_KEY, F.transform("__hidden", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias("__hidden")), "hidden")
    out = join_small(keyed, hidden, ROW_KEY, "left", hidden.count())
    text = masked(F.col(f"`{text_col}`"), F.col("__hidden"), mark)
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])
