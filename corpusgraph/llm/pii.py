"""Personal data by patterns and by bootstrapped contexts, in DataFrame operations only.

The base kinds are found by regular expressions. They are the seeds of a bootstrap: the word
before a seed is a lexical pattern of its kind. Patterns and the identifier-like strings that
follow them form a graph, scored in rounds: a pattern is as good as the share of its instances
that are known to be of its kind, and an unseen instance as good as the best pattern that it
follows. What a confident pattern has found counts for the other patterns that it follows, so
these can become confident without seeds of their own. Strings after patterns of high confidence
are then found as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import Workspace, join_small, packed, unpacked

#: The base kinds in the order that breaks ties of the start. Look-behinds and
#: possessive runs leave what is matched as it is and keep the search linear in long runs: an
#: address can only start where its run of characters does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind, so it isn't searched.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
KINDS = tuple(PATTERNS)
#: Identifier-like strings, which a context can make personal data: words of six characters or more
#: with a digit; groups of digits, the first perhaps in brackets; names with an at sign or `at`
#: in brackets. They start where a run of such characters does, so the search is linear.
CANDIDATE = (
    r"(?<![A-Za-z0-9._/@-])(?:"
    r"\(?+[0-9]{2,5}+\)?+(?:[\x20./-][0-9]{2,5}+){2,6}+(?![A-Za-z0-9])"
    r"|\([0-9]{2,5}\)\x20?[0-9]{3,}+(?:[\x20./-][0-9]{2,5}+)*+(?![A-Za-z0-9])"
    r"|[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{2,}+(?:\.[A-Za-z0-9-]++)*+"
    r"|(?=[A-Za-z._/-]{0,64}[0-9])[A-Za-z0-9][A-Za-z0-9._/-]{4,}(?<=[A-Za-z0-9])(?![A-Za-z0-9@]))"
)
#: A longer word before a match is no lexical pattern.
LONGEST_PATTERN = 64
#: Elements of one block of a running sum.
BLOCK = 128
SPAN = "array<struct<start:long,kind:int,stop:long,value:string,before:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, grow: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array of non-negative longs under a sum or maximum.

    A fold that appends copies what it has at each step; in two levels, of blocks and in blocks,
    the copies of an array of any supplied length stay few.
    """
    none = F.array().cast("array<long>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    fold = lambda a: F.aggregate(a, none, lambda out, x: F.concat(out, F.array(grow(last(out), x))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

        def joined_blocks(own: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("long")), fold(F.transform(own, last)))
            return F.flatten(F.zip_with(own, F.slice(before, 1, F.size(own)), lambda b, o: F.transform(b, lambda x: grow(x, o))))

        return F.when(F.size(v) > 0, let(blocks, joined_blocks)).otherwise(none)

    return let(values, whole)


def last_word(text: Column) -> Column:
    """The last word of a stretch of text in lower case, without what stands around it; '' if none."""
    word = F.lower(F.reverse(F.regexp_extract(F.reverse(text), r"^[^\p{L}\p{N}:=]*+([:=]?+[\p{L}\p{N}]++)", 1)))
    return F.when(F.char_length(word) <= LONGEST_PATTERN, word).otherwise(F.lit(""))


def matches(text: Column, pattern: str, kind: int, needs: str) -> Column:
    """All matches as sorted spans: the gaps between them give their places in code points."""
    length = lambda s: F.char_length(s).cast("long")

    def spans(both: Column) -> Column:
        found = both["m"]
        gaps = F.slice(both["g"], 1, F.size(found))
        stops = running(F.zip_with(gaps, found, lambda g, m: length(g) + length(m)), lambda a, b: a + b)
        placed = F.zip_with(stops, found, lambda s, m: F.struct(s.alias("stop"), m.alias("value")))
        return F.zip_with(placed, gaps, lambda p, g: F.struct((p["stop"] - length(p["value"])).alias("start"), F.lit(kind).alias("kind"), p["stop"].alias("stop"), p["value"].alias("value"), last_word(g).alias("before")))

    both = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(text.rlike(needs), let(both, spans)).otherwise(F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test: every second digit from the right is doubled."""
    n = F.char_length(digits)
    digit = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.char_length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of all base kinds by start, then kind; failing matches are dropped, not retried."""
    each = lambda n, k: F.filter(matches(text, PATTERNS[k], n, NEEDS[k]), lambda s: holds(k, s["value"]))
    return F.array_sort(F.concat(*[each(n, k) for n, k in enumerate(KINDS)]))


def candidate_spans(text: Column) -> Column:
    return matches(text, CANDIDATE, len(KINDS), r"[0-9@]|[\[(]at[\])]")


def apart(more: Column, base: Column) -> Column:
    """The spans of `more` that no span of `base` touches.

    Both are laid out by place, a candidate at its last character; it is touched if any base span
    that starts before there reaches beyond the candidate's start.
    """
    zero = F.lit(0).cast("long")
    nothing = F.lit(None).cast(SPAN.removeprefix("array<").removesuffix(">"))
    placed = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("side"), b["stop"].alias("stop"), nothing.alias("c"))),
        F.transform(more, lambda c: F.struct((c["stop"] - 1).alias("at"), F.lit(1).alias("side"), zero.alias("stop"), c.alias("c"))),
    )

    def clear(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["stop"]), F.greatest)
        both = F.zip_with(events, reach, lambda e, r: F.struct(e["c"].alias("c"), r.alias("r")))
        return F.transform(F.filter(both, lambda x: x["c"].isNotNull() & (x["r"] <= x["c"]["start"])), lambda x: x["c"])

    return F.when(F.size(more) > 0, let(F.array_sort(placed), clear)).otherwise(more)


def pattern_graph(found: DataFrame, work: Workspace) -> DataFrame:
    """(pattern, instance, kind): the distinct edges; kind is null for candidates."""
    each = lambda c: found.select(F.explode(c).alias("s")).where("s.before != ''")
    seeds = each("base").select(F.col("s.before").alias("pattern"), F.xxhash64("s.value").alias("instance"), F.col("s.kind").alias("kind"))
    others = each("more").select(F.col("s.before").alias("pattern"), F.xxhash64("s.value").alias("instance"), F.lit(None).cast("int").alias("kind"))
    return work.save(seeds.unionByName(others).distinct(), "graph")


def bootstrap(graph: DataFrame, work: Workspace, rounds: int, least_seeds: int, confidence: float) -> DataFrame:
    """(pattern, kind, score): the patterns of high confidence after some rounds.

    A pattern's score for a kind is the sum of its instances' scores over their number plus one;
    seeds score 1, and any other instance the best score of a pattern that it follows and that was
    confident in the round before. A pattern is confident with a score of `confidence` or more
    and least_seeds instances that have a score for the kind.
    """
    edges = work.save(graph.select("pattern", "instance").distinct(), "edges")
    size = work.save(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "sizes")
    seeds = work.save(graph.where("kind is not null").select("instance", "kind").distinct().withColumn("s", F.lit(1.0)), "seeds")
    known, sure = seeds, None
    for k in range(rounds + 1):
        support = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("s").alias("gain"), F.count(F.lit(1)).alias("known"))
        scored = support.where(F.col("known") >= least_seeds).join(size, "pattern").select("pattern", "kind", (F.col("gain") / (F.col("n") + 1)).alias("score"))
        sure = work.save(scored.where(F.col("score") >= confidence), f"sure-{k}")
        if k < rounds:
            best = join_small(edges, sure, "pattern", "inner", sure.count()).select("instance", "kind", F.col("score").alias("s"))
            known = work.save(seeds.unionByName(best).groupBy("instance", "kind").agg(F.max("s").alias("s")), f"known-{k}")
    # one kind for each pattern
    out = work.save(sure.groupBy("pattern").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score")), "good")
    work.drop("graph", "edges", "sizes", "seeds", *(f"{t}-{k}" for t in ("sure", "known") for k in range(rounds + 1)))
    return out


def find_personal_data(docs: DataFrame, keep: list[str], text_col: str = "text", rounds: int = 3, least_seeds: int = 3, confidence: float = 0.6) -> DataFrame:
    """keep columns, base and spans of each row (arrays of start, kind, stop, value, before).

    spans are the base ones and those that confident contexts give, of kind 4 to 7 for likely
    email, ip, card and phone; a found string that touches a base span is left out. A context is the
    word before a string, wherever the last match or the text's start is; a string is looked at if
    it has the form of CANDIDATE, so plain words without a digit or at sign are never found. Null
    and empty texts have no spans. Rows that repeat are returned as often; an empty table gives no
    rows. A kept column named base or spans is left out.
    """
    work = Workspace(docs.sparkSession, "pii")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.select(packed(keep), base_spans(text).alias("base"), candidate_spans(text).alias("more"))
    found = found.select("__keep", "base", apart(F.col("more"), F.col("base")).alias("more"), F.monotonically_increasing_id().alias("__row"))
    # narrow and written once: graph and spans come from it, and row ids stay fixed
    found = work.save(found, "found")
    good = bootstrap(pattern_graph(found, work), work, rounds, least_seeds, confidence)
    each = found.where("size(more) > 0").select("__row", F.explode("more").alias("s"))
    taken = join_small(each.withColumn("pattern", F.col("s.before")), good, "pattern", "inner", good.count())
    extra = taken.groupBy("__row").agg(F.collect_list(F.struct(F.col("s.start"), (F.col("kind") + len(KINDS)).alias("kind"), F.col("s.stop"), F.col("s.value"), F.col("s.before"))).alias("extra"))
    out = found.join(extra, "__row", "left")
    return out.select(*unpacked(keep, ["base", "spans"]), "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(SPAN)))).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *(f"likely_{k}" for k in KINDS))])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data_digests(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_found of each row."""
    out = find_personal_data(docs, [id_col], **options)
    many = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return out.select(F.col(id_col).alias("doc_id"), *[many(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_found"))
