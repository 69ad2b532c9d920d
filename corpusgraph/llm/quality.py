"""Quality rules by tokeniser fertility.

A public vocabulary splits clean prose of a language into a narrow range of characters per
token, with few byte-fallback tokens and an even spread of tokens. Each text is measured by two
vocabularies and held against the bands of its language, or of its script where the language has
none: fixed ones, and the corpus' own, taken from all its documents. Words are split once per
distinct word of a block; the rest is array work.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import words as w
from corpusgraph.llm.bpe import _located
from corpusgraph.llm.common import Workspace, join_small, map_text, packed, resident, unpacked

#: Characters counted as symbols, and letters by script (first and last code point of each range).
SYMBOLS = b"#*$%&|<>"
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0xAC00, 0xD7AF)],
}


@dataclass(frozen=True)
class Band:
    """What a text of a script, or of a language with a band of its own, may measure; token_bits counts from `entropy_from` tokens on."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_bits: float


@dataclass(frozen=True)
class Bands:
    by_language: dict[str, Band] = field(default_factory=dict)
    by_script: dict[str, Band] = field(default_factory=dict)
    other: Band = Band(0.4, 12.0, 0.9, 2.0)
    #: Texts of fewer tokens give no sound entropy and are not judged by it; nor do the corpus' bands come from them.
    entropy_from: int = 64
    #: The corpus' own bands of characters per token, by either vocabulary: so many robust deviations on both
    #: sides of the median of the language, which are taken to be wider for short texts (as if by this many
    #: tokens) and at least a share of the median.
    deviations: float = 3.5
    widening: float = 500.0
    least_deviation: float = 0.02
    #: The corpus' own lower band of token_bits among texts of like length (half octaves of tokens), where there are so many.
    bits_deviations: float = 3.0
    least_bits_deviation: float = 0.05
    bits_texts: int = 30
    #: The corpus' own upper band of byte_share, widened for short texts as above, over a least deviation.
    bytes_deviations: float = 6.0
    least_bytes_deviation: float = 0.01


#: Wide limits by script, for any text; what is narrow comes from the corpus, by language (see Bands).
DEFAULT_BANDS = Bands(
    by_script={
        "latin": Band(1.2, 8.0, 0.3, 3.0), "greek": Band(0.7, 8.0, 0.6, 3.0), "cyrillic": Band(1.0, 8.0, 0.5, 3.0),
        "hebrew": Band(0.5, 8.0, 0.8, 3.0), "arabic": Band(0.5, 8.0, 0.8, 3.0), "devanagari": Band(0.4, 8.0, 0.9, 3.0),
        "han": Band(0.3, 4.0, 0.9, 3.0), "kana": Band(0.3, 4.0, 0.9, 3.0), "hangul": Band(0.3, 4.0, 0.9, 3.0),
    },
)


#: Runs that the second vocabulary's merges don't cross; their length is bounded, so no word is slow to split.
RUNS = r"[\p{L}\p{M}]{1,64}|\p{N}{1,3}|[^\p{L}\p{M}\p{N}]{1,16}"


def _byte_vocabulary(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=RUNS, mergeable_ranks=ranks, special_tokens={})


class Pieces:
    """Piece ids of distinct words and their numbers of tokens by a second vocabulary, kept by word
    hash; the store is emptied beyond keep_words."""

    def __init__(self, path: str, second: str, keep_words: int = 250_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.second = _byte_vocabulary(second)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.keep_words = keep_words
        self._empty()

    def _empty(self) -> None:
        self.place: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.n, self.n_second = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def rows(self, hashes: np.ndarray, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, number) of the ids in self.flat of each distinct word, and its number of tokens by
        the second vocabulary; word(k) gives its text."""
        keys = hashes.tolist()
        if len(self.place) + len(keys) > self.keep_words:
            self._empty()
        new = [k for k, h in enumerate(keys) if h not in self.place]
        if new:
            texts = [word(k) for k in new]
            got = self.model.encode(texts, num_threads=1)
            lens = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.fromiter((i for x in got for i in x), np.int32, int(lens.sum()))
            first = len(self.place)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while first + len(new) > len(self.at):
                self.at, self.n, self.n_second = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.n_second))
            self.flat[self.used : self.used + len(ids)] = ids
            self.at[first : first + len(new)] = self.used + np.cumsum(lens) - lens
            self.n[first : first + len(new)] = lens
            self.n_second[first : first + len(new)] = [len(self.second.encode_ordinary(x)) for x in texts]
            self.used += len(ids)
            self.place.update((keys[k], first + i) for i, k in enumerate(new))
        place = np.fromiter((self.place[h] for h in keys), np.int64, len(keys))
        return self.at[place], self.n[place], self.n_second[place]


def pieces(path: str, second: str) -> Pieces:
    return resident(f"pieces {path} {second}", lambda: Pieces(path, second))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices first[k] to first[k] + n[k] - 1 of all k, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def repeated_words(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Per row, the words in runs of `size` words that the row has twice or more."""
    out = np.zeros(len(at) - 1, np.int64)
    g = w.window_hashes(h, size)
    if not len(g):
        return out
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[: len(g)] == row[size - 1 :]
    where = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        key = w.mix(g[where] + row[where].astype(np.uint64) * w.ORDER[55])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    many = np.zeros(len(key), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, where[many], 1)
    np.add.at(edge, where[many] + size, -1)
    return w.row_sums((np.cumsum(edge)[:-1] > 0).astype(np.int64), at)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    """Per row, the \\n-split lines that have a word and equal an earlier line."""
    out = np.zeros(len(offsets) - 1, np.int64)
    if not len(data):
        return out
    breaks = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offsets))
    starts = np.sort(np.concatenate([offsets[:-1][full], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], breaks]))
    total = np.concatenate([[0], np.cumsum(in_word)])
    keep = total[np.maximum(ends, starts)] > total[np.minimum(starts, len(data))]
    starts, ends = starts[keep], ends[keep]
    row = np.searchsorted(offsets, starts, "right") - 1
    h = w.span_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        key = w.mix(h + row.astype(np.uint64) * w.ORDER[56])
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(row[again], minlength=len(out)).astype(np.int64)


def _scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row the script of most letters (index into SCRIPTS; -1 without letters)."""
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    ascii_letters = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
    tally = np.zeros((n, len(SCRIPTS)), np.int64)
    tally[:, 0] = w.row_sums(ascii_letters.astype(np.int64), offsets)
    wide = np.flatnonzero(lead & (data >= 0xC2))
    if len(wide):
        padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
        b = padded[wide]
        two, three = ((b & 0x1F) << 6) | (padded[wide + 1] & 0x3F), ((b & 0x0F) << 12) | ((padded[wide + 1] & 0x3F) << 6) | (padded[wide + 2] & 0x3F)
        code = np.where(b < 0xE0, two, np.where(b < 0xF0, three, 0x10000))
        row = np.searchsorted(offsets, wide, "right") - 1
        for k, ranges in enumerate(SCRIPTS.values()):
            for lo, hi in ranges:
                tally[:, k] += np.bincount(row[(code >= lo) & (code <= hi)], minlength=n)
    return np.where(tally.max(axis=1) > 0, tally.argmax(axis=1), -1)


#: What is measured of each text.
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_pieces long, chars_per_token double, byte_share double, token_bits double, chars_per_byte_token double, script string"


def measure(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", second: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """keep columns and each text's counts and fertility: one pass, no shuffle.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; n_pieces, chars_per_token,
    byte_share, token_bits (entropy of the text's tokens), chars_per_byte_token (by the second
    vocabulary) and script. A null or empty text has 0 of each and script ''.
    """
    symbols = w.byte_table(lambda b: b in SYMBOLS)
    names = np.array([*SCRIPTS, ""])

    def work(data, offsets, _):
        n = len(offsets) - 1
        starts, ends, at = w.bounds(data, offsets, w.SPACED)
        h = w.span_hashes(data, starts, ends)
        in_word = w.SPACED[data]
        chars = w.row_sums((in_word & ((data & 0xC0) != 0x80)).astype(np.int64), offsets)
        row = np.repeat(np.arange(n), np.diff(at))
        store = pieces(_located(vocabulary), _located(second))
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        place, length, length_second = store.rows(distinct, lambda k: raw[starts[first[k]] : ends[first[k]]].decode("utf-8", "replace"))
        tokens = store.flat[spread(place[back], length[back])]
        token_row = np.repeat(row, length[back])
        n_pieces = np.bincount(token_row, minlength=n)
        n_bytes = np.bincount(token_row, weights=store.is_byte[tokens], minlength=n)
        key, c = np.unique(token_row * np.int64(len(store.is_byte)) + tokens, return_counts=True)
        log_sum = np.bincount(key // len(store.is_byte), weights=c * np.log2(c), minlength=n)
        some = np.maximum(n_pieces, 1)
        n_second = np.bincount(row, weights=length_second[back], minlength=n)
        return {
            "n_words": np.diff(at), "word_chars": chars, "n_symbols": w.row_sums(symbols[data].astype(np.int64), offsets),
            "n_dup_lines": duplicate_lines(data, offsets, in_word), "n_repeat_words": repeated_words(h, at, 5), "n_pieces": n_pieces.astype(np.int64),
            "chars_per_token": chars / some, "byte_share": n_bytes / some, "token_bits": np.where(n_pieces > 0, np.log2(some) - log_sum / some, 0.0),
            "chars_per_byte_token": chars / np.maximum(n_second, 1), "script": names[_scripts(data, offsets)].tolist(),
        }

    return map_text(docs, text_col, keep, MEASURES, work, uses_resident=True)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def in_band(lang: Column, bands: Bands = DEFAULT_BANDS) -> Column:
    """Whether the measures lie in the band of the language, else of the script, else of the rest."""

    def inside(b: Band) -> Column:
        flat = (F.col("n_pieces") >= bands.entropy_from) & (F.col("token_bits") < b.least_bits)
        return F.col("chars_per_token").between(b.least_chars, b.most_chars) & (F.col("byte_share") <= b.most_bytes) & ~flat

    out = inside(bands.other)
    for script, band in bands.by_script.items():
        out = F.when(F.col("script") == script, inside(band)).otherwise(out)
    for language, band in bands.by_language.items():
        out = F.when(lang.eqNullSafe(F.lit(language)), inside(band)).otherwise(out)
    return out


def _quartiles(measured: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, <column>_n, <column>_middle and <column>_deviation over all judged documents.

    Exact quantiles of a histogram at three decimals, so that one partial aggregate per group and
    value is all that is shuffled.
    """
    hist = measured.where(F.col("judged")).groupBy(*keys, F.round(column, 3).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    q = hist.groupBy(*keys).agg(F.percentile("x", [0.25, 0.5, 0.75], F.col("n")).alias("q"), F.sum("n").alias(f"{column}_n"))
    return q.select(*keys, f"{column}_n", F.col("q")[1].alias(f"{column}_middle"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias(f"{column}_deviation"))


def corpus_bands(measured: DataFrame, group: str, length: str, work: Workspace) -> list[tuple[DataFrame, list[str]]]:
    """The middle and deviation of characters per token, by either vocabulary, and of byte_share of each
    group, and of token_bits of each group and length, as tables with their keys."""
    keys = {"chars_per_token": [group], "chars_per_byte_token": [group], "byte_share": [group], "token_bits": [group, length]}
    return [(work.save(_quartiles(measured, k, column), f"bands-{column}"), k) for column, k in keys.items()]


def outside_corpus(bands: Bands = DEFAULT_BANDS) -> Column:
    """Whether the measures lie outside the corpus' own bands; groups without bands have none outside."""
    widen = F.sqrt(1 + bands.widening / F.greatest(F.col("n_pieces"), F.lit(1)))

    def away(column: str, least: float) -> Column:
        """Robust deviations from the middle."""
        middle = F.col(f"{column}_middle")
        return (F.col(column) - middle) / F.greatest(F.col(f"{column}_deviation"), least * middle)

    far = [F.abs(away(c, bands.least_deviation)) > bands.deviations * widen for c in ("chars_per_token", "chars_per_byte_token")]
    flat = F.col("judged") & (F.col("token_bits_n") >= bands.bits_texts) & (F.col("token_bits") < F.col("token_bits_middle") - bands.bits_deviations * F.greatest(F.col("token_bits_deviation"), F.lit(bands.least_bits_deviation)))
    bytewise = (F.col("byte_share") - F.col("byte_share_middle")) > bands.bytes_deviations * widen * F.greatest(F.col("byte_share_deviation"), F.lit(bands.least_bytes_deviation))
    out = F.lit(False)
    for test in (*far, bytewise, flat):
        out = out | F.coalesce(test, F.lit(False))
    return out


def quality(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", vocabulary: str = "piece_bpe_32k.model", bands: Bands = DEFAULT_BANDS) -> DataFrame:
    """keep columns, the measures, base_failed and kept of each row.

    base_failed: fewer than 10 words, or more than a fifth of the words in 5-word runs that the
    text repeats; so null, empty and white texts fail. kept is false for those, for texts outside
    the fixed band of their language or script, for texts of any length whose characters per token
    by one of the vocabularies, or whose share of byte tokens, lie off the corpus' own bands for
    their language, and for texts of entropy_from tokens or more with a lower entropy than texts of
    their language and length have. A null language falls back to the script. Rows that repeat are
    returned as often; an empty table gives no rows. A kept column named like a measure is left out.
    """
    work = Workspace(docs.sparkSession, "quality")
    held = docs.select(packed(keep), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__t"))
    out = measure(held, ["__keep", "__lang"], "__t", vocabulary)
    out = out.withColumn("base_failed", base_failed()).withColumn("judged", ~F.col("base_failed") & (F.col("n_pieces") >= bands.entropy_from))
    out = out.withColumn("__group", F.coalesce(F.col("__lang"), F.concat(F.lit("script "), F.col("script"))))
    out = work.save(out.withColumn("__length", F.floor(2 * F.log2(F.greatest(F.col("n_pieces"), F.lit(1))))), "measured")
    measures = [c for c in out.columns if c not in ("__keep", "__lang", "__group", "__length", "judged")]
    for own, keys in corpus_bands(out, "__group", "__length", work):
        out = join_small(out, own, keys, "left", own.count())
    kept = ~F.col("base_failed") & in_band(F.col("__lang"), bands) & ~outside_corpus(bands)
    return out.select(*unpacked(keep, [*measures, "kept"]), *measures, kept.alias("kept"))
