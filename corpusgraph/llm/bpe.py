"""Byte-level BPE encoding and decoding by a traversal of a prefix-sharing trie.

The encoding of a prefix is fixed by its last token: what precedes that token is the encoding
of the shorter prefix. So the distinct words of a block of texts go into a trie of their bytes,
and a depth-first walk finds the last token of every node from those of its ancestors; a prefix
that many words share is done once. A token may follow another if merging their bytes by rank
keeps the bound between them.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import map_text, resident, strings

#: The public split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str) -> str:
    """Where a file of the installed public vocabularies lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by the public rule."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes whole texts; distinct words are encoded once and kept.

    keep_words bounds the memory: kept words are in two generations of at most half as many. When
    the young one is full it becomes the old one, and words that are met again move back, so rare
    words go and common ones stay.
    """

    def __init__(self, path: str, keep_words: int = 250_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: to_bytes(t) for t, i in vocab.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = (rank, whole)
            self.parts.setdefault(whole, (left, right))
            self.rank.setdefault(whole, rank)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.decoded = self.bytes_of | {i: s.encode() for s, i in self.special.items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.old_words: dict[str, tuple[str, int, bytes]] = {}
        self.names = {i: str(i) for i in self.bytes_of}
        self.keep_words = keep_words
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self._suffix_tokens()
        self.exact_split = self._library_split(path)

    def _suffix_tokens(self) -> None:
        """The automaton of all tokens: for each state the longest token that ends there, and for
        each token the next shorter one that is its suffix."""
        goto: dict[int, int] = {}
        parents, ends = [0], [-1]
        levels: list[list[tuple[int, int]]] = []
        for token, b in self.bytes_of.items():
            at = 0
            for depth, byte in enumerate(b):
                if (to := goto.get(at << 8 | byte)) is None:
                    to = goto[at << 8 | byte] = len(parents)
                    parents.append(at)
                    ends.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((to, byte))
                at = to
            ends[at] = token
        fail, longest = [0] * len(parents), list(ends)
        self.shorter: dict[int, int] = {}
        for level in levels:
            for state, byte in level:
                f = fail[parents[state]]
                if parents[state]:
                    while f and (f << 8 | byte) not in goto:
                        f = fail[f]
                    fail[state] = goto.get(f << 8 | byte, 0)
                below = longest[fail[state]]
                if ends[state] >= 0:
                    self.shorter[ends[state]] = below
                else:
                    longest[state] = below
        self.goto, self.fail, self.longest = goto, fail, longest
        self.many = max(self.bytes_of) + 1
        self.size = [len(self.bytes_of.get(t, b"")) for t in range(self.many)]

    def _step(self, state: int, byte: int) -> int:
        f = state
        while f and (f << 8 | byte) not in self.goto:
            f = self.fail[f]
        to = self.goto[state << 8 | byte] = self.goto.get(f << 8 | byte, 0)
        return to

    def _library_split(self, path: str):
        """The library's own split, for texts with code points whose class depends on the Unicode version."""
        from tokenizers import Tokenizer

        pre = Tokenizer.from_file(path).pre_tokenizer
        unsure = np.zeros(sys.maxunicode + 1, bool)
        for c in range(0x80, sys.maxunicode + 1):
            if unicodedata.category(chr(c)) == "Cn":
                unsure[c] = True

        def split(text: str) -> list[str] | None:
            if text.isascii() or not unsure[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                return None
            return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]

        return split

    def merge(self, word: bytes) -> list[int]:
        """Encodes by merging the pair of least rank again and again; only for short strings."""
        ids = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        while len(ids) > 1:
            rank, k = min((self.merged.get((a, b), (sys.maxsize, 0))[0], k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == sys.maxsize:
                break
            pair, whole = (ids[k], ids[k + 1]), self.merged[ids[k], ids[k + 1]][1]
            out, at = [], 0
            while at < len(ids):
                if at + 1 < len(ids) and (ids[at], ids[at + 1]) == pair:
                    out.append(whole)
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    def is_whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes keeps the two tokens.

        The merges of both are undone from the last on; the bound is crossed if, before the merge
        undone last, the tokens at the bound had a merge of lower rank, or of the same rank
        further left.
        """
        known = self.follows.get(left * self.many + right)
        if known is None:
            known = self.follows[left * self.many + right] = self._keeps_bound(left, right)
        return known

    def _keeps_bound(self, a: int, b: int) -> bool:
        if not (self.is_whole(a) and self.is_whole(b)):
            return False
        # the rank of the merge undone last, and whether the tied merge at the bound would come first
        limit, from_left = sys.maxsize, True
        while True:
            across = self.merged.get((a, b), (sys.maxsize, 0))[0]
            if across < limit or (across == limit and not from_left and limit != sys.maxsize):
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, from_left, a = ra, True, self.parts[a][1]
            else:
                limit, from_left, b = rb, False, self.parts[b][0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of the sorted distinct words, walking their trie depth first.

        Words in order are the trie's leaves in depth-first order: the prefix that a word shares
        with the one before is the path still open, and only the nodes below it are new.
        """
        goto, longest, size, follows, many, whole = self.goto, self.longest, self.size, self.follows, self.many, self.whole
        out: list[list[int]] = []
        states, last = [0], [-1]  # the automaton's state and the last token at each depth of the open path
        before = b""
        for word in words:
            shared = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state = states[shared]
            for end in range(shared + 1, len(word) + 1):
                byte = word[end - 1]
                if (to := goto.get(state << 8 | byte)) is None:
                    to = self._step(state, byte)
                state = to
                token = longest[state]
                # from the longest token on; exactly one of them fits
                while True:
                    if start := end - size[token]:
                        fits = follows.get(last[start] * many + token)
                        if fits is None:
                            fits = self.may_follow(last[start], token)
                    elif (fits := whole.get(token)) is None:
                        fits = self.is_whole(token)
                    if fits:
                        break
                    token = self.shorter[token]
                states.append(state)
                last.append(token)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= len(self.bytes_of[ids[-1]])
            out.append(ids[::-1])
            before = word
        return out

    def _learn(self, words: set[str]) -> None:
        """Puts the words of a block into the young generation."""
        known, old = self.words, self.old_words
        new = [x for x in words if x not in known]
        if len(known) + len(new) > self.keep_words // 2 and known:
            self.words, self.old_words = {}, known
            known, old, new = self.words, known, list(words)
            if len(self.follows) > 1_000_000:
                self.follows.clear()
        unseen = []
        for x in new:
            if (got := old.get(x)) is not None:
                known[x] = got
            else:
                unseen.append((x.encode("utf-8"), x))
        unseen.sort()
        names, parts = self.names, self.bytes_of
        for (_, word), ids in zip(unseen, self.encode_words([b for b, _ in unseen]), strict=True):
            known[word] = (",".join([names[i] for i in ids]), len(ids), b"".join([parts[i] for i in ids]))

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text in order; special tokens, matched first, as their ids."""
        out: list[str | int] = []
        at = 0
        for m in self.marks.finditer(text) if self.marks and any(s in text for s in self.special) else ():
            out += self.exact_split(text[at : m.start()]) or self.split.findall(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        text = text[at:] if at else text
        return out + (self.exact_split(text) or self.split.findall(text))

    def encode_block(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """(ids joined by commas, number of ids, decoded bytes) of each text."""
        with no_collection():
            return self._encode_block(texts)

    def _encode_block(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        split = [self.pieces(t) for t in texts]
        out: list[tuple[str, int, bytes]] = []
        if self.special:
            self._learn({x for x in set().union(*split) if isinstance(x, str)})
            for text in split:
                for x in set(text):
                    if isinstance(x, int):
                        self.words[x] = (str(x), 1, self.decoded[x])  # type: ignore[index]
        else:
            self._learn(set().union(*split))
        known = self.words
        for text in split:
            got = [known[x] for x in text]
            out.append((",".join([g[0] for g in got]), sum([g[1] for g in got]), b"".join([g[2] for g in got])))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_block([text])[0][0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.decoded[i] for i in ids).decode("utf-8", "replace")


@contextlib.contextmanager
def no_collection():
    """Without the cycle collector, which would walk the many kept words again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return resident(f"bpe {path}", lambda: Encoder(path))


def _located(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else vocabulary_path(vocabulary)


def encode_texts(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """keep columns, ids (array of int) and decoded (string) of each row; null and empty texts have no ids.

    vocabulary is a file name of the installed public vocabularies or a path on each executor.
    """

    def work(data, offsets, _):
        got = encoder(_located(vocabulary)).encode_block(strings(data, offsets))
        flat = np.array([int(x) for ids, _, _ in got if ids for x in ids.split(",")], np.int32)
        at = np.concatenate([[0], np.cumsum([n for _, n, _ in got])]).astype(np.int32)
        return {"ids": pa.ListArray.from_arrays(at, flat), "decoded": pa.array([d.decode("utf-8", "replace") for _, _, d in got], pa.string())}

    return map_text(docs, text_col, keep, "ids array<int>, decoded string", work, uses_resident=True)


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row.

    Null and empty texts have no ids: both digests are those of the empty string. Rows that
    repeat are returned as often; other columns are ignored.
    """

    def work(data, offsets, _):
        got = encoder(_located(vocabulary)).encode_block(strings(data, offsets))
        return {
            "n_tokens": np.array([n for _, n, _ in got], np.int64),
            "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for ids, _, _ in got],
            "decoded_sha256": [hashlib.sha256(d.decode("utf-8", "replace").encode()).hexdigest() for _, _, d in got],
        }

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(source, "text", ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", work, uses_resident=True)


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """keep columns and n_tokens of each row; null and empty texts have 0."""

    def work(data, offsets, _):
        return {"n_tokens": np.array([n for _, n, _ in encoder(_located(vocabulary)).encode_block(strings(data, offsets))], np.int64)}

    return map_text(docs, text_col, keep, "n_tokens long", work, uses_resident=True)
