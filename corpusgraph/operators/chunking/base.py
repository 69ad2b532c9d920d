"""What chunkers share: parts of a text, their division by size, and the registry.

A chunker is a function from a Source to a list of Parts. A Part is a stretch of the text with
metadata; parts that exceed the size are divided at blank lines, then lines, then anywhere.
Sizes and offsets are bytes of UTF-8.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property


@dataclass(frozen=True)
class Options:
    max_size: int = 8000
    overlap: int = 200


@dataclass(frozen=True)
class Source:
    """One file: its bytes, and its text with invalid bytes replaced."""

    raw: bytes
    mime: str = ""
    language: str = ""
    path: str = ""

    @cached_property
    def text(self) -> str:
        return self.raw.decode("utf-8", "replace")

    @cached_property
    def lowered(self) -> tuple[str, str, str]:
        """Type, language and file name in lower case."""
        return self.mime.lower(), self.language.lower(), self.path.lower().rsplit("/", 1)[-1]


@dataclass
class Part:
    """A stretch [start, end) of the text in characters, or content of its own."""

    start: int
    end: int
    kind: str = "prose"
    meta: dict[str, dict] = field(default_factory=dict)
    content: str | None = None
    whole: bool = False  # not to be divided


@dataclass
class Chunk:
    index: int
    content: str
    start_offset: int
    end_offset: int
    chunk_type: str
    token_estimate: int
    meta: dict[str, dict]


class ChunkError(ValueError):
    """A chunker can't make sense of its input; the next one is tried."""


def size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "replace"))


def estimate(text: str) -> int:
    return (size(text) + 3) // 4


def pieces(text: str, most: int) -> list[tuple[int, int]]:
    """Ranges of at most `most` bytes that cover a text: packed paragraphs, else lines, else cuts."""
    out: list[tuple[int, int]] = []

    def pack(a: int, b: int, level: int) -> None:
        if size(text[a:b]) <= most:
            ends = [b]
        elif level < 2:
            ends = [m.end() for m in re.compile(r"\n[ \t]*\n+" if level == 0 else r"\n").finditer(text, a, b)]
            ends = [*ends, b] if not ends or ends[-1] != b else ends
        else:
            ends, k = [], a
            while k < b:
                to = min(b, k + most)
                while size(text[k:to]) > most:
                    to = k + max(1, (to - k) * most // size(text[k:to]))
                ends.append(to)
                k = to
        for e in ends:
            if out and out[-1][1] == a and size(text[out[-1][0] : e]) <= most and joins:
                out[-1] = (out[-1][0], e)
            elif size(text[a:e]) <= most or level >= 2:
                out.append((a, e))
            else:
                pack(a, e, level + 1)
            a = e

    joins = True
    if text:
        pack(0, len(text), 0)
    return out


def byte_places(text: str, places: set[int]) -> dict[int, int]:
    """The bytes of a text before each of some characters, each stretch of it being measured once."""
    if places and max(places) > len(text):
        raise ChunkError("a part ends beyond the text")
    out, last, n = {}, 0, 0
    for k in sorted(places):
        n += size(text[last:k])
        out[k], last = n, k
    return out


def finish(source: Source, parts: list[Part], options: Options) -> list[Chunk]:
    """Chunks of the parts in order, with byte offsets; parts of white space are left out."""
    text = source.text
    out: list[Chunk] = []
    for p in parts:
        own = text[p.start : p.end] if p.content is None else p.content
        ranges = [(0, len(own))] if p.whole or size(own) <= options.max_size else pieces(own, options.max_size)
        for a, b in ranges:
            piece = own[a:b]
            if not piece.strip():
                continue
            span = (p.start + a, p.start + b) if p.content is None else (p.start, p.end)
            out.append(Chunk(len(out), piece, *span, p.kind, estimate(piece), p.meta))
    if not text.isascii():
        at = byte_places(text, {k for c in out for k in (c.start_offset, c.end_offset)})
        for c in out:
            c.start_offset, c.end_offset = at[c.start_offset], at[c.end_offset]
    return out


@dataclass
class Line:
    start: int
    end: int
    text: str


def lines_of(text: str) -> list[Line]:
    """Lines without their ends; a line's range includes the line feed."""
    out, at = [], 0
    for raw in text.split("\n"):
        end = min(len(text), at + len(raw) + 1)
        out.append(Line(at, end, raw.rstrip("\r")))
        at += len(raw) + 1
    return out[:-1] if out and out[-1].start >= len(text) and len(out) > 1 else out


def sections(text: str, marks: list[tuple[int, str, int]], meta: Callable[[str, int, str, str], dict], kind: str) -> list[Part]:
    """Parts from heading to heading. marks: (start, heading, level) in order.

    A heading takes all headings of its level or deeper off the path above it.
    """
    parts, path = [], []
    bounds = [(0, "", 0), *marks] if not marks or marks[0][0] > 0 else list(marks)
    for (a, heading, level), b in zip(bounds, [x[0] for x in bounds[1:]] + [len(text)], strict=True):
        if level:
            path = [x for x in path if x[1] < level] + [(heading, level)]
        parts.append(Part(a, b, kind, meta(heading, level, " > ".join(x[0] for x in path), text[a:b])))
    return parts


def document(heading: str, level: int, path: str, text: str, **more) -> dict[str, dict]:
    return {"document": {"heading": heading or None, "heading_level": level or None, "section_path": path or None, "word_count": len(text.split()), **more}}


Chunker = Callable[[Source, Options], list[Part]]


@dataclass(frozen=True)
class Entry:
    name: str
    priority: int
    chunk: Chunker
    mimes: frozenset[str]
    suffixes: tuple[str, ...]
    languages: frozenset[str]

    @cached_property
    def names(self) -> tuple[frozenset[str], tuple[str, ...], tuple[str, ...]]:
        """Whole names, ends and starts of the file names that it takes."""
        whole = [x for x in self.suffixes if not x.startswith(".")]
        return frozenset(whole), tuple(x for x in self.suffixes if x.startswith(".")), tuple(x + "." for x in whole)

    def handles(self, s: Source) -> bool:
        mime, language, base = s.lowered
        whole, ends, starts = self.names
        return mime in self.mimes or language in self.languages or base in whole or base.endswith(ends) or base.startswith(starts)


class Registry:
    """Chunkers by priority, with one that takes everything."""

    def __init__(self) -> None:
        self.entries: list[Entry] = []
        self.fallback: Entry | None = None

    def register(self, name: str, priority: int, mimes: str = "", suffixes: str = "", languages: str = "") -> Callable[[Chunker], Chunker]:
        def add(f: Chunker) -> Chunker:
            entry = Entry(name, priority, f, frozenset(mimes.split()), tuple(suffixes.split()), frozenset(languages.split()))
            if priority:
                self.entries = sorted([*self.entries, entry], key=lambda e: (-e.priority, e.name))
            else:
                self.fallback = entry
            return f

        return add

    def replace(self, name: str, **values) -> None:
        """Changes what an entry handles."""
        self.entries = [replace(e, **values) if e.name == name else e for e in self.entries]

    def chunk(self, source: Source, options: Options = Options(), routing: str = "full") -> tuple[str, list[Chunk], list[str]]:
        """(chunker used, chunks, warnings). routing 'compat' looks at type and language only, not at the path."""
        seen = source if routing == "full" else replace(source, path="")
        warnings: list[str] = []
        if not source.raw:
            return (next((e.name for e in self.entries if e.handles(seen)), self.fallback.name), [], [])
        for e in self.entries:
            if e.handles(seen):
                try:
                    return e.name, finish(source, e.chunk(source, options), options), warnings
                except Exception as x:  # any failure of a parser sends the file on
                    warnings.append(f"CHUNKER_FAILED {e.name}: {x}")
        return self.fallback.name, finish(source, self.fallback.chunk(source, options), options), warnings

    def by_name(self, name: str) -> Entry:
        return next(e for e in [*self.entries, self.fallback] if e.name == name)


REGISTRY = Registry()


def chunker(*args, **kw) -> Callable[[Chunker], Chunker]:
    return REGISTRY.register(*args, **kw)


def packed(text: str, units: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Neighbouring units joined while they fit."""
    out: list[tuple[int, int]] = []
    for a, b in units:
        if out and size(text[out[-1][0] : b]) <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def enclosing(starts: list[int], at: int) -> int:
    return bisect_right(starts, at) - 1
