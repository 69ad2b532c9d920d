"""Recursive text and fallback chunkers."""

from __future__ import annotations

from corpusgraph.operators.chunking.base import Options, Part, Source, chunker, size

#: Boundaries from the largest to the smallest.
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")
SPACE = b" \t\n\r\x0b\x0c"


def segments(text: str, most: int, level: int = 0) -> list[str]:
    """Segments of at most `most` bytes, cut at the largest boundary that is there.

    A segment keeps the boundary that ended it, less any of its characters at the end.
    """
    if size(text) <= most:
        return [text]
    while level < len(SEPARATORS) - 1 and SEPARATORS[level] not in text:
        level += 1
    sep = SEPARATORS[level]
    if not sep:
        raw = text.encode("utf-8", "replace")
        return [raw[k : k + most].decode("utf-8", "replace") for k in range(0, len(raw), most)]
    out = []
    for part in filter(None, text.split(sep)):
        kept = part if sep == " " else part + sep
        out += [kept.rstrip(sep)] if size(kept) <= most else segments(kept, most, level + 1)
    return out


@chunker("recursive", 10, mimes="text/plain", suffixes=".txt .text")
def recursive(source: Source, options: Options) -> list[Part]:
    """Segments packed with a space between them; a chunk starts with the last bytes of the one before.

    The published offsets are those of the segments in the text, found one after the other.
    """
    text, parts = source.text, []
    now, start, at = "", 0, 0

    def emit(end: int) -> None:
        parts.append(Part(start, end, "prose", content=now, whole=True))

    for seg in segments(text, options.max_size):
        place = text.find(seg, at) if seg else at
        place = at if place < 0 else place
        if now and size(now) + size(seg) > options.max_size:
            emit(at)
            tail = now.encode("utf-8", "replace")
            over = options.overlap if 0 < options.overlap < len(tail) else 0
            now = tail[len(tail) - over :].decode("utf-8", "replace") if over else ""
            start = max(0, at - len(now)) if over else place
        elif not now:
            start = place
        now += seg
        if now and not now.endswith(" "):
            now += " "
        at = place + len(seg)
    now = now.strip()
    if now:
        emit(at)
    return parts


@chunker("fallback", 0)
def fallback(source: Source, options: Options) -> list[Part]:
    """Windows of bytes that end after white space in their last 100 bytes, if there is some.

    The next window starts `overlap` bytes before the end of the last, so no byte is lost.
    """
    raw, n, parts, at = source.raw, len(source.raw), [], 0
    overlap = max(0, options.overlap)
    overlap = overlap if overlap < options.max_size else options.max_size // 4
    text = source.text
    exact = text.isascii()
    while at < n:
        end = min(n, at + options.max_size)
        if end < n and end - at > 100:
            end = next((k + 1 for k in range(end - 1, end - 101, -1) if raw[k] in SPACE), end)
        content = raw[at:end].decode("utf-8", "replace")
        # offsets are byte places; they are turned from characters later, so they are found here
        a = at if exact else len(raw[:at].decode("utf-8", "replace"))
        b = end if exact else len(raw[:end].decode("utf-8", "replace"))
        parts.append(Part(min(a, len(text)), min(b, len(text)), "unknown", content=content, whole=True))
        if end >= n:
            break
        at = max(at + 1, end - overlap)
    return parts
