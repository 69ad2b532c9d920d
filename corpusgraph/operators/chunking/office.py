"""Chunkers of notebooks, word processor documents and PDF files."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from xml.etree import ElementTree

from corpusgraph.operators.chunking.base import ChunkError, Options, Part, Source, chunker, document


@chunker("notebook", 76, mimes="application/x-ipynb+json", suffixes=".ipynb")
def notebook(source: Source, options: Options) -> list[Part]:
    """Neighbouring cells of one type; code is fenced, with its outputs below."""
    book = json.loads(source.text)
    cells = book.get("cells")
    if not isinstance(cells, list):
        raise ChunkError("no cells")
    joined = lambda x: "".join(x) if isinstance(x, list) else (x or "")
    kernel = (book.get("metadata") or {}).get("kernelspec", {}).get("name")
    groups: list[list[tuple[int, dict]]] = []
    for k, cell in enumerate(cells):
        if groups and groups[-1][0][1].get("cell_type") == cell.get("cell_type"):
            groups[-1].append((k, cell))
        else:
            groups.append([(k, cell)])
    parts = []
    for group in groups:
        kind, text, heading, types, count = group[0][1].get("cell_type"), "", None, [], None
        for _, cell in group:
            body = joined(cell.get("source")).rstrip("\n") + "\n"
            if kind == "code":
                text += f"```\n{body}```\n"
                count = cell.get("execution_count") or count
                for output in cell.get("outputs") or []:
                    types.append(output.get("output_type"))
                    shown = joined(output.get("text")) or joined((output.get("data") or {}).get("text/plain")) or "\n".join(output.get("traceback") or [])
                    if shown:
                        text += "\n# Output:\n" + shown.rstrip("\n") + "\n"
            else:
                text += body
                if kind == "markdown" and heading is None and (m := re.search(r"^(#{1,6})\s+(.+)$", body, re.MULTILINE)):
                    heading = (m[2].strip(), len(m[1]))
            text += "\n"
        meta = {"notebook": {"cell_type": kind, "cell_index": group[0][0], "execution_count": count, "has_output": bool(types), "output_types": sorted(set(types)), "kernel": kernel}}
        if heading:
            meta |= document(heading[0], heading[1], heading[0], text)
        parts.append(Part(0, len(source.text), {"code": "code", "markdown": "markdown"}.get(kind, "prose"), meta, text))
    return parts


def _opened(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as x:
        raise ChunkError(str(x)) from x


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(archive.read(name))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as x:
        raise ChunkError(str(x)) from x


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _csv_row(cells: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if re.search(r'[",\n]', c) else c for c in cells)


def _by_heading(blocks: list[tuple[str, int, str]], n: int, more: dict) -> list[Part]:
    """Parts from (kind, level, text) blocks; a heading opens a section, tables stay where they are."""
    found, path = [["", 0, []]], []
    for kind, level, text in blocks:
        if kind == "heading":
            found.append([text, level, []])
        found[-1][2].append((kind, text))
    parts = []
    for heading, level, own in found:
        if level:
            path = [x for x in path if x[1] < level] + [(heading, level)]
        body = "\n\n".join(t for _, t in own)
        if body.strip():
            parts.append(Part(0, n, "prose", document(heading, level, " > ".join(x[0] for x in path), body, is_table=any(k == "table" for k, _ in own) or None, **more), body))
    return parts


@chunker("docx", 72, mimes="application/vnd.openxmlformats-officedocument.wordprocessingml.document", suffixes=".docx")
def docx(source: Source, options: Options) -> list[Part]:
    """Sections by heading styles; tables as comma-separated rows in their place."""
    text_of = lambda e: "".join("\t" if _local(x) == "tab" else "\n" if _local(x) in ("br", "cr") else (x.text or "") for x in e.iter() if _local(x) in ("t", "tab", "br", "cr"))
    archive, blocks = _opened(source.raw), []
    body = next((e for e in _xml(archive, "word/document.xml").iter() if _local(e) == "body"), None)
    for e in body if body is not None else ():
        if _local(e) == "p":
            style = next((_attr(x, "val") or "" for x in e.iter() if _local(x) == "pStyle"), "")
            text = text_of(e).strip()
            m = re.fullmatch(r"(?:heading|titre|berschrift)\s*([1-9])", style, re.IGNORECASE)
            level = int(m[1]) if m else 1 if style.lower() == "title" else 0
            if text:
                blocks.append(("heading" if level else "text", level, text))
        elif _local(e) == "tbl":
            rows = [[" ".join(text_of(c).split()) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            blocks.append(("table", 0, "\n".join(map(_csv_row, rows))))
    meta = _properties(archive, "docProps/core.xml", {"creator": "author", "created": "created_date", "modified": "modified_date"})
    return _by_heading(blocks, len(source.text), meta)


def _properties(archive: zipfile.ZipFile, name: str, names: dict[str, str]) -> dict:
    try:
        return {names[_local(e)]: e.text for e in _xml(archive, name).iter() if _local(e) in names and e.text}
    except ChunkError:
        return {}


@chunker("odt", 71, mimes="application/vnd.oasis.opendocument.text", suffixes=".odt")
def odt(source: Source, options: Options) -> list[Part]:
    """Sections by headings with their outline levels; lists and tables in their place."""
    archive, blocks = _opened(source.raw), []

    def text_of(e: ElementTree.Element) -> str:
        out = e.text or ""
        for x in e:
            name = _local(x)
            out += {"tab": "\t", "line-break": "\n", "s": " " * int(_attr(x, "c") or 1)}.get(name, "" if name in ("annotation", "tracked-changes") else text_of(x)) + (x.tail or "")
        return out

    def walk(e: ElementTree.Element) -> None:
        for x in e:
            name = _local(x)
            if name == "h":
                blocks.append(("heading", int(_attr(x, "outline-level") or 1), text_of(x).strip()))
            elif name == "p":
                if text := text_of(x).strip():
                    blocks.append(("text", 0, text))
            elif name == "table":
                rows = [[" ".join(text_of(c).split()) for c in r if _local(c) == "table-cell"] for r in x.iter() if _local(r) == "table-row"]
                blocks.append(("table", 0, "\n".join(map(_csv_row, rows))))
            else:
                walk(x)

    body = next((e for e in _xml(archive, "content.xml").iter() if _local(e) == "text" and "office" in e.tag), None)
    if body is not None:
        walk(body)
    meta = _properties(archive, "meta.xml", {"creator": "author", "creation-date": "created_date", "date": "modified_date"})
    return _by_heading(blocks, len(source.text), meta)


def pdf_pages(raw: bytes) -> list[str]:
    """The text that the content streams of a PDF show, a stream per page.

    Plain and Flate streams with literal and hexadecimal strings in simple encodings; fonts with
    other encodings can't be read without their maps.
    """
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.DOTALL):
        data = m[1]
        if b"FlateDecode" in raw[max(0, m.start() - 400) : m.start()]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        if b"BT" not in data or (b"Tj" not in data and b"TJ" not in data):
            continue
        text = ""
        for t in re.finditer(rb"\((?:\\.|[^\\()]|\([^()]*\))*\)|<[0-9A-Fa-f\s]+>|\b(?:Td|TD|Tm|ET)\b|T\*|'", data, re.DOTALL):
            x = t[0]
            if x[:1] == b"(":
                plain = re.sub(rb"\\([0-7]{1,3})", lambda o: bytes([int(o[1], 8) & 255]), x[1:-1])
                text += re.sub(rb"\\(.)", lambda o: {b"n": b"\n", b"t": b"\t", b"r": b""}.get(o[1], o[1]), plain, flags=re.DOTALL).decode("latin-1")
            elif x[:1] == b"<":
                digits = re.sub(rb"\s", b"", x[1:-1])
                text += bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
            elif text and not text.endswith("\n"):
                text += "\n"
        if text.strip():
            out.append(text.strip())
    return out


def pdf_heading(line: str) -> int:
    """The level of a heading line, or 0: numbered, 'Chapter 1' and the like, or short capitals."""
    line = line.strip()
    if m := re.match(r"((?:\d+\.?)+)\s+[A-Za-z]", line):
        return min(6, len(re.findall(r"\d+", m[1]))) if len(line) < 120 else 0
    if re.match(r"(?i)(Chapter|Section|Part|Appendix)\s+\w+", line) and len(line) < 120:
        return 1
    return 1 if len(line) < 80 and re.fullmatch(r"[A-Z][A-Z\s]+", line) else 0


@chunker("pdf", 73, mimes="application/pdf", suffixes=".pdf")
def pdf(source: Source, options: Options) -> list[Part]:
    """Sections by heading-like lines, with the page that each starts on."""
    pages = pdf_pages(source.raw) if source.raw[:5] == b"%PDF-" else [source.text]
    if not pages:
        raise ChunkError("no text can be read")
    found, path = [["", 0, 1, ""]], []
    for number, page in enumerate(pages, 1):
        for line in page.split("\n"):
            level = pdf_heading(line)
            if level:
                found.append([line.strip(), level, number, ""])
            found[-1][3] += line + "\n"
    parts = []
    for heading, level, number, body in found:
        if level:
            path = [x for x in path if x[1] < level] + [(heading, level)]
        if body.strip():
            quality = "medium" if len(re.findall(r"\w", body)) > 0.5 * len(body.strip()) else "low"
            parts.append(Part(0, len(source.text), "prose", document(heading, level, " > ".join(x[0] for x in path), body, page_number=number, page_count=len(pages), extraction_quality=quality), body))
    return parts
