"""Chunkers of build, infrastructure, schema and structured files."""

from __future__ import annotations

import csv
import io
import json
import re

from corpusgraph.operators.chunking.base import ChunkError, Options, Part, Source, chunker, lines_of, packed, size


def _from_marks(text: str, marks: list[tuple[int, dict]], kind: str, preamble: dict | None = None) -> list[Part]:
    """Parts from mark to mark; what stands before the first joins it, or is a part of its own."""
    if not marks:
        return [Part(0, len(text), kind, preamble or {})]
    starts = [m[0] for m in marks]
    ends = [*starts[1:], len(text)]
    out = []
    if preamble is None:
        starts[0] = 0
    elif text[: starts[0]].strip():
        out.append(Part(0, starts[0], kind, preamble))
    return out + [Part(a, b, kind, m) for a, b, (_, m) in zip(starts, ends, marks, strict=True)]


@chunker("dockerfile", 45, mimes="text/x-dockerfile application/x-dockerfile", suffixes="dockerfile .dockerfile", languages="dockerfile")
def dockerfile(source: Source, options: Options) -> list[Part]:
    """A part per FROM stage; stages without a name are stage1, stage2 ..."""
    marks = []
    for line in lines_of(source.text):
        if m := re.match(r"(?i)\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", line.text):
            marks.append((line.start, {"build": {"stage_name": m[2] or f"stage{len(marks) + 1}", "base_image": m[1]}}))
    return _from_marks(source.text, marks, "build")


@chunker("makefile", 44, mimes="text/x-makefile application/x-makefile", suffixes="makefile gnumakefile .mk", languages="makefile gnumakefile")
def makefile(source: Source, options: Options) -> list[Part]:
    """A part per rule, named by the first of its targets; assignments, recipes and .PHONY start none."""
    marks = []
    for line in lines_of(source.text):
        m = re.match(r"([\w.%-]+(?:[ \t]+[\w.%-]+)*)[ \t]*:(?![=:])(.*)$", line.text)
        if m and not line.text.startswith((".PHONY", "#")):
            marks.append((line.start, {"build": {"target_name": m[1].split()[0], "dependencies": m[2].split("#")[0].split()}}))
    return _from_marks(source.text, marks, "build")


def brace_end(text: str, at: int, comments: str = r"#[^\n]*|//[^\n]*|/\*.*?\*/", more: str = "") -> int:
    """The place after the brace that closes the first one from `at` on; strings and comments are passed over."""
    token = re.compile(rf'"(?:\\.|[^"\\])*"|{comments}{more}|[{{}}]', re.DOTALL)
    depth = 0
    for m in token.finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth == 0:
                return m.end()
            if depth < 0:
                break
    raise ChunkError("a brace isn't closed")


def with_comments(text: str, at: int, mark: str = r"(?:#|//)") -> int:
    """The start of the comment lines right above a place."""
    while m := re.search(rf"(?:^|\n)([ \t]*{mark}[^\n]*\n)\Z", text[max(0, at - 2000) : at]):
        at -= len(m[1])
    return at


@chunker("hcl", 43, mimes="text/x-hcl application/x-hcl text/x-terraform application/x-terraform", suffixes=".tf .tfvars .hcl")
def hcl(source: Source, options: Options) -> list[Part]:
    """Top-level blocks with their labels; what lies between them are parts without labels."""
    text, at, out = source.text, 0, []
    for m in re.finditer(r'^([A-Za-z_][\w-]*)((?:[ \t]+(?:"[^"\n]*"|[\w-]+))*)[ \t]*\{', text, re.MULTILINE):
        if m.start() < at:
            continue
        start, end = with_comments(text, m.start()), brace_end(text, m.start())
        labels = [x.strip('"') for x in re.findall(r'"[^"\n]*"|[\w-]+', m[2])]
        kind = labels[0] if m[1] in ("resource", "data") and labels else m[1]
        if text[at:start].strip():
            out.append(Part(at, start, "infra", {"infra": {}}))
        out.append(Part(max(at, start), end, "infra", {"infra": {"block_type": m[1], "resource_type": kind, "resource_name": labels[-1] if labels else None}}))
        at = end
    if text[at:].strip():
        out.append(Part(at, len(text), "infra", {"infra": {}}))
    return out


@chunker("protobuf", 42, mimes="text/x-protobuf application/x-protobuf text/protobuf", suffixes=".proto")
def protobuf(source: Source, options: Options) -> list[Part]:
    """The preamble, then top-level messages, enums and services with the comments above them."""
    text, marks, at = source.text, [], 0
    for m in re.finditer(r"^(message|enum|service|extend)\s+([\w.]+)\s*\{", text, re.MULTILINE):
        if m.start() < at:
            continue
        at = brace_end(text, m.start(), r"//[^\n]*|/\*.*?\*/")
        rpcs = re.findall(r"\brpc\s+(\w+)", text[m.start() : at]) if m[1] == "service" else []
        meta = {"type_name": m[2], "type_kind": m[1], "message_name": m[2] if m[1] == "message" else None, "service_name": m[2] if m[1] == "service" else None, "rpc_name": ", ".join(rpcs) or None}
        marks.append((with_comments(text, m.start(), r"//"), {"schema": meta}))
    return _from_marks(text, marks, "schema", {"schema": {"type_kind": "preamble"}})


@chunker("graphql", 41, mimes="application/graphql text/x-graphql application/x-graphql", suffixes=".graphql .gql .graphqls")
def graphql(source: Source, options: Options) -> list[Part]:
    """Type definitions, extensions, directives and the schema, with descriptions above them."""
    text, marks = source.text, []
    rule = r'(?:^"""(?:[^"]|"(?!""))*"""[ \t]*\n|^"[^"\n]*"[ \t]*\n|^[ \t]*#[^\n]*\n)*^(?:(extend)\s+)?(type|input|interface|enum|scalar|union|schema|directive)\b\s*@?(\w+)?'
    for m in re.finditer(rule, text, re.MULTILINE):
        name, kind = (None, m[2]) if m[2] == "schema" else (m[3], m[2])
        marks.append((m.start(), {"schema": {"type_name": name or "schema", "type_kind": f"extend {kind}" if m[1] else kind}}))
    return _from_marks(text, marks, "schema", {"schema": {"type_kind": "preamble"}})


@chunker("toml", 31, mimes="application/toml text/x-toml text/toml", suffixes=".toml", languages="toml")
def toml(source: Source, options: Options) -> list[Part]:
    """Tables by the first name of their path: those that share it are one part, at the first's place."""
    text, marks = source.text, []
    for line in lines_of(text):
        if m := re.match(r"\s*\[{1,2}\s*([^\]]+?)\s*\]{1,2}\s*(?:#.*)?$", line.text):
            marks.append((line.start, m[1].split(".")[0].strip(" \"'")))
    if not marks:
        return [Part(0, len(text), "structured", {"structured": {"key_names": _toml_keys(text)}})]
    starts = [0, *(s for s, _ in marks[1:]), len(text)]
    groups: dict[str, list[tuple[int, int]]] = {}
    for (_, name), a, b in zip(marks, starts, starts[1:], strict=False):
        groups.setdefault(name, []).append((a, b))
    out = []
    for name, spans in groups.items():
        body = "".join(text[a:b] for a, b in spans)
        alone = len(spans) == 1
        out.append(Part(spans[0][0], spans[-1][1], "structured", {"structured": {"table_path": name, "key_names": _toml_keys(body)}}, None if alone else body))
    return out


def _toml_keys(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"^\s*([\w-]+(?:\.[\w-]+)*)\s*=", text, re.MULTILINE)))


@chunker("xml", 25, mimes="application/xml text/xml", suffixes=".xml .xsd .xsl .xslt .svg .plist", languages="xml")
def xml(source: Source, options: Options) -> list[Part]:
    """A part per child of the root. Tags are matched by name; stray end tags are passed over."""
    text, stack, out, start = source.text, [], [], 0
    token = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>|<(/?)([\w:.-]+)((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')|[^<>\"'])*?)(/?)>", re.DOTALL)
    root = None
    for m in token.finditer(text):
        name = m[2]
        if name is None:
            continue
        if not m[1]:
            if not stack:
                root = root or name
            elif len(stack) == 1:
                start = m.start()
            if m[4]:
                if len(stack) == 1:
                    out.append(_element(root, name, start, m.end(), len(out)))
            else:
                stack.append(name)
        elif name in stack:
            depth = len(stack) - 1 - stack[::-1].index(name)
            if depth == 1:
                out.append(_element(root, name, start, m.end(), len(out)))
            del stack[depth:]
    if root is None:
        raise ChunkError("no element")
    return out or [Part(0, len(text), "structured", {"structured": {"element_name": root, "element_path": f"/{root}"}})]


def _element(root: str, name: str, a: int, b: int, k: int) -> Part:
    return Part(a, b, "structured", {"structured": {"element_name": name, "element_path": f"/{root}/{name}", "record_index": k}})


@chunker("structured", 40, mimes="application/json text/json application/x-yaml text/yaml text/x-yaml application/yaml text/csv text/tab-separated-values application/x-ndjson", suffixes=".json .yaml .yml .csv .tsv .jsonl .ndjson")
def structured(source: Source, options: Options) -> list[Part]:
    path, mime = source.path.lower(), source.mime.lower()
    if "csv" in mime or "tab-separated" in mime or path.endswith((".csv", ".tsv")):
        return csv_parts(source, options, "\t" if "tab" in mime or path.endswith(".tsv") else ",")
    if "ndjson" in mime or path.endswith((".jsonl", ".ndjson")):
        units = [(x.start, x.end) for x in lines_of(source.text) if x.text.strip()]
        return [Part(a, b, "structured", {"structured": {"record_index": k}}) for k, (a, b) in enumerate(packed(source.text, units, options.max_size))]
    if "json" in mime or path.endswith(".json"):
        return json_parts(source, options)
    units = []
    for x in lines_of(source.text):
        if units and (x.text[:1] in (" ", "\t", "-", "") or x.text.startswith("#")):
            units[-1] = (units[-1][0], x.end)
        else:
            units.append((x.start, x.end))
    names = lambda a, b: re.findall(r"^([\w.-]+)\s*:", source.text[a:b], re.MULTILINE)
    return [Part(a, b, "structured", {"structured": {"key_names": names(a, b)}}) for a, b in packed(source.text, units, options.max_size)]


def json_parts(source: Source, options: Options) -> list[Part]:
    """An array's elements, or an object's members if it doesn't fit whole, packed in source order."""
    text = source.text
    value = json.loads(text)
    n = len(text)

    def batches(items: list, empty: int) -> list[list]:
        out, now, held = [], [], empty
        for item in items:
            need = size(json.dumps(item, ensure_ascii=False)) + 2
            if now and held + need > options.max_size:
                out.append(now)
                now, held = [], empty
            now.append(item)
            held += need
        return [*out, now] if now else out

    if isinstance(value, list):
        out, k = [], 0
        for group in batches(value, 2):
            keys = list(dict.fromkeys(x for item in group if isinstance(item, dict) for x in item))
            out.append(Part(0, n, "structured", {"structured": {"record_index": k, "record_count": len(group), "key_names": keys}}, json.dumps(group, ensure_ascii=False)))
            k += len(group)
        return out
    if isinstance(value, dict) and size(text) > options.max_size:
        return [Part(0, n, "structured", {"structured": {"key_names": [k for k, _ in group]}}, json.dumps(dict(group), ensure_ascii=False)) for group in batches(list(value.items()), 2)]
    return [Part(0, n, "structured", {"structured": {"key_names": list(value) if isinstance(value, dict) else []}})]


def csv_parts(source: Source, options: Options, delimiter: str) -> list[Part]:
    """Rows packed under the repeated header."""
    rows = list(csv.reader(io.StringIO(source.text), delimiter=delimiter))
    if not rows:
        raise ChunkError("no rows")

    def line(row: list[str]) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=delimiter, lineterminator="\n").writerow(row)
        return out.getvalue()

    head, out, now, first = line(rows[0]), [], "", 0
    for k, row in enumerate(rows[1:]):
        text = line(row)
        if now and size(head) + size(now) + size(text) > options.max_size:
            out.append((first, k - first, now))
            now, first = "", k
        now += text
    if now or not out:
        out.append((first, len(rows) - 1 - first, now))
    return [Part(0, len(source.text), "structured", {"structured": {"record_index": a, "record_count": n, "key_names": rows[0]}}, head + body) for a, n, body in out]
