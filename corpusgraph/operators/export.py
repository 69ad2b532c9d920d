"""Exports of the graph: filters, formats and envelopes.

A format is a frame of lines (section, path order, line), made by the executors; only `render`
brings them to the driver, for the small graphs of a reader. `save` writes them instead.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import text as X
from corpusgraph.functions.paths import any_of, export_pattern
from corpusgraph.operators.graph import LABELS

#: Names of labels are kept in ASCII lower case, see functions.text.normal_name.
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Sections in the order of an export, with their columns.
SECTIONS = {
    "files": ["path", "name", "extension", "mime_type", "language", "size", "summary"],
    "directories": ["path", "name", "is_remembered", "file_count"],
    "tags": ["name", "usage_count"],
    "topics": ["name", "description", "usage_count"],
    "entities": ["name", "type", "usage_count"],
}


def filtered(frames: dict[str, DataFrame], patterns: list[str] | None = None, tags: list[str] | None = None, topics: list[str] | None = None, max_files: int | None = None) -> dict[str, DataFrame]:
    """frames with fewer files: by path patterns (any of them), by tags and topics, then the first by path."""
    if max_files is not None and max_files < 0:
        raise ValueError("max_files is negative")
    files = frames["files"]
    if patterns:
        files = files.where(any_of([export_pattern(p, F.col("path")) for p in patterns]))
    for kind, names in (("tags", tags), ("topics", topics)):
        if names:
            own = frames["edges"].where((F.col("rel") == LABELS[kind][0]) & F.col("dst_key").isin([n.translate(ASCII_LOWER) for n in names]))
            files = files.join(own.select(F.col("src_key").alias("path")), "path", "left_semi")
    if max_files:
        files = files.orderBy("path").limit(max_files)
    return frames | {"files": files}


def snapshot(frames: dict[str, DataFrame], section: str) -> DataFrame:
    """A section with its columns, nulls as empty values."""
    df = frames[section]
    empty = {"string": F.lit(""), "boolean": F.lit(False)}
    cols = [F.coalesce(F.col(c), empty.get(df.schema[c].dataType.simpleString(), F.lit(0))).alias(c) if c in df.columns else F.lit("").alias(c) for c in SECTIONS[section]]
    return df.select(*cols)


def stats(frames: dict[str, DataFrame]) -> DataFrame:
    """One row: the rows of each section, of chunks and of edges; each counted where it lies."""
    names = [*SECTIONS, "chunks", "edges"]
    each = None
    for n in names:
        if n in frames:
            one = frames[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("k"), "n")
            each = one if each is None else each.unionByName(one)
    return each.agg(*[F.coalesce(F.max(F.when(F.col("k") == n, F.col("n"))), F.lit(0).cast("long")).alias(n) for n in names])


def toon_line(section: str) -> Column:
    """A row of the compact format."""
    c = F.col
    if section == "files":
        return F.concat_ws("|", c("path"), c("name"), c("extension"), X.short_mime(c("mime_type")), c("language"), c("size").cast("string"), X.escaped_row(X.truncated(c("summary"), 100)))
    if section == "directories":
        return F.concat_ws("|", c("path"), c("name"), c("is_remembered").cast("int").cast("string"), c("file_count").cast("string"))
    if section == "tags":
        return F.concat_ws("|", c("name"), c("usage_count").cast("string"))
    if section == "topics":
        return F.concat_ws("|", c("name"), X.escaped_row(X.truncated(c("description"), 50)), c("usage_count").cast("string"))
    return F.concat_ws("|", c("name"), c("type"), c("usage_count").cast("string"))


TOON_MARKS = {"files": "#f", "directories": "#d", "tags": "#t", "topics": "#p", "entities": "#e"}


def _ordered(df: DataFrame, line: Column, n: int, key: str) -> DataFrame:
    return df.select(F.lit(n).alias("section"), F.col(key).alias("key"), line.alias("line"))


def lines(frames: dict[str, DataFrame], line: Callable[[str], Column]) -> DataFrame:
    out = None
    for n, section in enumerate(SECTIONS):
        if section in frames:
            df = snapshot(frames, section)
            one = _ordered(df, line(section), n, df.columns[0])
            out = one if out is None else out.unionByName(one)
    return out


def json_line(section: str) -> Column:
    return F.to_json(F.struct(*SECTIONS[section]))


def xml_line(section: str) -> Column:
    mark = {"files": "file", "directories": "directory", "tags": "tag", "topics": "topic", "entities": "entity"}[section]
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit(f"<{mark}>"), *[F.concat(F.lit(f"<{c}>"), safe(c), F.lit(f"</{c}>")) for c in SECTIONS[section]], F.lit(f"</{mark}>"))


Formatter = Callable[[dict[str, DataFrame], dict], str]
FORMATTERS: dict[str, Formatter] = {}
ENVELOPES: dict[str, Callable[[str], str]] = {}


def formatter(name: str) -> Callable[[Formatter], Formatter]:
    return lambda f: FORMATTERS.setdefault(name, f)


def envelope(name: str) -> Callable:
    return lambda f: ENVELOPES.setdefault(name, f)


def _rows(frames: dict[str, DataFrame], line: Callable[[str], Column]) -> dict[str, list[str]]:
    """The lines of each section by key, brought to the driver as they stream in."""
    names, out = list(SECTIONS), {}
    for r in lines(frames, line).orderBy("section", "key").toLocalIterator():
        out.setdefault(names[r.section], []).append(r.line)
    return out


@formatter("toon")
def toon(frames: dict[str, DataFrame], about: dict) -> str:
    out = [f"@kg v={about.get('version', 1)} t={about.get('exported_at', '1970-01-01T00:00:00Z')}"]
    for section, own in _rows(frames, toon_line).items():
        out += [TOON_MARKS[section], *own]
    s = stats(frames).first()
    out.append(f"@stats f={s.files} d={s.directories} c={s.chunks} t={s.tags} p={s.topics} e={s.entities} r={s.edges}")
    return "\n".join(out) + "\n"


@formatter("json")
def as_json(frames: dict[str, DataFrame], about: dict) -> str:
    s = stats(frames).first()
    body = {k: [json.loads(x) for x in v] for k, v in _rows(frames, json_line).items()}
    return json.dumps(about | {k: body.get(k, []) for k in SECTIONS} | {"total_chunks": s.chunks, "total_relationships": s.edges}, ensure_ascii=False)


@formatter("xml")
def as_xml(frames: dict[str, DataFrame], about: dict) -> str:
    s = stats(frames).first()
    head = "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in about.items())
    body = "".join(f"<{k}>{''.join(v)}</{k}>" for k, v in _rows(frames, xml_line).items())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<knowledge_graph>{head}{body}<total_chunks>{s.chunks}</total_chunks><total_relationships>{s.edges}</total_relationships></knowledge_graph>\n'


@envelope("none")
def bare(content: str) -> str:
    return content


@envelope("session-hook")
def session_hook(content: str) -> str:
    """For hooks that read the context of a new session from a JSON object."""
    return json.dumps({"continue": True, "suppressOutput": True, "hookSpecificOutput": {"hookEventName": "SessionStart", "additionalContext": content}})


@envelope("context-hook")
def context_hook(content: str) -> str:
    """For hooks that read only the added context."""
    return json.dumps({"hookSpecificOutput": {"additionalContext": content}})


def render(frames: dict[str, DataFrame], fmt: str = "toon", wrap: str = "none", about: dict | None = None, **filters) -> str:
    """The export as one string. Unknown formats and envelopes raise KeyError."""
    form, shell = FORMATTERS[fmt], ENVELOPES[wrap]
    return shell(form(filtered(frames, **filters), about or {"version": 1, "exported_at": "1970-01-01T00:00:00Z"}))


def index_resource(frames: dict[str, DataFrame], uri: str, about: dict | None = None) -> tuple[str, str]:
    """(MIME type, content) of the index by its URI: <scheme>://index, in XML, or ://index/xml, /json or
    /toon. Any other URI raises KeyError."""
    _, _, place = uri.partition("://")
    fmt = {"index": "xml", "index/xml": "xml", "index/json": "json", "index/toon": "toon"}[place]
    return {"xml": "application/xml", "json": "application/json", "toon": "text/plain"}[fmt], render(frames, fmt, about=about)


def save(frames: dict[str, DataFrame], path: str, fmt: str = "toon", **filters) -> None:
    """Writes the lines of the export under path, sorted, with a partition per section."""
    line = {"toon": toon_line, "json": json_line, "xml": xml_line}[fmt]
    lines(filtered(frames, **filters), line).repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("section", "line").write.mode("overwrite").partitionBy("section").text(path)
