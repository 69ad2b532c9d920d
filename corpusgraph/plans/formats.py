"""Queries of the chunkers over files of every format, with the SQL that says what they must give.

A file is made of the columns of a row of `part`: its text is a template, written as the pieces that
its chunks have to be. The Spark side only sees the whole text. The SQL side states each chunk:
its place, content and metadata. Templates name columns as ⟦key⟧.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corpusgraph.operators.chunking import Options
from corpusgraph.operators.chunking.udf import chunk_files
from corpusgraph.plans.views import dealt, table

#: The columns that templates may name, as Spark and DuckDB both say them.
COLUMNS = {"key": "p_partkey", "name": "p_name", "word": "replace(p_name, ' ', '_')", "kind": "p_type", "size": "p_size", "pad": "lpad(CAST(p_partkey AS STRING), 9, '0')"}


@dataclass(frozen=True)
class Piece:
    """A stretch of a file. `made` is the chunk's content where it isn't the stretch itself, `span` its
    (start, end) as (template, shift) pairs: the bytes of the template and so many more. A gap is in
    the file and in no chunk."""

    text: str = ""
    kind: str = ""
    meta: dict[str, str | int | bool | None] = field(default_factory=dict)
    made: str | None = None
    span: tuple[tuple[str, int], tuple[str, int]] | None = None
    gap: bool = False


@dataclass(frozen=True)
class Format:
    name: str
    path: str
    chunker: str
    fields: tuple[str, ...]
    pieces: tuple[Piece, ...]
    options: Options = Options()
    mime: str = ""
    warnings: int = 0
    member: str | None = None  # the text lies in this member of a zip archive; places in it aren't compared

    @property
    def whole(self) -> str:
        return "".join(p.text for p in self.pieces)


def _parts(template: str) -> list[tuple[bool, str]]:
    """(is a column, text) of a template's parts."""
    return [(k % 2 == 1, x) for k, x in enumerate(re.split("⟦(\\w+)⟧", template)) if x]


def column(template: str) -> Column:
    return F.concat(F.lit(""), *[F.expr(COLUMNS[x]).cast("string") if own else F.lit(x) for own, x in _parts(template)])


def sql(template: str | int | bool | None) -> str:
    if template is None:
        return "CAST(NULL AS VARCHAR)"
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    text = str(template).lower() if isinstance(template, bool) else str(template)
    return "(" + " || ".join(["''", *[f"CAST({COLUMNS[x]} AS VARCHAR)" if own else quoted(x) for own, x in _parts(text)]]) + ")"


@F.pandas_udf(BinaryType())
def zipped(members: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for names, texts in members:
        out = []
        for name, text in zip(names, texts, strict=True):
            file = io.BytesIO()
            with zipfile.ZipFile(file, "w") as z:
                z.writestr(name, text)
            out.append(file.getvalue())
        yield pd.Series(out)


def run(f: Format, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = column(f.whole)
    content = zipped(F.lit(f.member), text) if f.member else text.cast("binary")
    files = dealt(table(spark, sf_dir, "part")).select(column(f.path).alias("path"), content.alias("content"), F.lit(f.mime).alias("mime_type"), F.lit("").alias("language"))
    plain = ["file_path", "chunker", "index", "chunk_type", "start_offset", "end_offset", "token_estimate", "content_hash", "warnings"]
    out = chunk_files(files, f.options, columns={*plain, *(x.split(".")[0] for x in f.fields)})

    def value(name: str) -> Column:
        kind = out.schema[name.split(".")[0]].dataType[name.split(".")[1]].dataType.simpleString()
        return (F.array_join(name, ",") if kind.startswith("array") else F.col(name).cast("string")).alias(name.split(".")[1])

    places = [] if f.member else [F.col(c).cast("long").alias(c) for c in ("start_offset", "end_offset")]
    return out.select("file_path", "chunker", F.col("index").cast("long").alias("index"), "chunk_type", *places, F.col("token_estimate").cast("long").alias("token_estimate"), "content_hash", F.size("warnings").cast("long").alias("warnings"), *map(value, f.fields))


def oracle(f: Format) -> str:
    rows, before, k = [], "", 0
    for p in f.pieces:
        start, end = ((before, 0), (before + p.text, 0)) if p.made is None else (("", 0), (f.whole, 0))
        start, end = p.span or (start, end)
        before += p.text
        if p.gap:
            continue
        size = lambda x: f"strlen({sql(x[0])}) + {x[1]}"
        content = sql(p.text if p.made is None else p.made)
        meta = ", ".join(f"'{n.split('.')[1]}': {sql(p.meta.get(n.split('.')[1]))}" for n in f.fields)
        rows.append(f"{{'index': CAST({k} AS BIGINT), 'kind': '{p.kind}', 'a': {size(start)}, 'b': {size(end)}, 'c': {content}, {meta}}}")
        k += 1
    places = "" if f.member else "CAST(x.a AS BIGINT) AS start_offset, CAST(x.b AS BIGINT) AS end_offset, "
    fields = ", ".join(f"x.{n.split('.')[1]} AS {n.split('.')[1]}" for n in f.fields)
    return (
        f"SELECT file_path, '{f.chunker}' AS chunker, x.index AS \"index\", x.kind AS chunk_type, {places}CAST((strlen(x.c) + 3) // 4 AS BIGINT) AS token_estimate, sha256(x.c) AS content_hash, CAST({f.warnings} AS BIGINT) AS warnings, {fields} "
        f"FROM (SELECT {sql(f.path)} AS file_path, unnest([{', '.join(rows)}]) AS x FROM part)"
    )


def _document(text: str, heading: str | None = None, level: int | None = None, path: str | None = None, kind: str = "prose", made: str | None = None, **more) -> Piece:
    return Piece(text, kind, {"heading": heading, "heading_level": level, "section_path": path, **more}, made)


def _code(language: str, text: str, first: int, last: int, function: str | None = None, cls: str | None = None, signature: str | None = None) -> Piece:
    return Piece(text, "code", {"language": language, "function_name": function, "class_name": cls, "signature": signature, "line_start": first, "line_end": last})


def _gap(text: str) -> Piece:
    return Piece(text, gap=True)


DOCUMENT = ("document.heading", "document.heading_level", "document.section_path")
CODE = ("code.language", "code.function_name", "code.class_name", "code.signature", "code.line_start", "code.line_end")
_WORDS = ["⟦pad⟧ ", *(f"word{k:05d} " for k in range(1, 25))]
_LINE = "=" * 60
_FIRST, _SECOND = "First part ⟦key⟧ of a text here.", "Second part ⟦key⟧ goes on there."
_SPANS = lambda a, b: "".join(_WORDS[a:b])
_BOOK = '{"cells": [{"cell_type": "markdown", "source": ["# Head ⟦name⟧\\n", "text é"]}, {"cell_type": "code", "source": "1 + ⟦key⟧", "execution_count": 3, "outputs": [{"output_type": "execute_result", "data": {"text/plain": "⟦key⟧"}}]}, {"cell_type": "code", "source": "⟦size⟧", "outputs": []}], "metadata": {"kernelspec": {"name": "py"}}}'
_DOCX = '<w:document xmlns:w="urn:w"><w:body><w:p><w:r><w:t>Before ⟦key⟧</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>One ⟦name⟧</w:t></w:r></w:p><w:p><w:r><w:t>te</w:t></w:r><w:r><w:t>xt é</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a,b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>⟦size⟧</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'
_ODT = '<office:document-content xmlns:office="urn:office" xmlns:text="urn:text" xmlns:table="urn:table"><office:body><office:text><text:p>Before ⟦key⟧</text:p><text:h text:outline-level="1">One ⟦name⟧</text:h><text:p>text<text:s text:c="2"/>é</text:p><table:table><table:table-row><table:table-cell><text:p>a,b</text:p></table:table-cell><table:table-cell><text:p>⟦size⟧</text:p></table:table-cell></table:table-row></table:table><text:h text:outline-level="2">Two</text:h></office:text></office:body></office:document-content>'
_OFFICE = (
    Piece("", "prose", {"is_table": None}, "Before ⟦key⟧"),
    Piece("", "prose", {"heading": "One ⟦name⟧", "heading_level": 1, "section_path": "One ⟦name⟧", "is_table": True}, 'One ⟦name⟧\n\n{}\n\n"a,b",⟦size⟧'),
    Piece("", "prose", {"heading": "Two", "heading_level": 2, "section_path": "One ⟦name⟧ > Two"}, "Two"),
)


def _office(text: str, body: str) -> tuple[Piece, ...]:
    first, *rest = _OFFICE
    return (Piece(text, first.kind, first.meta, first.made), *(Piece("", p.kind, p.meta, p.made.format(body)) for p in rest))


FORMATS = (
    Format("chunk_markdown_files", "/f/⟦key⟧.md", "markdown", (*DOCUMENT, "document.has_code_block", "document.code_language", "document.word_count"), (
        _document("intro é\n", kind="markdown", has_code_block=False, word_count=2),
        _document("# A ⟦word⟧\ntext\n```py\n# no\n```\n", "A ⟦word⟧", 1, "A ⟦word⟧", "markdown", has_code_block=True, code_language="py", word_count=8),
        _document("### C\nx\n", "C", 3, "A ⟦word⟧ > C", "markdown", has_code_block=False, word_count=3),
        _document("## B\nmore ⟦key⟧\n", "B", 2, "A ⟦word⟧ > B", "markdown", has_code_block=False, word_count=4),
    )),
    Format("chunk_rst_files", "/f/⟦key⟧.rst", "rst", DOCUMENT, (
        _document("Intro é ⟦key⟧\n\n"),
        _document(f"Title ⟦name⟧\n{_LINE}\n\ntext\n\n", "Title ⟦name⟧", 1, "Title ⟦name⟧"),
        _document(f"Sub ⟦word⟧\n{_LINE.replace('=', '-')}\n\nmore\n", "Sub ⟦word⟧", 2, "Title ⟦name⟧ > Sub ⟦word⟧"),
    )),
    Format("chunk_asciidoc_files", "/f/⟦key⟧.adoc", "asciidoc", DOCUMENT, (
        _document("= Title ⟦name⟧\n\nintro é\n\n", "Title ⟦name⟧", 1, "Title ⟦name⟧"),
        _document("[[sub-⟦key⟧]]\n== Sub ⟦word⟧\n\n----\n== no heading\n----\n\n", "Sub ⟦word⟧", 2, "Title ⟦name⟧ > Sub ⟦word⟧"),
        _document("== Next\nend\n", "Next", 2, "Title ⟦name⟧ > Next"),
    )),
    Format("chunk_latex_files", "/f/⟦key⟧.tex", "latex", DOCUMENT, (
        _document("\\section{One ⟦name⟧}\ntext é\n", "One ⟦name⟧", 3, "One ⟦name⟧"),
        _document("\\subsection*{Two ⟦key⟧}\n\\begin{verbatim}\n\\section{no}\n\\end{verbatim}\n% \\section{no}\n", "Two ⟦key⟧", 4, "One ⟦name⟧ > Two ⟦key⟧"),
        _document("\\section{Three}\nend\n", "Three", 3, "Three"),
    )),
    Format("chunk_html_files", "/f/⟦key⟧.html", "html", DOCUMENT, (
        _document("<html><head><title>x</title></head><body>before ⟦key⟧<h1>A ⟦name⟧</h1><p>text é</p><h3>B</h3>u<script>v</script></body></html>", made="before ⟦key⟧"),
        _document("", "A ⟦name⟧", 1, "A ⟦name⟧", made="A ⟦name⟧\n\ntext é"),
        _document("", "B", 3, "A ⟦name⟧ > B", made="B\n\nu"),
    )),
    Format("chunk_notebook_files", "/f/⟦key⟧.ipynb", "notebook", ("notebook.cell_type", "notebook.cell_index", "notebook.execution_count", "notebook.has_output", "notebook.output_types", "notebook.kernel", "document.heading"), (
        Piece(_BOOK, "markdown", {"cell_type": "markdown", "cell_index": 0, "has_output": False, "output_types": "", "kernel": "py", "heading": "Head ⟦name⟧"}, "# Head ⟦name⟧\ntext é\n\n"),
        Piece("", "code", {"cell_type": "code", "cell_index": 1, "execution_count": 3, "has_output": True, "output_types": "execute_result", "kernel": "py"}, "```\n1 + ⟦key⟧\n```\n\n# Output:\n⟦key⟧\n\n```\n⟦size⟧\n```\n\n"),
    )),
    Format("chunk_docx_files", "/f/⟦key⟧.docx", "docx", (*DOCUMENT, "document.is_table"), _office(_DOCX, "text é"), member="word/document.xml"),
    Format("chunk_odt_files", "/f/⟦key⟧.odt", "odt", (*DOCUMENT, "document.is_table"), _office(_ODT, "text  é"), member="content.xml"),
    Format("chunk_pdf_files", "/f/⟦key⟧.pdf", "pdf", (*DOCUMENT, "document.page_number", "document.page_count", "document.extraction_quality"), (
        _document("%PDF-1.4\n1 0 obj\n<< /Length 99 >>\nstream\nBT (plain text ⟦key⟧) Tj ET\nendstream\nendobj\n2 0 obj\n<< >>\nstream\nBT (1 Intro ⟦word⟧) Tj T* (body \\(⟦key⟧\\)) Tj ET\nendstream\nendobj\n", page_number=1, page_count=2, extraction_quality="medium", made="plain text ⟦key⟧\n"),
        _document("", "1 Intro ⟦word⟧", 1, "1 Intro ⟦word⟧", page_number=2, page_count=2, extraction_quality="medium", made="1 Intro ⟦word⟧\nbody (⟦key⟧)\n"),
    )),
    Format("chunk_dockerfile_files", "/f/⟦key⟧/Dockerfile", "dockerfile", ("build.stage_name", "build.base_image"), (
        Piece("# é\nARG v=⟦key⟧\nFROM base:⟦key⟧ AS build_⟦key⟧\nRUN make ⟦word⟧\n", "build", {"stage_name": "build_⟦key⟧", "base_image": "base:⟦key⟧"}),
        Piece("FROM --platform=p scratch\nCOPY --from=build_⟦key⟧ /a /b\n", "build", {"stage_name": "stage2", "base_image": "scratch"}),
    )),
    Format("chunk_makefile_files", "/f/⟦key⟧/Makefile", "makefile", ("build.target_name", "build.dependencies"), (
        Piece("V := ⟦key⟧\n.PHONY: all\nall_⟦key⟧: dep_⟦word⟧ lib # é\n\techo a: b\n", "build", {"target_name": "all_⟦key⟧", "dependencies": "dep_⟦word⟧,lib"}),
        Piece("clean:\n\trm -f ⟦word⟧\n", "build", {"target_name": "clean", "dependencies": ""}),
    )),
    Format("chunk_hcl_files", "/f/⟦key⟧.tf", "hcl", ("infra.block_type", "infra.resource_type", "infra.resource_name"), (
        Piece('variable "v_⟦word⟧" {\n  default = "{⟦key⟧"\n}', "infra", {"block_type": "variable", "resource_type": "variable", "resource_name": "v_⟦word⟧"}),
        _gap("\n"),
        Piece('# a comment é\nresource "type_a" "r_⟦key⟧" {\n  inner {\n    size = ⟦size⟧\n  }\n}', "infra", {"block_type": "resource", "resource_type": "type_a", "resource_name": "r_⟦key⟧"}),
        Piece("\nx = ⟦key⟧\n", "infra"),
    )),
    Format("chunk_protobuf_files", "/f/⟦key⟧.proto", "protobuf", ("schema.type_kind", "schema.type_name", "schema.message_name", "schema.service_name", "schema.rpc_name"), (
        Piece('syntax = "proto3";\n\n', "schema", {"type_kind": "preamble"}),
        Piece("// M é\nmessage M_⟦key⟧ {\n  message N {}\n  string ⟦word⟧ = 1;\n}\n\n", "schema", {"type_kind": "message", "type_name": "M_⟦key⟧", "message_name": "M_⟦key⟧"}),
        Piece("service S_⟦key⟧ {\n  rpc Get_⟦word⟧(A) returns (B) {}\n  rpc Put(A) returns (B) {}\n}\n", "schema", {"type_kind": "service", "type_name": "S_⟦key⟧", "service_name": "S_⟦key⟧", "rpc_name": "Get_⟦word⟧, Put"}),
    )),
    Format("chunk_graphql_files", "/f/⟦key⟧.graphql", "graphql", ("schema.type_kind", "schema.type_name"), (
        Piece('"""Thing é"""\ntype T_⟦key⟧ {\n  ⟦word⟧: Int\n}\n\n', "schema", {"type_kind": "type", "type_name": "T_⟦key⟧"}),
        Piece("enum E_⟦word⟧ { A B }\n", "schema", {"type_kind": "enum", "type_name": "E_⟦word⟧"}),
        Piece("# more\nextend type T_⟦key⟧ { b: Int }\n", "schema", {"type_kind": "extend type", "type_name": "T_⟦key⟧"}),
        Piece("schema { query: T_⟦key⟧ }\n", "schema", {"type_kind": "schema", "type_name": "schema"}),
    )),
    Format("chunk_toml_files", "/f/⟦key⟧.toml", "toml", ("structured.table_path", "structured.key_names"), (
        Piece('top = ⟦key⟧\n[servers.⟦word⟧]\nip = "é"\n', "structured", {"table_path": "servers", "key_names": "top,ip"}),
        Piece("[[db]] # list\nport = ⟦size⟧\na.b = 1\n", "structured", {"table_path": "db", "key_names": "port,a.b"}),
    )),
    Format("chunk_xml_files", "/f/⟦key⟧.xml", "xml", ("structured.element_name", "structured.element_path", "structured.record_index"), (
        _gap('<?xml version="1.0"?>\n<root>'),
        Piece('<item id="⟦key⟧"><b>⟦name⟧ é</b></item>', "structured", {"element_name": "item", "element_path": "/root/item", "record_index": 0}),
        _gap("\n<!-- <item/> -->"),
        Piece("<note/>", "structured", {"element_name": "note", "element_path": "/root/note", "record_index": 1}),
        _gap("</root>\n"),
    )),
    Format("chunk_json_files", "/f/⟦key⟧.json", "structured", ("structured.record_index", "structured.record_count", "structured.key_names"), (
        Piece('[{"a": ⟦key⟧, "b": "⟦name⟧ é"}, {"a": 2, "c": "0123456789012345678901234567890123456789"}]', "structured", {"record_index": 0, "record_count": 1, "key_names": "a,b"}, '[{"a": ⟦key⟧, "b": "⟦name⟧ é"}]'),
        Piece("", "structured", {"record_index": 1, "record_count": 1, "key_names": "a,c"}, '[{"a": 2, "c": "0123456789012345678901234567890123456789"}]'),
    ), Options(max_size=75)),
    Format("chunk_csv_files", "/f/⟦key⟧.csv", "structured", ("structured.record_index", "structured.record_count", "structured.key_names"), (
        Piece("id,name\n⟦key⟧,⟦name⟧ é\n⟦size⟧,xxxxxxxxxxxxxxxxxxxxxxxxxxx\n", "structured", {"record_index": 0, "record_count": 1, "key_names": "id,name"}, "id,name\n⟦key⟧,⟦name⟧ é\n"),
        Piece("", "structured", {"record_index": 1, "record_count": 1, "key_names": "id,name"}, "id,name\n⟦size⟧,xxxxxxxxxxxxxxxxxxxxxxxxxxx\n"),
    ), Options(max_size=48)),
    Format("chunk_yaml_files", "/f/⟦key⟧.yaml", "structured", ("structured.key_names",), (Piece("name: ⟦word⟧\nlist:\n  - é\n# note\nkey: ⟦key⟧\n", "structured", {"key_names": "name,list,key"}),)),
    Format("chunk_ndjson_files", "/f/⟦key⟧.jsonl", "structured", ("structured.record_index",), (Piece('{"a": ⟦key⟧}\n{"b": "⟦name⟧ é"}\n', "structured", {"record_index": 0}),)),
    Format("chunk_sql_files", "/f/⟦key⟧.sql", "sql", ("sql.statement_type", "sql.object_type", "sql.table_name", "sql.procedure_name", "sql.sql_dialect"), (
        Piece("CREATE TABLE t_⟦key⟧ (id SERIAL, n VARCHAR(10));\n", "sql", {"statement_type": "CREATE", "object_type": "TABLE", "table_name": "t_⟦key⟧", "sql_dialect": "postgresql"}),
        Piece("-- é\nINSERT INTO u_⟦word⟧ VALUES (⟦size⟧, 'a;b');\n", "sql", {"statement_type": "INSERT", "object_type": "TABLE", "table_name": "u_⟦word⟧", "sql_dialect": "postgresql"}),
        Piece("CREATE FUNCTION f_⟦key⟧() RETURNS int AS $$ SELECT 1; $$ LANGUAGE sql;\n", "sql", {"statement_type": "CREATE", "object_type": "FUNCTION", "procedure_name": "f_⟦key⟧", "sql_dialect": "postgresql"}),
        Piece("SELECT ⟦size⟧;\n", "sql", {"statement_type": "SELECT", "sql_dialect": "postgresql"}),
    )),
    Format("chunk_log_files", "/f/⟦key⟧.log", "log", ("log.log_level", "log.log_format", "log.error_count", "log.source_app", "log.time_start", "log.time_end"), (
        Piece("2024-01-15T10:00:01Z INFO [api] é ⟦pad⟧\n2024-01-15T10:00:02Z INFO [api] ok ⟦pad⟧\n", "log", {"log_level": "INFO", "log_format": "structured", "error_count": 0, "source_app": "api", "time_start": "2024-01-15T10:00:01", "time_end": "2024-01-15T10:00:02"}),
        Piece("2024-01-15T10:00:03Z ERROR [api] bad ⟦key⟧\n2024-01-15T10:00:05+02:00 SEVERE x\n", "log", {"log_level": "ERROR", "log_format": "structured", "error_count": 2, "source_app": "api", "time_start": "2024-01-15T08:00:05", "time_end": "2024-01-15T10:00:03"}),
    ), Options(max_size=130)),
    Format("chunk_json_log_files", "/f/⟦key⟧.log", "log", ("log.log_level", "log.log_format", "log.error_count", "log.time_start"), (
        Piece('{"severity": "emergency", "ts": "2024-01-15 10:00:01", "user": ⟦key⟧}\n{"severity": "fine", "ts": "2024-01-15 09:00:01", "text": "⟦name⟧ é"}\n{"severity": "alert"}\n', "log", {"log_level": "FATAL", "log_format": "json", "error_count": 2, "time_start": "2024-01-15T09:00:01"}),
    )),
    Format("chunk_recursive_files", "/f/⟦key⟧.txt", "recursive", ("document.heading",), (
        Piece(f"{_FIRST}\n\n{_SECOND}", "prose", {}, f"{_FIRST} ", (("", 0), (_FIRST, 0))),
        Piece("", "prose", {}, f"ext here. {_SECOND}", ((_FIRST, -10), (f"{_FIRST}\n\n{_SECOND}", 0))),
    ), Options(max_size=44, overlap=10)),
    Format("chunk_fallback_files", "/f/⟦key⟧", "fallback", ("document.heading",), (
        Piece(_SPANS(0, 25), "unknown", {}, _SPANS(0, 12), (("", 0), ("", 120))),
        Piece("", "unknown", {}, _SPANS(10, 22), (("", 100), ("", 220))),
        Piece("", "unknown", {}, _SPANS(20, 25), (("", 200), ("", 250))),
    ), Options(max_size=120, overlap=20), "application/x-unknown"),
    Format("chunk_failed_files", "/f/⟦key⟧.ipynb", "fallback", ("document.heading",), (Piece("no notebook é ⟦key⟧", "unknown", {}, "no notebook é ⟦key⟧"),), warnings=1),
    Format("chunk_python_files", "/f/⟦key⟧.py", "code", (*CODE, "code.decorators", "code.return_type"), (
        _code("python", "import os\n\n", 1, 2),
        Piece("# é\n@d\ndef f_⟦key⟧(a: int) -> str:\n    return 1\n", "code", {"language": "python", "function_name": "f_⟦key⟧", "signature": "def f_⟦key⟧(a: int) -> str", "line_start": 3, "line_end": 6, "decorators": "d", "return_type": "str"}),
        _code("python", "\nx = ⟦size⟧\n", 7, 8),
        Piece("class A_⟦word⟧(B):\n    pass\n", "code", {"language": "python", "class_name": "A_⟦word⟧", "signature": "class A_⟦word⟧(B)", "line_start": 9, "line_end": 10, "decorators": ""}),
    )),
    Format("chunk_go_files", "/f/⟦key⟧.go", "code", CODE, (
        _code("go", "package m\n\n", 1, 2),
        _code("go", "// é\nfunc F_⟦key⟧(a int) error {\n\treturn nil\n}\n", 3, 6, "F_⟦key⟧", signature="func F_⟦key⟧(a int) error"),
        _gap("\n"),
        _code("go", "type T_⟦word⟧ struct {\n\tA int\n}\n", 8, 10, cls="T_⟦word⟧", signature="type T_⟦word⟧ struct"),
        _code("go", "func (t *T_⟦word⟧) M() {}\n", 11, 11, "M", "T_⟦word⟧", "func (t *T_⟦word⟧) M()"),
    )),
    Format("chunk_javascript_files", "/f/⟦key⟧.js", "code", (*CODE, "code.is_async", "code.is_exported"), (
        Piece("export async function f_⟦key⟧(a) { return \"}é\" }\n", "code", {"language": "javascript", "function_name": "f_⟦key⟧", "signature": "export async function f_⟦key⟧(a)", "line_start": 1, "line_end": 1, "is_async": True, "is_exported": True}),
        Piece("class A_⟦word⟧ extends B { m() {} }\n", "code", {"language": "javascript", "class_name": "A_⟦word⟧", "signature": "class A_⟦word⟧ extends B", "line_start": 2, "line_end": 2, "is_async": False, "is_exported": False}),
    )),
    Format("chunk_typescript_files", "/f/⟦key⟧.ts", "code", CODE, (
        _code("typescript", "interface I_⟦word⟧ { a: string }\n", 1, 1, cls="I_⟦word⟧", signature="interface I_⟦word⟧"),
        _code("typescript", "export enum E_⟦key⟧ { A }\n", 2, 2, cls="E_⟦key⟧", signature="export enum E_⟦key⟧"),
    )),
    Format("chunk_java_files", "/f/⟦key⟧.java", "code", (*CODE, "code.parent_class", "code.implements"), (
        _code("java", "package a;\n", 1, 1),
        Piece("public class A_⟦key⟧ extends B implements C, D {\n void m() {}\n}\n", "code", {"language": "java", "class_name": "A_⟦key⟧", "signature": "public class A_⟦key⟧ extends B implements C, D", "line_start": 2, "line_end": 4, "parent_class": "B", "implements": "C,D"}),
    )),
    Format("chunk_rust_files", "/f/⟦key⟧.rs", "code", (*CODE, "code.visibility", "code.return_type"), (
        _code("rust", "use a;\n", 1, 1),
        Piece("pub struct S_⟦word⟧ { a: i32 }\n", "code", {"language": "rust", "class_name": "S_⟦word⟧", "signature": "pub struct S_⟦word⟧", "line_start": 2, "line_end": 2, "visibility": "public"}),
        Piece("fn f_⟦key⟧(a: i32) -> i32 { a }\n", "code", {"language": "rust", "function_name": "f_⟦key⟧", "signature": "fn f_⟦key⟧(a: i32) -> i32", "line_start": 3, "line_end": 3, "visibility": "private", "return_type": "i32"}),
    )),
    Format("chunk_c_files", "/f/⟦key⟧.c", "code", CODE, (
        _code("c", "#include <a>\n", 1, 1),
        _code("c", "struct S_⟦word⟧ { int a; };\n", 2, 2, cls="S_⟦word⟧", signature="struct S_⟦word⟧"),
        _code("c", "int f_⟦key⟧(int c, char **v) {\n return 0;\n}\n", 3, 5, "f_⟦key⟧", signature="int f_⟦key⟧(int c, char **v)"),
    )),
    Format("chunk_cpp_files", "/f/⟦key⟧.cpp", "code", CODE, (
        _code("cpp", "namespace n_⟦word⟧ {\nclass A { void m() {} };\n}\n", 1, 3, cls="n_⟦word⟧", signature="namespace n_⟦word⟧"),
        _code("cpp", "int f_⟦key⟧(int a) { return a; }\n", 4, 4, "f_⟦key⟧", signature="int f_⟦key⟧(int a)"),
    )),
)
