"""Chunkers on texts of our own."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.operators.chunking import REGISTRY, Options, Source
from corpusgraph.operators.chunking.base import size
from corpusgraph.operators.chunking.log import level_of, log_format, time_of
from corpusgraph.operators.chunking.sql import statements


def run(path, text, mime="", language="", **options):
    raw = text if isinstance(text, bytes) else text.encode()
    return REGISTRY.chunk(Source(raw, mime, language, path), Options(**options))


def metas(path, text, kind, *names, **options):
    return [tuple(c.meta.get(kind, {}).get(n) for n in names) for c in run(path, text, **options)[1]]


def test_markdown_headings_and_fences():
    text = "intro\n# A\ntext\n### C\n```py\n# no\n```\n## B\nmore"
    assert metas("a.md", text, "document", "heading", "heading_level", "section_path") == [(None, None, None), ("A", 1, "A"), ("C", 3, "A > C"), ("B", 2, "A > B")]
    assert metas("a.md", text, "document", "has_code_block", "code_language")[2] == (True, "py")


def test_rst_levels_follow_first_appearance():
    text = "=====\nTitle\n=====\n\nSub\n---\n\nx\n\nNext\n----\n\ny\n"
    assert metas("a.rst", text, "document", "heading", "heading_level") == [("Title", 1), ("Sub", 2), ("Next", 2)]


def test_asciidoc_blocks_hide_headings():
    assert metas("a.adoc", "= T\n\n[[s]]\n== S\n----\n== no\n----\n", "document", "heading", "heading_level") == [("T", 1), ("S", 2)]


def test_latex_environments_hide_commands():
    text = "\\section{A}\n\\begin{verbatim}\n\\section{no}\n\\end{verbatim}\n% \\section{no}\n\\subsection*{B}\nx"
    assert metas("a.tex", text, "document", "heading", "heading_level", "section_path") == [("A", 3, "A"), ("B", 4, "A > B")]


def test_html_sections():
    text = "<head><title>x</title></head><body>before<h1>A</h1><p>t</p><h3>B</h3>u<script>v</script></body>"
    got = run("a.html", text)[1]
    assert [c.content for c in got] == ["before", "A\n\nt", "B\n\nu"]
    assert got[2].meta["document"]["section_path"] == "A > B"


def test_notebook_groups_and_outputs():
    cells = [{"cell_type": "markdown", "source": ["# H\n", "t"]}, {"cell_type": "code", "source": "1+1", "execution_count": 3, "outputs": [{"output_type": "execute_result", "data": {"text/plain": "2"}}]}, {"cell_type": "code", "source": "2", "outputs": []}]
    got = run("a.ipynb", json.dumps({"cells": cells}))[1]
    assert [c.chunk_type for c in got] == ["markdown", "code"]
    assert "# Output:\n2" in got[1].content and got[1].meta["notebook"]["execution_count"] == 3
    assert {"document", "notebook"} <= set(got[0].meta)


def test_dockerfile_and_makefile():
    assert metas("Dockerfile", "ARG x\nFROM a AS b\nRUN x\nFROM --platform=p c\n", "build", "stage_name", "base_image") == [("b", "a"), ("stage2", "c")]
    text = "CC := gcc\n.PHONY: all\nall: a b\n\techo\nclean:\n\trm\n"
    assert metas("Makefile", text, "build", "target_name", "dependencies") == [("all", ["a", "b"]), ("clean", [])]


def test_hcl_protobuf_graphql():
    tf = 'variable "x" {\n type = "{"\n}\n# c\nresource "aws_s3" "b" {\n a { }\n}\nx = 1\n'
    assert metas("m.tf", tf, "infra", "block_type", "resource_type", "resource_name") == [("variable", "variable", "x"), ("resource", "aws_s3", "b"), (None, None, None)]
    proto = 'syntax = "proto3";\n// M\nmessage M { message N {} }\nservice S { rpc Get(A) returns (B) {} }\n'
    assert metas("m.proto", proto, "schema", "type_kind", "type_name", "rpc_name") == [("preamble", None, None), ("message", "M", None), ("service", "S", "Get")]
    gql = '"""d"""\ntype A { a: Int }\nextend type A { b: Int }\nunion U = A | B\nschema { query: A }\ndirective @d on FIELD\n'
    assert [m[0] for m in metas("m.graphql", gql, "schema", "type_kind")] == ["type", "extend type", "union", "schema", "directive"]


def test_structured():
    rows = [{"a": k, "b": "x" * 30} for k in range(20)]
    got = run("m.json", json.dumps(rows), max_size=400)[1]
    assert [x for c in got for x in json.loads(c.content)] == rows and len(got) > 2
    whole = {"k1": "x" * 300, "k2": "y" * 300}
    assert [list(json.loads(c.content)) for c in run("m.json", json.dumps(whole), max_size=400)[1]] == [["k1"], ["k2"]]
    got = run("m.csv", "a,b\n" + "1,2\n" * 100, max_size=60)[1]
    assert all(c.content.startswith("a,b\n") for c in got) and sum(c.content.count("1,2") for c in got) == 100
    assert metas("m.toml", "x = 1\n[servers.a]\nip = 1\n[db]\np=2\n[servers.b]\nip=2\n", "structured", "table_path") == [("servers",), ("db",)]
    assert metas("m.xml", '<?xml version="1.0"?><r><a>1</a><b x="2"/><a>3</a></r>', "structured", "element_path") == [("/r/a",), ("/r/b",), ("/r/a",)]


def test_sql():
    text = "CREATE TABLE t (id SERIAL);\nINSERT INTO u VALUES ('a;b');\nINSERT INTO t VALUES (1);\nCREATE FUNCTION f() RETURNS int AS $$ select 1; $$ LANGUAGE sql;\n"
    assert len(statements(text)) == 4
    assert metas("m.sql", text, "sql", "table_name", "procedure_name", "sql_dialect") == [("t", None, "postgresql"), ("u", None, "postgresql"), (None, "f", "postgresql")]


def test_log():
    lines = [f"2024-01-15T10:00:{k:02d}.000Z INFO [api] " + "x" * 80 for k in range(10)] + ["2024-01-15T10:01:00.000Z ERROR [api] bad", "2024-01-15T10:01:01Z INFO [api] ok"]
    got = run("m.log", "\n".join(lines) + "\n", max_size=1500)[1]
    assert [c.meta["log"]["error_count"] for c in got] == [0, 1] and got[1].content.startswith("2024-01-15T10:01:00")
    assert got[0].meta["log"]["time_end"] == "2024-01-15T10:00:09"
    assert level_of('{"severity":"emergency"}') == "FATAL" and level_of("nothing") == "INFO" and level_of("a warning, err") == "ERROR"
    assert log_format('1.1.1.1 - - [15/Jan/2024:10:00:00 +0000] "GET / HTTP/1.1" 200 1') == "apache" and log_format("Jan 15 10:00:00 h app[1]: m") == "syslog"
    assert time_of('1.1.1.1 - - [15/Jan/2024:10:00:00 +0200] "GET"').hour == 8


CODE = {
    "m.py": ("import os\n\n@d\ndef f(a: int) -> str:\n    return 1\n\nx = 1\nclass A(B):\n    pass\n", ["f", None], [None, "A"]),
    "m.go": ("package m\n\nfunc F(a int) error {\n\treturn nil\n}\n\ntype T struct {\n\tA int\n}\nfunc (t *T) M() {}\n", ["F", None, "M"], [None, "T", "T"]),
    "m.js": ('export async function f(a) { return "}" }\nclass A extends B { m() {} }\nconst g = (x) => { return 1 }\n', ["f", None, "g"], [None, "A", None]),
    "m.ts": ("interface I { a: string }\nexport enum E { A }\nfunction f<T>(a: T): void {}\n", [None, None, "f"], ["I", "E", None]),
    "m.java": ("package a;\npublic class A extends B implements C {\n void m() {}\n}\nrecord R(int a) {}\n", [None, None], ["A", "R"]),
    "m.rs": ("use a;\npub struct S { a: i32 }\nimpl T for S { fn x() {} }\npub fn f(a: i32) -> i32 { a }\n", [None, None, "f"], ["S", "S", None]),
    "m.c": ("#include <a>\nstruct S { int a; };\nint main(int c, char **v) {\n return 0;\n}\n", [None, "main"], ["S", None]),
    "m.cpp": ("namespace n {\nclass A { void m() {} };\n}\nint f(int a) { return a; }\n", [None, "f"], ["n", None]),
}


@pytest.mark.parametrize("path", CODE)
def test_code(path):
    text, functions, classes = CODE[path]
    name, got, _ = run(path, text)
    own = [c.meta["code"] for c in got if c.meta["code"].get("signature")]
    assert name == "code" and [m.get("function_name") for m in own] == functions and [m.get("class_name") for m in own] == classes
    assert "".join(c.content for c in got).replace("\n", "") == text.replace("\n", "")


def test_broken_files_go_on_to_the_next_chunker():
    for path, text in (("m.py", "def ("), ("m.json", "{"), ("m.docx", b"no zip"), ("m.ipynb", "[]")):
        name, got, warnings = run(path, text)
        assert got and warnings and name != "code"


def test_office():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        p = '<w:p><w:pPr><w:pStyle w:val="{}"/></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>'
        table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a,b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        f.writestr("word/document.xml", f'<w:document xmlns:w="u"><w:body>{p.format("Heading1", "H")}{p.format("Body", "text")}{table}{p.format("Heading2", "I")}</w:body></w:document>')
    got = run("m.docx", z.getvalue())[1]
    assert [c.content for c in got] == ['H\n\ntext\n\n"a,b",c', "I"] and got[1].meta["document"]["section_path"] == "H > I"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("content.xml", '<o:d xmlns:o="urn:office" xmlns:t="t"><o:text><t:h t:outline-level="2">H</t:h><t:p>a<t:s t:c="2"/>b</t:p></o:text></o:d>')
    assert [c.content for c in run("m.odt", z.getvalue())[1]] == ["H\n\na  b"]
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT (1. Intro) Tj T* (some text) Tj ET\nendstream\nendobj\n"
    assert [c.meta["document"]["heading"] for c in run("m.pdf", pdf)[1]] == ["1. Intro"]


def test_routing():
    assert run("a.tf", "x = 1")[0] == "hcl"
    assert REGISTRY.chunk(Source(b"x = 1", "text/plain", "", "a.tf"), routing="compat")[0] == "recursive"
    assert run("a.bin", "x", "application/foo")[0] == "fallback"
    assert run("a.md", "")[1] == []


def test_recursive_packs_and_overlaps():
    got = run("a.txt", "One two three. " * 100, max_size=200, overlap=50)[1]
    assert all(size(c.content) <= 260 for c in got) and got[1].content[:20] in got[0].content


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab é\n#=.漢 "), max_size=600), st.integers(20, 120))
def test_chunks_cover_and_fit(text, most):
    raw = text.encode()
    for path, mime in (("a.md", ""), ("a.log", ""), ("x", "application/foo")):
        _, got, _ = run(path, raw, mime, max_size=most, overlap=5)
        assert [c.start_offset for c in got] == sorted(c.start_offset for c in got)
        assert all(0 <= c.start_offset <= c.end_offset <= len(raw) for c in got)
        covered = set()
        for c in got:
            covered.update(range(c.start_offset, c.end_offset))
        assert all(raw[k : k + 1].isspace() for k in range(len(raw)) if k not in covered)
    assert all(size(c.content) <= most for c in run("a.md", raw, max_size=most)[1])
