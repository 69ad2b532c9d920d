"""The byte functions on all rows, accents among them, against brute force on bytes."""

import hashlib

from corpusgraph.plans import registry
from corpusgraph.plans import views as V


def rows(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet").collect()


def is_text(peek):
    try:
        return b"\0" not in peek and peek.decode() is not None
    except UnicodeDecodeError:
        return False


def test_snippets_of_all_texts(spark, sf):
    want = {r.doc_id: " ".join(r.text.encode()[10:70].decode("utf-8", "replace").split()) for r in rows(spark, sf, "documents")}
    assert {r.doc_id: r.snippet for r in registry.QUERIES["snippet_read"](spark, sf).collect()} == want
    assert any("\ufffd" in s for s in want.values())


def test_all_turns_condensed(spark, sf):
    want = {}
    for r in rows(spark, sf, "conversations"):
        raw = r.text.encode()
        cut = raw[:112] + b"\n\n[...truncated...]\n\n" + raw[-48:] if len(raw) > 160 else raw
        want[r.conv_id, r.turn] = (cut.decode("utf-8", "replace"), hashlib.sha256(cut).hexdigest())
    assert {(r.conv_id, r.turn): (r.text, r.bytes_sha256) for r in registry.QUERIES["condense_text"](spark, sf).collect()} == want


def test_toon_rows_of_all_files(spark, sf):
    texts = {r.path: r.text for r in V.files(spark, sf).select("path", "text").collect()}
    got = registry.QUERIES["export_toon_rows"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.line.split("|")[0]].encode()
        summary = (raw[:97] + b"..." if len(raw) > 100 else raw).replace(b"|", b"\\|").replace(b"\n", b"\\n").replace(b"\r", b"")
        head = "|".join(r.line.split("|")[:6]) + "|"
        assert r.line == head + summary.decode("utf-8", "replace") and r.bytes_sha256 == hashlib.sha256(head.encode() + summary).hexdigest()


def test_pages_by_their_whole_peek(spark, sf, tmp_path):
    made = [(5, "<html>" + "a" * 5000), (10, "<html>" + "a" * 4089 + "\u00e9" + "a" * 50), (15, "<html>" + "a" * 60 + "\0"), (20, "<html>" + "a" * 4088 + "\u00e9" + "a" * 50)]
    spark.createDataFrame(made, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    query = registry.QUERIES["classify_pages"]
    assert {r.page_id // 5: r.likely_text for r in query(spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: False, 4: True}
    got = {r.page_id: r.likely_text for r in query(spark, sf).collect()}
    want = {r.page_id: is_text(r.html.encode()[:4096]) for r in rows(spark, sf, "pages") if r.page_id % 5 == 0}
    assert want == {k: got[k] for k in want}
