"""The opN queries against their SQL, and the pipeline against a run of its parts by hand."""

import hashlib
from pathlib import Path

import pytest
from conftest import same_rows

from corpusgraph.llm import bpe, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.ORACLE_SQL[name])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_queries_without_sql_against_brute_force(spark, sf):
    """op3, op5, op7, op8 and op10 over the whole tables."""
    import html
    import re

    from test_llm_operators import brute_personal, brute_quality

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = lambda name, key="doc_id": {r[key]: r for r in queries.QUERIES[name](spark, sf).collect()}
    got = rows("op3_html_text_ratio", "page_id")
    assert set(got) == set(pages)
    for i, h in pages.items():
        article = re.search(r"<article>(.*?)(?:</article>|$)", h, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert got[i].text == "\n".join(filter(None, blocks))
    got = rows("op5_pii_bootstrap")
    assert set(got) == set(docs)
    for i, t in docs.items():
        base = brute_personal(t)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x[1] == k for x in base) for k in range(4))
        joined = [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in base]
        assert got[i].base_sha256 == sha(",".join(joined)) and set(joined) <= set(filter(None, got[i].spans.split(",")))
    got = rows("op10_token_fertility")
    for i, t in docs.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    got, lengths = rows("op8_bpe_trie"), []
    for i, t in docs.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        lengths.append(len(ids))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = rows("op7_token_length_histogram", "n_tokens")
    assert {n: r.n_docs for n, r in got.items()} == {n: lengths.count(n) for n in set(lengths)}
    assert all(r.truncated_tokens == sum(min(x, n) for x in lengths) for n, r in got.items())


def test_all_ten_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_pipeline(spark, sf):
    from test_llm_operators import brute_components, brute_hits, brute_quality

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in p.run(spark, sf).collect()}
    kept = {r.doc_id for r in p.quality_rules(spark, docs, sf).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept <= {i for i, t in rows if not brute_quality(t)[-1]}
    rows = [x for x in rows if x[0] in kept]
    rows = [x for x, (i, _, c) in zip(rows, brute_components(rows, 5), strict=True) if i == c]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {x[0] for x in brute_hits(rows, bench) if not x[5]}
    rows = [x for x in rows if x[0] in clean]
    assert set(got) == {i for i, _ in rows}
    left = docs.where(docs.doc_id.isin([i for i, _ in rows]))
    texts = {r.doc_id: r for r in p.secret_scan(spark, left, sf).collect()}
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    for i, r in texts.items():
        assert r.n_chars == len(r.text)
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


ODD = "doc_id long, text string, lang string, source string, n_chars long, base int, kept string, spans string, component int, `script` string"


def odd_rows():
    prose = "the old river runs along a quiet valley where seven mills once stood and people came to sell their bread on market days before winter closed all roads"
    token = "token = q8Zt4LmX92vB7k"
    rows = [(1, prose), (1, prose), (1, prose + " and snow fell"), (1, "a wholly different text about ships that sail far beyond the western islands each spring to fish for cod"), (2, prose), (None, prose), (None, None), (3, None), (3, None), (4, ""), (5, " \n\t"), (6, f"quiet valley mills by the stream keep their {token} near the old door for everybody who comes by night"), (7, None)]
    return [(i, t, None if i == 2 else "en", None if i == 6 else "src", None if t is None else len(t), 1, "x", None, 5, "q") for i, t in rows]


def test_stages_take_odd_rows(spark, sf):
    """Nulls in any column, repeated rows and ids, empty texts, and extra columns of names used inside."""
    import corpus_pipeline as p

    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    text = lambda rs: sorted((repr(r.doc_id), repr(r.text)) for r in rs)
    same = lambda rs: sorted((repr(r[0]), repr(r[1])) for r in rs)
    kept = p.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns and text(kept.collect()) == same([r for r in rows if r[1] and r[1].strip()])
    left = p.near_dedup(spark, docs, sf)
    assert left.columns == docs.columns
    # of the five rows of one text or nearly so, one stays; the other text of id 1 does too
    assert text(left.collect()) == same([rows[0], rows[3], *rows[6:]])
    clean = p.decontamination(spark, docs, sf)
    assert clean.columns == docs.columns and text(clean.collect()) == same(rows)
    masked = p.secret_scan(spark, docs, sf)
    assert masked.columns == docs.columns
    want = [(r[0], r[1] and r[1].replace("token = q8Zt4LmX92vB7k", "[SECRET]")) for r in rows]
    got = masked.collect()
    assert text(got) == same(want) and all(r.n_chars == (None if r.text is None else len(r.text)) and r.kept == "x" for r in got)
    assert p.bpe_encoding(spark, docs, sf).count() == len(rows)


def test_stages_of_an_empty_table(spark, sf):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], ODD)
    for _, stage in p.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_pipeline_leaves_only_its_result(spark, sf):
    import corpus_pipeline as p
    from corpusgraph.llm.common import shared_dir

    base = Path(shared_dir(spark).removeprefix("file:"))
    before = set(base.iterdir())
    out = p.run(spark, sf)
    assert out.count() > 0
    new = set(base.iterdir()) - before
    assert len(new) == 1 and [x.name for x in new.pop().iterdir()] == ["stage-4"]


def test_stages_bound_their_batches(spark, sf):
    """Each stage does when run alone, too, and not only below the named query."""
    import corpus_pipeline as p

    name, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    before = spark.conf.get(name)
    try:
        for _, stage in p.STAGES:
            spark.conf.set(name, "64m")
            stage(spark, docs, sf)
            assert spark.conf.get(name) == "4m"
    finally:
        spark.conf.set(name, before)
