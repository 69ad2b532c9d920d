"""The opN queries over the supplied tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.bpe import encoding_digests
from corpusgraph.llm.chat import rotate
from corpusgraph.llm.decontaminate import contamination
from corpusgraph.llm.html_text import extract_text
from corpusgraph.llm.near_dup import near_duplicates
from corpusgraph.llm.pii import personal_data_digests
from corpusgraph.llm.quality import quality
from corpusgraph.llm.secrets import secret_digests
from corpusgraph.llm.token_lengths import token_length_report
from corpusgraph.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


def op3_html_text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4).drop("component")


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digests(_table(spark, sf_dir, "documents"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return out.withColumn("masks", spans)


def op7_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_length_report(_table(spark, sf_dir, "documents"))


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_pieces", F.round("chars_per_token", 6).alias("chars_per_token"), F.round("byte_share", 6).alias("byte_share"), F.round("token_bits", 6).alias("token_bits"), F.round("chars_per_byte_token", 6).alias("chars_per_byte_token"), "script")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_segments, op2_secret_ownership, op3_html_text_ratio, op4_minhash_near_dup, op5_pii_bootstrap,
        op6_chat_rotation, op7_token_length_histogram, op8_bpe_trie, op9_decontamination, op10_token_fertility,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _places(name: str, kind: int, pattern: str, value: str, test: str) -> str:
    """SQL for the matches of a pattern: the gaps between them give their places."""
    length = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    return (
        f"SELECT doc_id, source, {length('g[1:i]')} + {length('m[1:i - 1]')} AS a, {kind} AS kind, '{name}' AS name, {length('g[1:i]')} + {length('m[1:i]')} AS b, {value} AS v "
        f"FROM (SELECT doc_id, source, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, regexp_split_to_array(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m FROM d)) WHERE {test}"
    )


_ASSIGN = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?"
_VALUE = f"regexp_extract(m[i], '^{_ASSIGN}(.*)$', 1)"

#: SQL for the operators that it can express. Tokenisers (7, 8, 10), the parser's events (3) and the
#: spans of the bootstrap (5) are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_warc_segments": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             g AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
        FROM p LEFT JOIN g ON p.d = g.d""",
    "op2_secret_ownership": f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        base AS ({_places("assign", 0, _ASSIGN + "[A-Za-z0-9+/_.=-]+", _VALUE, f"length({_VALUE}) >= 6")}
                 UNION ALL {_places("access", 1, "AKIA[A-Z0-9]{16,}", "m[i]", "true")}
                 UNION ALL {_places("hex", 2, "[0-9a-f]{24,}", "m[i]", "true")}),
        mixed AS (SELECT * FROM ({_places("random", 3, "[A-Za-z0-9+/_=-]{24,}", "m[i]", "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]')")}) r
                  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = r.doc_id AND base.a < r.b AND base.b > r.a)
                  AND (SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*) AS c, length(r.v) AS n FROM (SELECT unnest(string_split(r.v, '')) AS x) GROUP BY x)) >= 3.5),
        spans AS (SELECT * FROM base UNION ALL SELECT * FROM mixed),
        owned AS (SELECT v, count(DISTINCT coalesce(split_part(source, '/', 1), chr(1))) AS n_owners, count(DISTINCT coalesce(source, chr(1))) AS n_repos FROM spans GROUP BY v),
        judged AS (SELECT spans.*, n_owners, n_repos, n_owners >= 4 OR n_repos >= 8 AS example, n_owners <= 2 AND n_repos < 8 AS live FROM spans JOIN owned USING (v)),
        told AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_random,
                        string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans,
                        count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example, max(n_owners) AS most_owners, max(n_repos) AS most_repos
                 FROM judged WHERE kind < 3 OR live GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
        FROM documents LEFT JOIN told USING (doc_id)""",
    "op4_minhash_near_dup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 3], ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
        both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        reach AS (SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT both_ways.v, r FROM reach JOIN both_ways ON both_ways.u = reach.u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
        JOIN (SELECT u, min(r) AS component_id FROM reach GROUP BY u) c ON c.u = d.doc_id""",
    "op6_chat_rotation": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text, 0 AS segment FROM conversations),
        who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
        p AS (SELECT t.conv_id, perspective, segment, turn, speaker, text, speaker = perspective AS mine,
                     '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || regexp_replace(regexp_replace(speaker, '<(\\\\*)\\|', '<\\1\\\\|', 'g'), '[\\r\\n]', ' ', 'g') END || chr(10) AS head,
                     regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') || '<|im_end|>' || chr(10) AS body
              FROM t JOIN who ON t.conv_id = who.conv_id),
        o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING) AS stop FROM p)
        SELECT conv_id, perspective, segment, count(*) AS n_turns, count(*) FILTER (mine) AS n_own,
               string_agg(head || body, '' ORDER BY turn, speaker, text) AS text,
               coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY turn, speaker, text) FILTER (mine), '') AS masks
        FROM o GROUP BY conv_id, perspective, segment""",
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
        iw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, ws[k : k + least(len(ws), 10) - 1] AS t, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS g
               FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k FROM b WHERE len(ws) > 0)),
        dw AS (SELECT doc_id, k, n, array_to_string(ws[k : k + n - 1], ' ') AS g
               FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
        h AS (SELECT doc_id, k, dw.n, item, dw.g FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
        hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
        -- proximity: every word within two places of its own, as counted from the window's rarest word
        wt AS (SELECT g, n, t, unnest(range(0, n)) AS k, unnest(t) AS word FROM (SELECT DISTINCT g, n, t FROM iw)),
        p AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM d) WHERE word IN (SELECT word FROM wt)),
        f AS (SELECT word, count(*) AS c FROM p GROUP BY word),
        lead AS (SELECT g, n, arg_min(k, c * 1000 + k) AS k0, arg_min(word, c * 1000 + k) AS w0 FROM wt JOIN f USING (word) GROUP BY g, n HAVING count(*) = n),
        c AS (SELECT doc_id, g, n, pos - k0 AS s FROM p JOIN lead ON word = w0),
        m AS (SELECT c.doc_id, c.g, c.n, s, wt.k, min(pos) AS a, max(pos) AS b FROM c JOIN wt USING (g, n) JOIN p ON p.doc_id = c.doc_id AND p.word = wt.word AND p.pos BETWEEN s + wt.k - 2 AND s + wt.k + 2 GROUP BY ALL),
        near AS (SELECT doc_id, g, n, s, min(a) AS a, max(b) + 1 AS b FROM m GROUP BY doc_id, g, n, s HAVING count(*) = n),
        only_near AS (SELECT * FROM near WHERE (doc_id, g, n) NOT IN (SELECT (doc_id, g, n) FROM h)),
        nn AS (SELECT doc_id, count(DISTINCT (g, n)) AS n_near FROM only_near GROUP BY doc_id),
        ni AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, item FROM only_near JOIN iw USING (g, n)) GROUP BY doc_id),
        isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b) AS isle FROM (SELECT doc_id, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM only_near)),
        nr AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS near_runs FROM (SELECT doc_id, isle, min(a) AS a, max(b) AS b FROM isl GROUP BY doc_id, isle) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
               coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items, coalesce(near_runs, '') AS near_runs
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nn USING (doc_id) LEFT JOIN ni USING (doc_id) LEFT JOIN nr USING (doc_id)""",
}
