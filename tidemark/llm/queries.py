"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, html_tree, jpeg, langid, lines, minmax, suffix, warc
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold 13-word windows of benchmark items, from the positional index."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by its host's style tree."""
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the text decoded from them, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), keep_ids=False)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 400-byte strings which occur elsewhere cover."""
    return suffix.dedup(table(spark, sf_dir, "documents"), keep_bytes=False)


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a progressive JPEG and read back, with features of its RGB tensor."""
    return jpeg.read(jpeg.store(table(spark, sf_dir, "documents")), tensors=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back as one row per capture."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what the formatted text says when parsed again."""
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(rows))


def op7_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates."""
    return minmax.components(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines and pieces of lines that an earlier document holds."""
    return lines.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_decontaminate": op1_decontaminate, "op2_html": op2_html, "op3_bpe": op3_bpe, "op4_suffix": op4_suffix, "op5_jpeg": op5_jpeg, "op6_chat": op6_chat, "op7_minmax": op7_minmax, "op8_langid": op8_langid, "op9_lines": op9_lines, "op10_warc": op10_warc}

#: SQL that gives the 32 upper-case base32 letters of a hex SHA-1.
_BASE32 = """list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), lambda a, b: a || b)"""

ORACLE_SQL: dict[str, str] = {
    "op10_warc": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages),
        q AS (SELECT page_id, url, octet_length(encode(t)) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS f FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to, url
        FROM q""",
    # The lengths hold for texts without backslashes before control strings.
    "op6_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        d AS (SELECT *, len(regexp_extract_all(text, '<s>|</s>|\[ROLE\]|\[TEXT\]|\[END\]|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>')) AS marks FROM c)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(7 + sum(17 + length(role) + length(text) + marks) AS BIGINT) AS formatted_chars
        FROM d GROUP BY conv_id""",
    "op1_decontaminate": r"""
        WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
        d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
        hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        item AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id""",
    # Texts are hex strings, two characters a byte, so that windows are cut by byte.
    "op4_suffix": """
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS MATERIALIZED (SELECT r, p, md5_number(substr(x, 2 * p + 1, 800)) AS s FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 399)) AS p FROM d)),
        hit AS (SELECT r, p FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
        edge AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, true) AS opens FROM hit),
        placed AS (SELECT r, p, sum(CAST(opens AS INT)) OVER (PARTITION BY r ORDER BY p) AS k FROM edge),
        run AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM placed GROUP BY r, k),
        gap AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM run),
        gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS until FROM run GROUP BY r),
        kept AS (SELECT r, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS y FROM gap JOIN d USING (r) GROUP BY r)
        SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(unhex(coalesce(y, '') || substr(x, 2 * coalesce(until, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)""",
    "op7_minmax": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' '), len(w) < 5) AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
        size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
        FROM d LEFT JOIN size ON size.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id""",
}
