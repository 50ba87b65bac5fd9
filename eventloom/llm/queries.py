"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import render_maximal
from .common import bounded_batches
from .contentsort import copies_query
from .decontaminate import leaks
from .directcodes import encode_documents
from .jaccard import jaccard_components
from .kdshards import kd_shards
from .ordinal import classify
from .pieces import id_digests
from .qualityrules import quality_columns
from .repair import repair_query
from .stupidbackoff import score_documents
from .trie import trie_query
from .warc import archive_pages


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "expected_grade", "p_ge_1", "p_ge_2", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_columns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op4_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op5_stupid_backoff_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams with two levels of backoff; the SQL of the query above is of bigrams."""
    scored = score_documents(table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), n_shards=16)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_maximal(table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_query(table(spark, sf_dir, "documents"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_query(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_query(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc_archive": op3_warc_archive,
    "op4_direct_codes": op4_direct_codes,
    "op5_stupid_backoff": op5_stupid_backoff,
    "op5_stupid_backoff_order3": op5_stupid_backoff_order3,
    "op6_kd_shards": op6_kd_shards,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_chat_collapse": op8_chat_collapse,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_content_sort": op11_content_sort,
    "op12_structure_repair": op12_structure_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op3_warc_archive": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest,
                   octet_length(encode(coalesce(html, ''))) AS payload_bytes
            FROM pages
        ), q AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> lead_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> lead_id THEN lead_id END AS refers_to
        FROM q
    """,
    "op8_chat_collapse": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        p AS (
            SELECT conv_id, count(*) OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                   string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '') OVER w AS sofar,
                   string_agg(CASE WHEN role IS NULL THEN '1' ELSE '0' END || CASE WHEN text IS NULL THEN '1' ELSE '0' END, '') OVER w AS nulls
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
        ),
        f AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_equal, sofar, nulls FROM p WHERE pos = n_turns GROUP BY n_turns, sofar, nulls)
        SELECT conv_id, n_turns, n_equal, sofar AS text FROM f
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = f.n_turns AND p.sofar = f.sofar AND p.nulls = f.nulls)
    """,
    "op10_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles
            FROM w
        ), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        l AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), r AS (
            SELECT doc_id AS x, doc_id AS reached FROM documents
            UNION
            SELECT r.x, l.y FROM r JOIN l ON l.x = r.reached
        ), c AS (SELECT x, min(reached) AS component_id FROM r GROUP BY x)
        SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c ON c.x = s.doc_id
    """,
    "op11_content_sort": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST)
    """,
    "op12_structure_repair": """
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)
        ), k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes
            FROM conversations
        ), h AS (
            SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS code FROM k, crc
        ), d AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS twin
            FROM h WHERE code <> 0
        ), f AS (
            SELECT conv_id, turn, role, text, row_number() OVER w AS i, left(role, 1) AS r, rtrim(text, '\x20\x09\x0A\x0B\x0C\x0D') AS body,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, twin) > 1 AS again,
                   lag(left(role, 1)) OVER w AS before
            FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, twin)
        ), t AS (
            SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f
        ), n AS (
            SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
            FROM t GROUP BY conv_id
        ), put(q, p, cost, letters, added) AS (
            VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', 'user:\n'), (1, 2, 3, 'I', 'user:\n'), (2, 3, 3, 'I', 'assistant:\n'),
                   (3, 2, 3, 'I', 'user:\n'), (0, 3, 6, 'II', 'user:\nassistant:\n'), (1, 3, 6, 'II', 'user:\nassistant:\n')
        ), keep(p, r, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        edit AS (
            SELECT t.conv_id, t.i, put.q, put.p AS to_q, put.cost + 4 AS cost, put.letters || 'D' AS letters, put.added FROM t, put
            UNION ALL
            SELECT t.conv_id, t.i, put.q, keep.q, put.cost + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, put.letters || 'K', put.added || t.role || ':' || t.text || '\n'
            FROM t, put JOIN keep ON keep.p = put.p WHERE keep.r = t.r AND fault NOT IN ('blank', 'duplicate')
            UNION ALL
            SELECT t.conv_id, t.i, put.q, CASE WHEN put.p = 2 THEN 3 ELSE 2 END, put.cost + 3 + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, put.letters || 'R',
                   put.added || CASE WHEN put.p = 2 THEN 'assistant' ELSE 'user' END || ':' || t.text || '\n'
            FROM t, put WHERE fault NOT IN ('blank', 'duplicate')
        ), step AS (
            SELECT conv_id, i, q, to_q, min(struct_pack(cost := cost, letters := letters, added := added)) AS best FROM edit GROUP BY conv_id, i, q, to_q
        ), walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, struct_pack(cost := 0, letters := '', added := '') AS best FROM n
            UNION ALL
            SELECT w.conv_id, w.i + 1, s.to_q, min(struct_pack(cost := w.best.cost + s.best.cost, letters := w.best.letters || s.best.letters, added := w.best.added || s.best.added))
            FROM walk w JOIN step s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 AND s.q = w.q GROUP BY w.conv_id, w.i, s.to_q
        ), ends AS (
            SELECT w.conv_id, min(struct_pack(cost := w.best.cost + put.cost, letters := w.best.letters || put.letters, added := w.best.added || put.added)) AS best
            FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.rows = w.i JOIN put ON put.q = w.q WHERE put.p IN (0, 3) GROUP BY w.conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.letters, '') AS audit, sha256(coalesce(left(best.added, length(best.added) - 1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op13_prefix_trie": """
        WITH crc AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)
        ), own AS (
            SELECT conv_id AS c, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key, length(coalesce(text, '')) AS chars, turn
            FROM conversations WHERE conv_id IS NOT NULL
        ), o AS (
            SELECT c, turn_key, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, turn_key) AS pos FROM own
        ), k AS (
            SELECT c, c - c % 100 AS base, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 AS h
            FROM (SELECT c, count(*) AS n FROM o GROUP BY c), crc
        ), t AS (
            SELECT k.c, o.pos, turn_key, chars FROM k JOIN o ON o.c = k.base AND o.pos <= k.h
            UNION ALL
            SELECT k.c, o.pos - k.h + least(k.h, coalesce(b.n, 0)), turn_key, chars FROM k JOIN o ON o.c = k.c AND o.pos > k.h LEFT JOIN k b ON b.c = k.base
        ), p AS (
            SELECT c, 0 AS pos, '' AS prefix, 0 AS chars FROM k
            UNION ALL
            SELECT c, pos, string_agg(turn_key, '') OVER (PARTITION BY c ORDER BY pos), chars FROM t
        ), l AS (SELECT c, max(pos) AS n FROM p GROUP BY c),
        node AS (
            SELECT pos AS depth, prefix, min(p.c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (l.n = pos), '') AS ends
            FROM p JOIN l ON l.c = p.c GROUP BY pos, prefix
        ), path AS (SELECT p.c, p.pos, node.conv_id FROM p JOIN node ON node.depth = p.pos AND node.prefix = p.prefix),
        kids AS (SELECT a.conv_id, a.pos AS depth, count(*) AS n FROM node JOIN path a ON a.c = node.conv_id AND a.pos = node.depth - 1 GROUP BY a.conv_id, a.pos),
        below AS (
            SELECT a.conv_id, a.pos AS depth, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((node.n_convs - 1) * node.chars) AS saved
            FROM node JOIN path a ON a.c = node.conv_id AND a.pos <= node.depth LEFT JOIN kids ON kids.conv_id = node.conv_id AND kids.depth = node.depth GROUP BY a.conv_id, a.pos
        )
        SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, below.n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
        FROM node JOIN below ON below.conv_id = node.conv_id AND below.depth = node.depth LEFT JOIN kids ON kids.conv_id = node.conv_id AND kids.depth = node.depth
        LEFT JOIN path a ON a.c = node.conv_id AND a.pos = node.depth - 1
    """,
    "op5_stupid_backoff": """
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
        b AS (SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS history FROM t),
        c1 AS (SELECT word, count(*) AS n FROM t GROUP BY word),
        c2 AS (SELECT history, word, count(*) AS n FROM b WHERE history IS NOT NULL GROUP BY history, word),
        s AS (
            SELECT b.doc_id, CASE WHEN c2.n >= 2 THEN ln(c2.n / h.n)
                   ELSE ln(c1.n / (SELECT count(*) FROM t)) + CASE WHEN b.history IS NULL THEN 0 ELSE ln(0.4) END END AS score
            FROM b JOIN c1 ON c1.word = b.word LEFT JOIN c1 h ON h.word = b.history
            LEFT JOIN c2 ON c2.history = b.history AND c2.word = b.word
        ), r AS (SELECT doc_id, count(*) AS n_words, sum(score) AS log_score FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(r.n_words, 0) AS n_words, coalesce(round(r.log_score, 4), 0.0) AS log_score
        FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
    """,
}
