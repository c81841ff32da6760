"""Queries over the numbered operators, one per operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .quality import BOILERPLATE, BOILERPLATE_WORDS, MAX_LOST_PCT, MAX_REPEAT_PCT, MIN_WORDS, SENTENCE_MARKS, SEPARATORS, SYMBOLS, WORD

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""


@register("op1_near_duplicates", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op2_pattern_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces_of

    pieces = pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", 2)
    return pack(pieces)


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), p AS (
  SELECT conv_id, i, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY i) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), k AS (
  SELECT min(conv_id) AS conv_id FROM p WHERE i = n AND (prefix, i) NOT IN (SELECT (prefix, i) FROM p WHERE i < n) GROUP BY prefix, n
)
SELECT conv_id, CAST((i - 1) // 1024 AS INTEGER) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || CASE WHEN role = '' THEN 'user' ELSE replace(role, '<|', '< |') END || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY i) AS text
FROM t JOIN k USING (conv_id) GROUP BY conv_id, (i - 1) // 1024
"""


@register("op3_chat_snapshots", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k,
    unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS gram
  FROM b WHERE len(ws) > 0
), ks AS (SELECT DISTINCT k FROM g),
d AS (
  SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM w, ks WHERE len(ws) >= k
), o AS (
  SELECT d.doc_id, d.i, d.k, g.item_id FROM (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM d) d JOIN g ON g.gram = d.gram AND g.k = d.k
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM o) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@register("op4_decontamination", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""


@register("op5_warc_pages", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    folder = scratch_path(spark, "warc")
    return read_warc(write_warc(table(spark, sf_dir, "pages"), folder), folder).drop("url")


OP6_SQL = r"""
WITH x AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w, len(ws) AS len FROM x),
target AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
b AS (
  SELECT doc_id, len, w, lag(w, 1, '') OVER (PARTITION BY doc_id ORDER BY p) AS v, CAST(t.doc_id IS NOT NULL AS INT) AS t FROM w LEFT JOIN target t USING (doc_id)
),
o AS (SELECT doc_id, len, t, v, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id, w) AS nw, sum(count(*)) OVER (PARTITION BY doc_id, v) AS nv FROM b GROUP BY doc_id, len, t, v, w),
pair AS (SELECT v, w, sum(n) AS ca, sum(n * t) AS ct FROM o GROUP BY v, w),
uni AS (SELECT w, sum(ca) AS ua, sum(ct) AS ut FROM pair GROUP BY w),
con AS (SELECT v, sum(ca) AS va, sum(ct) AS vt FROM pair GROUP BY v),
size AS (SELECT count(*) + 2 AS side, sum(ua) AS na, sum(ut) AS nt FROM uni),
k AS (
  SELECT o.*, ca, ct, ua, ut, va, vt, side, nt - t * len AS nt, na - len AS na, CASE WHEN na > len THEN (nt - t * len) / CAST(na - len AS DOUBLE) ELSE 1 END AS k
  FROM o JOIN pair USING (v, w) JOIN uni USING (w) JOIN con USING (v), size
),
s AS (
  SELECT doc_id, sum(n * (ln(((ca - n) * k + 100 * ((ua - nw) * k + 1) / (na * k + side)) / ((va - nv) * k + 100))
    - ln((ct - t * n + 100 * (ut - t * nw + 1.0) / (nt + side)) / (vt - t * nv + 100.0)))) / any_value(len) AS score
  FROM k GROUP BY doc_id
)
SELECT x.doc_id, len(ws) AS n_tokens, t.doc_id IS NOT NULL AS is_target, round(score, 6) AS score
FROM x LEFT JOIN s USING (doc_id) LEFT JOIN target t ON t.doc_id = x.doc_id
"""


@register("op6_cross_entropy_difference", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import cross_entropy_difference

    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = cross_entropy_difference(table(spark, sf_dir, "documents"), target)
    return out.withColumn("score", F.round("score", 6))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
), s AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM l WHERE NOT regexp_full_match(line, '[ \t\r\f\x0b]*')
), w AS (
  SELECT doc_id, p, 1 AS k, line AS lines FROM s WHERE n > 50
  UNION ALL
  SELECT a.doc_id, a.p, 2, a.line || chr(10) || b.line FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.p = a.p + 1 WHERE a.n + b.n > 50 AND (a.n <= 50 OR b.n <= 50)
  UNION ALL
  SELECT a.doc_id, a.p, 3, a.line || chr(10) || b.line || chr(10) || c.line
  FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.p = a.p + 1 JOIN s c ON c.doc_id = a.doc_id AND c.p = a.p + 2 WHERE a.n + b.n <= 50 OR b.n + c.n <= 50
), f AS (SELECT doc_id, p, k, row_number() OVER (PARTITION BY lines ORDER BY doc_id, p) AS n FROM w),
g AS (SELECT DISTINCT s.doc_id, s.i FROM f JOIN s ON s.doc_id = f.doc_id AND s.p BETWEEN f.p AND f.p + f.k - 1 WHERE f.n > 1),
r AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(g.i) AS n_removed
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
), n AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(r.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@register("op7_line_winnowing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), words=50)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op8_bit_packed_ids")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitpack import read_ids, write_ids

    folder = scratch_path(spark, "ids")
    manifest = write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), "space", 49_408, 2)
    return read_ids(manifest, folder)


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
l AS (
  SELECT doc_id, line, regexp_extract_all(line, '{WORD}') AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
), m AS (
  SELECT doc_id, line, len(lw) AS n, list_sum(list_transform(lw, lambda w: length(w))) AS chars, len(regexp_extract_all(line, '{SEPARATORS}')) AS seps,
         len(regexp_extract_all(line, '{SYMBOLS}')) AS syms FROM l WHERE len(lw) > 0
), f AS (
  SELECT *, NOT regexp_matches(line, '{SENTENCE_MARKS}') OR 10 * syms > chars OR (seps >= 3 AND 4 * seps >= n)
            OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{BOILERPLATE}', 'i')) AS fails FROM m
), line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_failed_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS n_lost_words
  FROM f GROUP BY doc_id
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), r AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1),
h AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT g.doc_id, unnest(range(i, i + 8)) AS p FROM g JOIN r USING (doc_id, k)) GROUP BY doc_id),
a AS (
  SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
  FROM d LEFT JOIN line USING (doc_id) LEFT JOIN h USING (doc_id)
), b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * n_lost_words <= {MAX_LOST_PCT} * n_words AS kept FROM b
"""


@register("op9_quality_lines", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    out = quality(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "n_lost_words")


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (k) WHERE f.first < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
r AS (
  SELECT x.doc_id, count(h.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE h.p IS NULL) AS kept
  FROM x LEFT JOIN h ON h.doc_id = x.doc_id AND h.p = x.p GROUP BY x.doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


@register("op10_substring_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op11_simhash_groups")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


_LATER = "lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{edit}'"


def _later(x: str, cost: str, edit: str) -> str:
    """SQL: a state (nine digits of cost, then its edits) after one more edit."""
    return _LATER.format(x=x, cost=cost, edit=edit)


# the states after a row, then after insertions; null: not reached
OP12_SQL = rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda h, c: list_reduce(list_prepend(xor(h, c), list_transform(range(8), lambda z: CAST(z AS BIGINT))), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 20 AS fault
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM o WHERE fault <> 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END AS c, regexp_replace(text, '[ 	-
]+$', '') AS bare
  FROM d
), f AS (
  SELECT *, bare = '' AS blank, bare <> '' AND seen > 1 AS dup, bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
    coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM r
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
    count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id
), v AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, '000000003I' AS u, '000000006II' AS a FROM n
  UNION ALL
  SELECT conv_id, i, z, s, u, least(a, {_later("u", "3", "I")}) FROM (
    SELECT conv_id, i, z, s, least(u, {_later("z", "3", "I")}, {_later("s", "3", "I")}, {_later("a", "3", "I")}) AS u, a FROM (
      SELECT v.conv_id, f.i, {_later("z", "4", "D")} AS z,
        least({_later("s", "4", "D")}, CASE WHEN NOT (blank OR dup) AND c = 's' THEN {_later("z", "3 * CAST(cut AS INT)", "K")} END) AS s,
        least({_later("u", "4", "D")}, CASE WHEN NOT (blank OR dup) THEN least({_later("least(z, s, a)", "3 + 3 * CAST(cut AS INT)", "R")}, CASE WHEN c = 'u' THEN {_later("least(z, s, a)", "3 * CAST(cut AS INT)", "K")} END) END) AS u,
        least({_later("a", "4", "D")}, CASE WHEN NOT (blank OR dup) THEN least({_later("u", "3 + 3 * CAST(cut AS INT)", "R")}, CASE WHEN c = 'a' THEN {_later("u", "3 * CAST(cut AS INT)", "K")} END) END) AS a
      FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1
    )
  )
), best AS (
  SELECT n.conv_id, CAST(substr(least(z, a), 1, 9) AS BIGINT) AS cost, substr(least(z, a), 10) AS audit FROM n JOIN v ON v.conv_id IS NOT DISTINCT FROM n.conv_id AND v.i = n.n
), e AS (
  SELECT conv_id, k, audit[k] AS edit, len(replace(audit[:k], 'I', '')) AS i, len(replace(audit[:k], 'D', '')) AS p, len(replace(audit, 'D', '')) % 2 AS leads
  FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS k FROM best)
), t AS (
  SELECT e.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (p + leads) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS text
  FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE edit <> 'D' GROUP BY e.conv_id
)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM x.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM x.conv_id
"""


@register("op12_conversation_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair_conversations, text_digests

    rows = table(spark, sf_dir, "conversations")
    report, turns = repair_conversations(damaged(rows))
    out = rows.select("conv_id").distinct()
    for found in (report, text_digests(turns)):
        found = found.withColumnRenamed("conv_id", "same")
        out = out.join(found, F.col("conv_id").eqNullSafe(F.col("same")), "left").drop("same")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import align

    path = public_tokenizers.path
    return align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
