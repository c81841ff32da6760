"""Registered queries: subword merges over the word types, longest-match tokens and their decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.subwords import subword_decode, subword_merges, subword_tokenize, subword_vocab
from ..operators.tokens import FIRST_PIECE_ID, ids_text
from ..sources.tables import read
from .registry import register
from .token_queries import BYTES, S

# Merges learnt and the share of character occurrences that are pieces.
MERGES = 64
COVERAGE = 0.99999

_MERGES_SQL = f"""ch AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents),
  cc AS (SELECT ch, count(*) AS count FROM ch GROUP BY ch),
  cw AS (SELECT ch, count, sum(count) OVER (ORDER BY count DESC, ch ROWS UNBOUNDED PRECEDING) AS cum, sum(count) OVER () AS total FROM cc),
  kept AS (SELECT ch, count FROM cw WHERE cum - count < {COVERAGE} * total AND ch <> ' '),
  bad AS (SELECT coalesce(string_agg(ch, ''), '') AS b FROM cc WHERE ch <> ' ' AND ch NOT IN (SELECT ch FROM kept)),
  w0 AS (SELECT regexp_replace(piece, '(.)', ' \\1 ', 'gs') AS w, n
         FROM (SELECT piece, count(*) AS n
               FROM (SELECT unnest(string_split(translate(text, b, repeat(' ', length(b))), ' ')) AS piece FROM documents, bad)
               WHERE piece <> '' GROUP BY piece)),
  s(step, w, n, l, r, c) AS (
    SELECT 0, w, n, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS HUGEINT) FROM w0
    UNION ALL
    SELECT s.step + 1, replace(s.w, ' ' || p.l || '  ' || p.r || ' ', ' ' || p.l || p.r || ' '), s.n, p.l, p.r, p.c
    FROM s, (SELECT x[1] AS l, x[2] AS r, sum(n) AS c
             FROM (SELECT unnest(list_zip(t[:-2], t[2:])) AS x, n
                   FROM (SELECT string_split(trim(w, ' '), '  ') AS t, n FROM s) WHERE len(t) > 1)
             GROUP BY 1, 2 HAVING sum(n) >= 2 ORDER BY c DESC, l, r LIMIT 1) p
    WHERE s.step < {MERGES}),
  merges AS (SELECT step, l AS "left", r AS "right", l || r AS piece, any_value(c) AS count FROM s WHERE step > 0 GROUP BY step, l, r)"""


def _learn(spark, sf_dir):
    return subword_merges(read(spark, sf_dir, "documents"), MERGES, COVERAGE)


@register("vocab_merges", f"WITH RECURSIVE {_MERGES_SQL} SELECT step, \"left\", \"right\", piece, CAST(count AS BIGINT) AS count FROM merges")
def q_vocab_merges(spark, sf_dir):
    return _learn(spark, sf_dir)[1]


# Longest match over distinct words, one piece a step; a character that is no piece becomes its bytes.
_TOKENS_SQL = f"""{_MERGES_SQL},
  pieces AS (SELECT ch AS piece, 0 AS step, count FROM kept UNION ALL SELECT piece, step, 0 FROM merges),
  vocab AS (SELECT piece, row_number() OVER (ORDER BY step, count DESC, piece) + {FIRST_PIECE_ID - 1} AS id
            FROM (SELECT piece, min(step) AS step, max(count) AS count FROM pieces GROUP BY piece)),
  widths AS (SELECT DISTINCT length(piece) AS len FROM vocab),
  docs AS (SELECT doc_id, unnest(string_split(text, ' ')) AS piece, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
  types AS (SELECT DISTINCT piece FROM docs WHERE piece <> ''),
  m(piece, rest, k, ids) AS (
    SELECT piece, piece, 0, CAST([] AS INTEGER[]) FROM types
    UNION ALL
    SELECT piece, substr(rest, coalesce(len, 1) + 1), k + 1,
           CASE WHEN len IS NULL THEN {BYTES('left(rest, 1)')} ELSE [id] END
    FROM (SELECT m.piece, m.rest, m.k, max(length(v.piece)) AS len, CAST(arg_max(v.id, length(v.piece)) AS INTEGER) AS id
          FROM m CROSS JOIN widths LEFT JOIN vocab v ON v.piece = substr(m.rest, 1, widths.len)
          WHERE m.rest <> '' GROUP BY m.piece, m.rest, m.k)),
  coded AS (SELECT piece, flatten(list(ids ORDER BY k)) AS ids FROM m GROUP BY piece),
  j AS (SELECT d.doc_id, d.pos, list_concat(CASE WHEN d.pos > 0 THEN [35] ELSE [] END, coalesce(c.ids, [])) AS p
        FROM docs d LEFT JOIN coded c ON c.piece = d.piece)"""


@register("tokenize_subwords", f"WITH RECURSIVE {_TOKENS_SQL} SELECT doc_id, {S('flatten(list(p ORDER BY pos))')} AS ids FROM j GROUP BY doc_id")
def q_tokenize_subwords(spark, sf_dir):
    t = subword_tokenize(read(spark, sf_dir, "documents"), subword_vocab(*_learn(spark, sf_dir)), "doc_id")
    return t.select("doc_id", ids_text("ids").alias("ids"))


@register("subword_roundtrip", "SELECT doc_id, text AS decoded FROM documents")
def q_subword_roundtrip(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    vocab = subword_vocab(*_learn(spark, sf_dir))
    back = subword_decode(subword_tokenize(d, vocab, "doc_id"), vocab, "doc_id")
    return back.select("doc_id", F.col("text").alias("decoded"))
