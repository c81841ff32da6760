"""Registered queries: LM segments, prefix-LM packing, next-fit packing, span split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.packing import lm_segments_text, lm_split, pack_examples, pack_prefix_lm
from ..operators.tokens import byte_tokens, ids_text, ids_text_arrow
from ..sources.tables import read
from .registry import register
from .sqlparts import U
from .token_queries import BYTES, S

# LM adaptation sequence length, row length and shard size of example packing.
LM_LEN = 512
PACK_LEN = 512
PACK_SHARD_TOKENS = 1 << 18


def _segments(spark, sf_dir, arrow=False):
    d = read(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return lm_segments_text(d, "lang", "doc_id", "text", LM_LEN, arrow=arrow)


_SEG_SQL = f"""t AS (SELECT lang, doc_id, {BYTES('text')} AS toks FROM documents),
  c AS (SELECT lang, doc_id, list_concat(toks, [1]) AS chunk FROM t),
  s AS (SELECT *, len(chunk) AS len,
               CAST(COALESCE(sum(len(chunk)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM c),
  p AS (SELECT lang, seg, greatest(start - seg * {LM_LEN}, 0) AS off,
               chunk[greatest(seg * {LM_LEN} - start, 0) + 1 : least((seg + 1) * {LM_LEN} - start, len)] AS toks
        FROM (SELECT *, unnest(range(start // {LM_LEN}, (start + len - 1) // {LM_LEN} + 1)) AS seg FROM s)),
  segs AS (SELECT lang, seg, flatten(list(toks ORDER BY off)) AS tokens FROM p GROUP BY lang, seg)"""


@register("lm_segments", f"WITH {_SEG_SQL} SELECT lang, CAST(seg AS BIGINT) AS seg, {S('tokens')} AS tokens FROM segs")
def q_lm_segments(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return s.select("lang", F.col("seg").cast("long").alias("seg"), ids_text("tokens").alias("tokens"))


def _pack_sql() -> str:
    L = LM_LEN
    return f"""WITH {_SEG_SQL},
      a AS (SELECT lang, seg // 2 AS pair, list_resize(tokens, {L}, 0) AS a FROM segs WHERE seg % 2 = 0),
      b AS (SELECT lang, (seg - 1) // 2 AS pair, list_resize(tokens, {L}, 0) AS b FROM segs WHERE seg % 2 = 1),
      j AS (SELECT a.lang, a.pair, a.a, coalesce(b.b, list_resize([]::INTEGER[], {L}, 0)) AS b,
                   CAST(1 + floor({U("'prefix'", "a.lang || ':' || a.pair")} * {L - 1}) AS INTEGER) AS m
            FROM a LEFT JOIN b ON a.lang = b.lang AND a.pair = b.pair),
      f AS (SELECT lang, pair, m, list_concat(a[1:m], b[1:{L} - m]) AS enc, list_concat(a[m + 1:{L}], b[{L} - m + 1:{L}]) AS dec FROM j)
    SELECT lang, CAST(pair AS BIGINT) AS pair, m,
           {S('enc')} AS encoder_input_tokens,
           {S('dec')} AS decoder_target_tokens,
           {S(f'list_transform(range({L}), lambda i: CASE WHEN i = 0 OR i = {L} - m THEN 0 ELSE dec[i] END)')} AS decoder_input_tokens,
           {S(f'list_transform(range({L}), lambda i: CASE WHEN i < m THEN 1 ELSE 2 END)')} AS encoder_segment_ids,
           {S(f'list_concat(range(m), range({L} - m))')} AS encoder_positions,
           {S(f'list_transform(range({L}), lambda i: CASE WHEN i < {L} - m THEN 1 ELSE 2 END)')} AS decoder_segment_ids,
           {S(f'list_concat(range({L} - m), range(m))')} AS decoder_positions,
           {S('list_transform(dec, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)')} AS decoder_loss_weights
    FROM f"""


@register("pack_prefix_lm", _pack_sql())
def q_pack_prefix_lm(spark, sf_dir):
    p = pack_prefix_lm(_segments(spark, sf_dir, arrow=True), "lang", LM_LEN)
    arrays = [
        "encoder_input_tokens",
        "decoder_target_tokens",
        "decoder_input_tokens",
        "encoder_segment_ids",
        "encoder_positions",
        "decoder_segment_ids",
        "decoder_positions",
        "decoder_loss_weights",
    ]
    return p.select("lang", "pair", "m", *[ids_text_arrow(c).alias(c) for c in arrays])


@register(
    "lm_split",
    f"""WITH t AS (SELECT doc_id, list_concat({BYTES('text')}, [1]) AS toks FROM documents),
        m AS (SELECT doc_id, toks, CAST(1 + floor({U("'split'", 'doc_id')} * (len(toks) - 1)) AS INTEGER) AS m FROM t WHERE len(toks) >= 2)
        SELECT doc_id, m, {S('toks[1:m]')} AS inputs, {S('toks[m + 1:len(toks)]')} AS targets FROM m""",
)
def q_lm_split(spark, sf_dir):
    from ..operators.tokens import append_eos

    d = read(spark, sf_dir, "documents").select("doc_id", append_eos(byte_tokens("text")).alias("toks"))
    d = d.where(F.size("toks") >= 2)
    i, t, m = lm_split(F.col("toks"), F.col("doc_id"))
    return d.select("doc_id", m.alias("m"), ids_text(i).alias("inputs"), ids_text(t).alias("targets"))


def _pack_examples_sql() -> str:
    L = PACK_LEN
    return f"""WITH RECURSIVE r AS (
        SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS key, {BYTES('text')} AS toks FROM conversations WHERE strlen(text) > 0),
      n AS (SELECT greatest(1, CAST(ceil(sum(len(toks)) / {PACK_SHARD_TOKENS}.0) AS BIGINT)) AS shards FROM r),
      p AS (SELECT CAST(floor({U("'pack'", 'key')} * shards) AS BIGINT) AS shard, key, toks,
                   unnest(range(CAST(ceil(len(toks) / {L}.0) AS BIGINT))) AS piece FROM r, n),
      q AS (SELECT shard, key, piece, toks[piece * {L} + 1 : (piece + 1) * {L}] AS toks,
                   row_number() OVER (PARTITION BY shard ORDER BY key, piece) AS i FROM p),
      fit(shard, i, bin, used) AS (
        SELECT shard, i, CAST(0 AS BIGINT), CAST(len(toks) AS BIGINT) FROM q WHERE i = 1
        UNION ALL
        SELECT q.shard, q.i, CASE WHEN used + len(toks) > {L} THEN bin + 1 ELSE bin END,
               CASE WHEN used + len(toks) > {L} THEN len(toks) ELSE used + len(toks) END
        FROM fit JOIN q ON q.shard = fit.shard AND q.i = fit.i + 1),
      s AS (SELECT q.*, bin, row_number() OVER (PARTITION BY q.shard, bin ORDER BY q.i) AS seg FROM q JOIN fit USING (shard, i))
    SELECT shard, bin, string_agg(key, ' ' ORDER BY i) AS keys, string_agg(CAST(piece AS VARCHAR), ' ' ORDER BY i) AS pieces,
           {S('flatten(list(toks ORDER BY i))')} AS tokens,
           {S('flatten(list(list_transform(toks, lambda t: seg) ORDER BY i))')} AS segment_ids,
           {S('flatten(list(range(len(toks)) ORDER BY i))')} AS positions
    FROM s GROUP BY shard, bin"""


@register("pack_examples", _pack_examples_sql())
def q_pack_examples(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = c.select(key.alias("key"), byte_tokens("text").alias("toks")).where(F.size("toks") > 0)
    p = pack_examples(rows, "key", "toks", PACK_LEN, PACK_SHARD_TOKENS)
    return p.select("shard", "bin", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("keys", "pieces", "tokens", "segment_ids", "positions")])
