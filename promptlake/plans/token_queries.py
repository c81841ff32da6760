"""Registered queries: tokenisation, padding, masks, decoding and feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dialogue import dialogue_pairs
from ..operators.ranking import batch_ids
from ..operators.templates import nonempty_pairs
from ..operators.tokens import (
    append_eos,
    attention_mask,
    build_vocab,
    byte_tokens,
    byte_tokens_arrow,
    causal_attention,
    char_coverage,
    decode_bytes,
    dynamic_pad,
    ids_text,
    mask_labels,
    non_padding,
    pad_to,
    pad_up,
    prefix_concat,
    shift_right,
    unmask_labels,
    vocab_tokenize,
)
from ..sources.tables import read
from .registry import register
from .sqlparts import U

# Feature lengths (inputs / targets) and the generation length.
INPUT_LEN = 1024
TARGET_LEN = 256
VOCAB_SIZE = 1000


def BYTES(x: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::INTEGER + 3)"


def S(x: str) -> str:
    return f"array_to_string({x}, ' ')"


_PAIRS_SQL = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS inputs, a.text AS targets
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 0 AND length(a.text) > 0)"""


def _pairs(spark, sf_dir):
    return nonempty_pairs(dialogue_pairs(read(spark, sf_dir, "conversations")))


def _tok_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "turn", byte_tokens("inputs").alias("i"), append_eos(byte_tokens("targets")).alias("t"))


_TOK_SQL = f"""{_PAIRS_SQL},
  tp AS (SELECT conv_id, turn, {BYTES('inputs')} AS i, list_concat({BYTES('targets')}, [1]) AS t FROM pairs)"""


@register("tokenize_bytes", f"SELECT doc_id, {S(BYTES('text'))} AS ids FROM documents")
def q_tokenize_bytes(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", ids_text(byte_tokens_arrow("text")).alias("ids"))


@register("append_eos", f"WITH {_TOK_SQL} SELECT conv_id, turn, {S('i')} AS inputs, {S('t')} AS targets FROM tp")
def q_append_eos(spark, sf_dir):
    t = _tok_pairs(spark, sf_dir)
    return t.select("conv_id", "turn", ids_text("i").alias("inputs"), ids_text("t").alias("targets"))


@register(
    "pad_truncate",
    f"""WITH {_TOK_SQL}
        SELECT conv_id, turn, {S(f'list_resize(i, {INPUT_LEN}, 0)')} AS inputs, {S(f'list_resize(t, {TARGET_LEN}, 0)')} AS targets FROM tp""",
)
def q_pad_truncate(spark, sf_dir):
    t = _tok_pairs(spark, sf_dir)
    return t.select(
        "conv_id", "turn", ids_text(pad_to("i", INPUT_LEN)).alias("inputs"), ids_text(pad_to("t", TARGET_LEN)).alias("targets")
    )


@register(
    "attention_mask",
    f"""WITH {_TOK_SQL}
        SELECT conv_id, turn, {S(f'list_transform(list_resize(i, greatest(len(i), {INPUT_LEN}), 0), lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)')} AS mask FROM tp""",
)
def q_attention_mask(spark, sf_dir):
    t = _tok_pairs(spark, sf_dir)
    return t.select("conv_id", "turn", ids_text(attention_mask(pad_up("i", INPUT_LEN))).alias("mask"))


@register(
    "mask_labels",
    f"""WITH {_TOK_SQL}
        SELECT conv_id, turn, {S(f'list_transform(list_resize(t, greatest(len(t), {TARGET_LEN}), 0), lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels FROM tp""",
)
def q_mask_labels(spark, sf_dir):
    t = _tok_pairs(spark, sf_dir)
    return t.select("conv_id", "turn", ids_text(mask_labels(pad_up("t", TARGET_LEN))).alias("labels"))


@register(
    "unmask_labels",
    f"""WITH {_TOK_SQL}
        SELECT conv_id, turn, {S(f'list_resize(t, greatest(len(t), {TARGET_LEN}), 0)')} AS labels FROM tp""",
)
def q_unmask_labels(spark, sf_dir):
    t = _tok_pairs(spark, sf_dir)
    return t.select("conv_id", "turn", ids_text(unmask_labels(mask_labels(pad_up("t", TARGET_LEN)))).alias("labels"))


@register("decode_roundtrip", "SELECT doc_id, text AS decoded FROM documents")
def q_decode_roundtrip(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", decode_bytes(append_eos(byte_tokens("text"))).alias("decoded"))


@register(
    "loss_weights",
    f"""WITH {_TOK_SQL}
        SELECT conv_id, turn, {S(f'list_transform(list_resize(t, greatest(len(t), {TARGET_LEN}), 0), lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)')} AS weights FROM tp""",
)
def q_loss_weights(spark, sf_dir):
    t = _tok_pairs(spark, sf_dir)
    return t.select("conv_id", "turn", ids_text(non_padding(pad_up("t", TARGET_LEN))).alias("weights"))


@register(
    "shift_right",
    f"""WITH {_TOK_SQL}, p AS (SELECT conv_id, turn, list_resize(t, greatest(len(t), {TARGET_LEN}), 0) AS t FROM tp)
        SELECT conv_id, turn, {S(f'list_concat([0], t[1:len(t) - 1])')} AS decoder_inputs FROM p""",
)
def q_shift_right(spark, sf_dir):
    t = _tok_pairs(spark, sf_dir)
    return t.select("conv_id", "turn", ids_text(shift_right(pad_up("t", TARGET_LEN))).alias("decoder_inputs"))


@register(
    "prefix_concat",
    f"""WITH {_TOK_SQL}
        SELECT conv_id, turn, {S('list_concat(i, t)')} AS targets,
               {S('list_transform(range(len(i) + len(t)), lambda x: len(i))')} AS inputs_width,
               {S('list_transform(range(len(i) + len(t)), lambda x: len(i) + 1)')} AS inputs_width_add_pos
        FROM tp""",
)
def q_prefix_concat(spark, sf_dir):
    t = _tok_pairs(spark, sf_dir)
    tg, w, w1 = prefix_concat("i", "t")
    return t.select("conv_id", "turn", ids_text(tg).alias("targets"), ids_text(w).alias("inputs_width"), ids_text(w1).alias("inputs_width_add_pos"))


@register(
    "pad_dynamic",
    f"""WITH {_TOK_SQL},
        b AS (SELECT *, (row_number() OVER (ORDER BY {U("'7'", "conv_id || ':' || turn")}, conv_id || ':' || turn) - 1) // 32 AS batch FROM tp),
        m AS (SELECT *, CAST(ceil(max(len(i)) OVER (PARTITION BY batch) / 8.0) * 8 AS INTEGER) AS batch_len FROM b)
        SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch, batch_len, {S('list_resize(i, batch_len, 0)')} AS padded FROM m""",
)
def q_pad_dynamic(spark, sf_dir):
    t = _tok_pairs(spark, sf_dir).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    b = batch_ids(t, 7, "key", 32)
    p = dynamic_pad(b, "i", "batch", 8)
    return p.select("conv_id", "turn", "batch", "batch_len", ids_text("padded").alias("padded"))


# The three model kinds of the generation feature rows.
MODEL_TYPES = ["c_dec", "nc_dec", "enc_dec"]


@register(
    "generation_rows",
    f"""WITH b AS (SELECT item_id, {BYTES('text')} AS ids FROM benchmark),
        n AS (SELECT max(len(ids)) + 1 AS n FROM b),
        m AS (SELECT * FROM (VALUES ('c_dec'), ('nc_dec'), ('enc_dec')) v(model_type)),
        x AS (SELECT b.item_id, b.ids, m.model_type, n.n FROM b CROSS JOIN m CROSS JOIN n)
        SELECT item_id, model_type,
          CASE WHEN model_type = 'enc_dec' THEN {S('ids')} END AS encoder_input_tokens,
          CASE WHEN model_type = 'enc_dec' THEN {S('list_resize([0], n, 0)')}
               ELSE {S('list_resize(ids, n, 0)')} END AS decoder_target_tokens,
          CASE WHEN model_type = 'enc_dec' THEN {S('list_resize([0], n, 0)')}
               ELSE {S('list_concat([0], list_resize(ids, n, 0)[1:n - 1])')} END AS decoder_input_tokens,
          CASE WHEN model_type = 'enc_dec' THEN NULL
               ELSE {S('list_transform(range(n), lambda p: CASE WHEN p < len(ids) + 1 THEN 1 ELSE 0 END)')} END AS decoder_causal_attention,
          CASE WHEN model_type = 'enc_dec' THEN {S('list_resize([0], n, 0)')} END AS decoder_loss_weights
        FROM x""",
)
def q_generation_rows(spark, sf_dir):
    from ..operators.features import generation_rows, longest

    b = read(spark, sf_dir, "benchmark").select("item_id", byte_tokens("text").alias("ids"))
    g = generation_rows(b, "ids", MODEL_TYPES, longest(b, "ids") + 1)
    cols = ["encoder_input_tokens", "decoder_target_tokens", "decoder_input_tokens", "decoder_causal_attention", "decoder_loss_weights"]
    return g.select("item_id", "model_type", *[ids_text(c).alias(c) for c in cols])


_VOCAB_SQL = f"""pc AS (SELECT piece, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS piece FROM documents) WHERE piece <> '' GROUP BY piece),
  vocab AS (SELECT piece, count, CAST(row_number() OVER (ORDER BY count DESC, piece) + 258 AS INTEGER) AS id
            FROM pc ORDER BY count DESC, piece LIMIT {VOCAB_SIZE})"""


@register("vocab_topk", f"WITH {_VOCAB_SQL} SELECT piece, count, id FROM vocab")
def q_vocab_topk(spark, sf_dir):
    return build_vocab(read(spark, sf_dir, "documents"), VOCAB_SIZE).select("piece", "count", "id")


@register(
    "tokenize_vocab",
    f"""WITH {_VOCAB_SQL},
        w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS piece, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
        j AS (SELECT w.doc_id, w.pos,
                     list_concat(CASE WHEN w.pos > 0 THEN [35] ELSE [] END,
                                 CASE WHEN v.id IS NOT NULL THEN [v.id] ELSE {BYTES('w.piece')} END) AS p
              FROM w LEFT JOIN vocab v ON v.piece = w.piece)
        SELECT doc_id, {S('flatten(list(p ORDER BY pos))')} AS ids FROM j GROUP BY doc_id""",
)
def q_tokenize_vocab(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    v = build_vocab(d, VOCAB_SIZE)
    t = vocab_tokenize(d, v, "doc_id")
    return t.select("doc_id", ids_text("ids").alias("ids"))


@register(
    "char_coverage",
    """WITH ch AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents),
        c AS (SELECT ch, count(*) AS count FROM ch GROUP BY ch),
        w AS (SELECT ch, count, sum(count) OVER (ORDER BY count DESC, ch ROWS UNBOUNDED PRECEDING) AS cum, sum(count) OVER () AS total FROM c)
        SELECT ch, count FROM w WHERE cum - count < 0.99999 * total""",
)
def q_char_coverage(spark, sf_dir):
    return char_coverage(read(spark, sf_dir, "documents")).select("ch", "count")
