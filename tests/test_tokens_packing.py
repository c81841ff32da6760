"""Token jobs and packing: round trips and invariants."""

import random

from promptlake.operators.packing import lm_segments, pack_examples, pack_prefix_lm
from promptlake.operators.tokens import (
    append_eos,
    attention_mask,
    byte_tokens,
    decode_bytes,
    mask_labels,
    pad_to,
    shift_right,
    unmask_labels,
    vocab_tokenize,
)

TEXTS = ["", "a", "héllo wörld", "中文 😀 tab\tnew\nline", "x" * 300]


def test_byte_roundtrip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    r = df.select("id", "text", byte_tokens("text").alias("ids")).select("id", "text", "ids", decode_bytes(append_eos("ids")).alias("back"))
    for row in r.collect():
        assert row.back == row.text
        assert row.ids == [b + 3 for b in row.text.encode("utf-8")]


def test_pad_mask_unmask_shift(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],), ([5, 6, 7, 8, 9],)], "ids array<int>")
    r = df.select(
        pad_to("ids", 4).alias("p"),
        attention_mask(pad_to("ids", 4)).alias("m"),
        mask_labels(pad_to("ids", 4)).alias("l"),
        unmask_labels(mask_labels(pad_to("ids", 4))).alias("u"),
        shift_right(pad_to("ids", 4)).alias("s"),
    ).collect()
    assert r[0].p == [5, 6, 7, 0] and r[0].m == [1, 1, 1, 0] and r[0].l == [5, 6, 7, -100] and r[0].u == [5, 6, 7, 0]
    assert r[1].p == [0, 0, 0, 0] and r[2].p == [5, 6, 7, 8] and r[0].s == [0, 5, 6, 7]
    seg = spark.createDataFrame([([5, 6, 7, 8], [1, 1, 2, 2])], "t array<int>, s array<int>")
    assert seg.select(shift_right("t", "s").alias("x")).first().x == [0, 5, 0, 7]


def test_vocab_fallback(spark):
    vocab = spark.createDataFrame([("the", 300)], "piece string, id int")
    df = spark.createDataFrame([(1, "the cat")], "doc_id long, text string")
    ids = vocab_tokenize(df, vocab, "doc_id").first().ids
    assert ids == [300, ord(" ") + 3] + [b + 3 for b in b"cat"]


def _next_fit(lens, L):
    bins, cur, used = [], [], 0
    for i, n in lens:
        n = min(n, L)
        if used + n > L and used > 0:
            bins.append(cur)
            cur, used = [], 0
        cur.append(i)
        used += n
    if cur:
        bins.append(cur)
    return bins


def test_pack_examples(spark):
    """Next-fit per hashed shard; a sequence longer than a row becomes pieces, nothing is cut off."""
    import hashlib

    rnd = random.Random(5)
    rows = [(i, [rnd.randrange(3, 200) for _ in range(rnd.choice([1, 7, 30, 64, 65, 200]))]) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, toks array<int>")
    L, per = 64, 4000
    S = -(-sum(len(t) for _, t in rows) // per)
    packed = pack_examples(df, "key", "toks", L, per).collect()
    assert all(len(p.tokens) <= L and len(p.segment_ids) == len(p.tokens) == len(p.positions) for p in packed)
    toks = {str(k): t for k, t in rows}
    got = {}
    for p in packed:
        at = 0
        for k, piece in zip(p.keys, p.pieces, strict=True):
            n = min(L, len(toks[k]) - piece * L)
            got[k, piece] = p.tokens[at : at + n]
            at += n
        assert at == len(p.tokens)
    assert got == {(k, i): t[i * L : (i + 1) * L] for k, t in toks.items() for i in range(-(-len(t) // L))}
    shard = lambda k: int(int(hashlib.md5(f"pack:{k}".encode()).hexdigest()[:8], 16) / 2**32 * S)
    want = set()
    for s in range(S):
        own = sorted(x for x in got if shard(x[0]) == s)
        want |= {(s, tuple(b)) for b in _next_fit([(x, len(got[x])) for x in own], L)}
    assert {(p.shard, tuple(zip(p.keys, p.pieces, strict=True))) for p in packed} == want


def test_odd_last_segment_is_padded(spark):
    segs = spark.createDataFrame([("a", i, [10 + i] * 8) for i in range(3)], "lang string, seg long, tokens array<int>")
    p = {r.pair: r for r in pack_prefix_lm(segs, "lang", 8).collect()}
    assert set(p) == {0, 1}
    last = p[1]
    assert last.encoder_input_tokens[: last.m] == [12] * last.m and set(last.encoder_input_tokens[last.m :]) <= {0}
    assert last.decoder_target_tokens == [12] * (8 - last.m) + [0] * last.m
    assert last.decoder_loss_weights == [1] * (8 - last.m) + [0] * last.m


def test_long_document_is_kept_whole(spark):
    from promptlake.operators.packing import lm_segments_text

    rows = [("x", 1, "ab" * 40_000), ("x", 2, "c")]
    segs = lm_segments_text(spark.createDataFrame(rows, "lang string, doc_id long, text string"), "lang", "doc_id", "text", 512).orderBy("seg").collect()
    stream = [t for s in segs for t in s.tokens]
    assert stream == [b + 3 for b in b"ab" * 40_000] + [1] + [ord("c") + 3, 1]


def test_arrow_tokenisers_equal_expressions(spark):
    from promptlake.operators.tokens import byte_tokens_arrow, pad_up

    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "  two  gaps ", " "])]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    for r in df.select(byte_tokens("text").alias("a"), byte_tokens_arrow("text").alias("b")).collect():
        assert r.a == r.b
    vocab = spark.createDataFrame([("two", 300), ("x" * 300, 301)], "piece string, id int")
    got = {r.id: r.ids for r in vocab_tokenize(df, vocab, "id").collect()}
    table = {"two": [300], "x" * 300: [301]}
    for i, t in rows:
        want = None
        if t is not None:
            parts = [table.get(p, [b + 3 for b in p.encode()]) for p in t.split(" ")]
            want = parts[0] + [x for p in parts[1:] for x in [35, *p]]
        assert got[i] == want
    assert spark.createDataFrame([([5] * 6,), ([5],)], "ids array<int>").select(pad_up("ids", 4).alias("p")).collect()[0].p == [5] * 6


def test_long_prompt_sets_the_row_length(spark):
    from promptlake.operators.features import generation_rows, longest

    df = spark.createDataFrame([(1, "p" * 900), (2, "q")], "item_id long, text string").select("item_id", byte_tokens("text").alias("ids"))
    n = longest(df, "ids") + 1
    assert n == 901
    for r in generation_rows(df, "ids", ["c_dec", "enc_dec"], n).collect():
        if r.model_type == "c_dec":
            assert r.decoder_target_tokens[: len(r.ids)] == r.ids and len(r.decoder_target_tokens) == n
        else:
            assert r.encoder_input_tokens == r.ids


def test_segments_concatenate_stream(spark):
    rows = [("a", i, list(range(i * 10, i * 10 + 7 + i))) for i in range(12)] + [("b", 0, [1, 2, 3])]
    df = spark.createDataFrame(rows, "lang string, doc_id long, chunk array<int>")
    segs = lm_segments(df, "lang", "doc_id", 16).collect()
    for lang in ("a", "b"):
        stream = [t for _, _, c in sorted(r for r in rows if r[0] == lang) for t in c]
        got = [t for s in sorted((s for s in segs if s.lang == lang), key=lambda s: s.seg) for t in s.tokens]
        assert got == stream
        assert all(len(s.tokens) == 16 for s in segs if s.lang == lang and (s.seg + 1) * 16 <= len(stream))
    p = pack_prefix_lm(spark.createDataFrame([(r.lang, r.seg, r.tokens) for r in segs], "lang string, seg long, tokens array<int>"), "lang", 16).collect()
    for x in p:
        assert 1 <= x.m < 16 and len(x.encoder_input_tokens) == 16 and len(x.decoder_target_tokens) == 16
        assert x.encoder_segment_ids.count(1) == x.m and x.decoder_positions[0] == 0


def test_segments_from_text_equal_array_version(spark):
    from promptlake.operators.packing import doc_chunks, lm_segments_text

    rnd = random.Random(9)
    alphabet = "ab é中😀\n"
    rows = [("x" if i % 3 else "y", i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 90)))) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, text string")
    arr = lm_segments(doc_chunks(df.select("lang", "doc_id", byte_tokens("text").alias("toks")), "toks", "doc_id", 50), "lang", "doc_id", 32)
    txt = lm_segments_text(df, "lang", "doc_id", "text", 32, 50)
    assert sorted((r.lang, r.seg, tuple(r.tokens)) for r in arr.collect()) == sorted((r.lang, r.seg, tuple(r.tokens)) for r in txt.collect())
