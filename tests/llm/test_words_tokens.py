"""Helpers: words, tokenizer pieces, packing plan, bit packing, wavelet matrix and FM-index."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from promptlake.llm._words import Words, chunks, shingles
from promptlake.llm.bitpack import min_bits
from promptlake.llm.bitpack import pack as pack_bits
from promptlake.llm.bitpack import unpack
from promptlake.llm.fmindex import FMIndex
from promptlake.llm.packing import best_fit, plan
from promptlake.llm.tokens import encoder

ODD = ["", " ", "  a  b ", "a\n\nb", "don't  'tis\t x", "x\x1cy \x85z", "<|endoftext|> a<|endoftext|>b", "é é ΑΣ ΣΑ", "　a　 b", "12 34\t\t5", "ﬁ İ ß 👍🏽 a", "a\x00b c", "×÷ a× ÷b é. ù! Éa"]


def _random_texts(n=3000):
    r = random.Random(5)
    alphabet = "ab '\n\t .1é́\x1c\x1f​\x0b,s t<|endoftext|>  \nABÉ×÷\xa0ªß"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "space"), ("byte_bpe_50k.json", "byte")])
def test_pieces_equal_whole_texts(name, kind):
    path = public_tokenizers.path(name)
    texts = ODD + _random_texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = []
    for _, _, off, ids in encoder(path, kind)(pa.array(texts)):
        got += [ids[p:q].tolist() for p, q in zip(off[:-1], off[1:], strict=True)]
    assert got == want
    assert list(encoder(path, kind)(pa.array([], pa.string()))) == []
    ((_, _, off, ids),) = encoder(path, kind)(pa.array([None, ""], pa.string()))
    assert off.tolist() == [0, 0, 0] and len(ids) == 0


def test_words_and_shingles():
    texts = ["A b\tc d e  f", "", None, " \n", "é\xa0x é\xa0x", "a b c d e f", "b c", *_random_texts(300)]
    sets = []
    for a, b, buf, off in chunks(pa.array(texts), 64):
        w = Words(buf, off)
        for t, lo, hi in zip(texts[a:b], w.bounds[:-1], w.bounds[1:], strict=True):
            raw = buf.tobytes()
            assert [raw[p:q].decode() for p, q in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)] == re.findall("[^\x20\x09-\x0d]+", t or "")
        sets += list(shingles(w, 5))
    for t, s in zip(texts, sets, strict=True):
        x = re.findall("[^\x20\x09-\x0d]+", t or "")
        assert len(s) == len({tuple(x[i : i + 5]) for i in range(max(len(x) - 4, 1 if x else 0))})


def test_plan_places_every_length():
    r = np.random.default_rng(0)
    for size in (1, 2, 7, 30, 64):
        for _ in range(20):
            hist = np.zeros(size + 1, dtype=np.int64)
            hist[1:] = r.integers(0, 9, size) * r.integers(0, 2, size)
            for chosen in (best_fit(hist, size), plan(hist, size)):
                used = Counter()
                for content, n in chosen:
                    assert n > 0 and sum(content) <= size
                    for x in content:
                        used[x] += n
                assert all(used[x] == hist[x] for x in range(1, size + 1))
    lengths = np.minimum(1024, 1 + r.lognormal(5.5, 1, 5000).astype(int))
    hist = np.bincount(lengths, minlength=1025)
    assert sum(n for _, n in plan(hist, 1024)) <= 1.005 * lengths.sum() / 1024 + 1


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = pack_bits(ids, bits)
    assert len(data) == -(-1001 // 8) * bits
    assert (unpack(data, bits, 1001) == ids).all()
    assert (min_bits(49_408), min_bits(2), min_bits(1), min_bits(65_537)) == (16, 1, 1, 17)


def test_fm_index_counts():
    r = np.random.default_rng(2)
    lengths = r.integers(1, 12, 200)
    symbols = r.integers(-3, 4, int(lengths.sum()))
    index = FMIndex(symbols, lengths)
    segments = np.split(symbols, np.cumsum(lengths)[:-1])
    value = r.permutation(200)
    for k in (1, 2, 3):
        queries = [s[i : i + k] for s in segments for i in range(len(s) - k + 1)]
        flat = index.encode(np.concatenate(queries))
        lo, hi = index.search(flat, np.arange(1, len(queries) + 1) * k, k)
        least = index.least(lo, hi, value)
        for q, a, b, v in list(zip(queries, lo, hi, least, strict=True))[:150]:
            hits = [j for j, s in enumerate(segments) for i in range(len(s) - k + 1) if (s[i : i + k] == q).all()]
            assert b - a == len(hits) and v == min(value[j] for j in hits)


def test_fitted_plan_needs_no_more_than_best_fit():
    """The least-squares plan stands: on lengths of many shapes it is at or below plain best fit, and fits patterns."""
    r = np.random.default_rng(2)
    for k in range(6):
        lengths = np.clip(r.lognormal(5 + 0.3 * k, 1, 4000).astype(int), 1, 1024)
        hist = np.bincount(lengths, minlength=1025)
        chosen, alone = plan(hist, 1024), best_fit(hist, 1024)
        full = sum(n for c, n in chosen if sum(c) == 1024)
        assert sum(n for _, n in chosen) <= sum(n for _, n in alone) + 1 and full > 0.5 * sum(n for _, n in chosen)
        got = np.bincount([x for c, n in chosen for x in c], [n for c, n in chosen for _ in c], 1025)
        assert (got == hist).all()


def test_ranges_hold_equally_many_bytes():
    from promptlake.llm._files import byte_cuts

    r = np.random.default_rng(3)
    keys = r.permutation(20_000)
    sizes = np.where(keys < 5_000, 4_000, 100)  # a stretch of keys holds most of the bytes
    cuts = byte_cuts(keys, sizes, 16)
    held = np.bincount(np.searchsorted(cuts, keys, side="right"), sizes, 16)
    assert len(cuts) == 15 and held.max() < 1.1 * held.mean() and held.min() > 0.9 * held.mean()
    assert len(byte_cuts(keys[:0], sizes[:0], 4)) == 0 and (byte_cuts(np.array([7]), np.array([5]), 3) == 7).all()


def test_ranges_are_partitions_of_their_own(spark):
    from pyspark.sql import functions as F

    from promptlake.llm._files import range_shards

    df = spark.range(4000).select((F.col("id") * 17 % 4000).alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.lit("x" * 50)).alias("t")).repartition(6)
    out = range_shards(df, "k", F.octet_length("t"), 8_000).withColumn("p", F.spark_partition_id())
    shards = out.groupBy("shard").agg(F.countDistinct("p").alias("parts"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("shard").collect()
    assert len(shards) > 15 and all(s.parts == 1 for s in shards) and out.select("p").distinct().count() == len(shards)
    assert sum(s.n for s in shards) == 4000 and all(a.hi < b.lo for a, b in zip(shards[:-1], shards[1:], strict=True))
