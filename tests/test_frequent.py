"""Frequent items from a sketch with an exact recount; character histograms per batch."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from promptlake.operators import tokens as K


def _rows(r, skewed):
    pieces = [f"w{int(r.paretovariate(0.9)) if skewed else r.randrange(3000)}" for _ in range(30_000)]
    return [" ".join(pieces[i : i + 50]) for i in range(0, len(pieces), 50)] + ["", "  a  a ", None]


@pytest.mark.parametrize(("skewed", "tracked"), [(True, 1 << 12), (False, 1 << 9)])
def test_top_equals_counting_all(spark, monkeypatch, skewed, tracked):
    texts = _rows(random.Random(5), skewed)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    counted = []
    monkeypatch.setattr(K, "piece_counts", lambda *a: counted.append(a) or _all(*a))
    want = sorted(((-n, w) for w, n in Counter(w for t in texts if t for w in t.split(" ") if w).items()))[:20]
    got = K.top_counts(df, 20, tracked=tracked).orderBy(F.desc("count"), "piece").limit(20).collect()
    assert [(-r["count"], r.piece) for r in got] == want
    assert bool(counted) == (not skewed)  # only a flat distribution falls back to counting all pieces


def _all(df, text):
    return K.pieces_of(df, text).groupBy("piece").count()


def test_candidates_alone_are_counted(spark, monkeypatch):
    from promptlake import session

    texts = _rows(random.Random(6), True)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    sizes, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda d, name="stage": sizes.append(cut(d, name)) or sizes[-1])
    K.top_counts(df, 10, tracked=1 << 12)
    assert len(sizes) == 1 and sizes[0].count() <= 10 * K.CANDIDATES


def test_fewer_pieces_than_asked_for_and_empty_tables(spark):
    df = spark.createDataFrame([("a b a",), (None,)], "text string")
    assert sorted(map(tuple, K.top_counts(df, 10).collect())) == [("a", 2), ("b", 1)]
    assert K.build_vocab(df.limit(0), 5).count() == 0 and K.char_coverage(df.limit(0)).count() == 0


def test_characters(spark):
    texts = ["aab\n", "é😀a", None, "", "b"]
    got = {r.ch: r["count"] for r in K.char_coverage(spark.createDataFrame([(t,) for t in texts], "text string"), 1.0).collect()}
    assert got == Counter("".join(t or "" for t in texts))
