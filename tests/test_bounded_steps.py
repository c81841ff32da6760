"""Array jobs work on bounded steps of an Arrow batch, whatever its rows hold."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
from promptlake.operators import tokens as K

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# F12
def test_bytes_are_cut_without_patterns(spark):
    texts = ["", None, "a", "é\0x", "日本 \n", "".join(map(chr, range(0x3000))), "\U0001f600"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("t", K.byte_tokens("t").alias("b"), K.decode_bytes(K.append_eos(K.byte_tokens("t"))).alias("d")).collect():
        assert r.d == r.t and r.b == (None if r.t is None else [x + 3 for x in r.t.encode()])
    plan = _plan(E.queries()["decode_roundtrip"](spark, SF_SMALL))
    assert not any(x in plan for x in ("regexp_extract_all", "conv(", "lpad("))


# F8
def test_texts_are_turned_into_ids_in_steps(spark):
    rows = spark.createDataFrame([(i, "x" * 100_000) for i in range(64)], "k int, t string").coalesce(1)

    def counter():
        return lambda a: pa.array([len(a)] * len(a), pa.int32())

    got = K.map_in_steps(rows, "k", "t", "n", T.IntegerType(), counter)
    assert got.count() == 64 and got.agg(F.max("n")).first()[0] <= K.STEP // 100_000 + 1
    assert "MapInArrow" in _plan(E.queries()["tokenize_vocab"](spark, SF_SMALL))
    assert list(K.steps(pa.array([], pa.string()))) == [] and list(K.steps(pa.array([None, "", "a"]))) == [(0, 3)]


# F9
def test_edit_tables_stay_small():
    from promptlake.operators import metrics as M

    words = [[f"w{(i * j) % 97}" for j in range(12)] for i in range(20_000)]
    a = pa.array([*words, ["x"] * 4000, None], pa.list_(pa.string()))
    b = pa.array([*[w[1:] + ["y"] for w in words], ["x"] * 3000 + ["z"] * 5, []], pa.list_(pa.string()))
    tracemalloc.start()
    got = M._in_steps(M._edit_batch)(a, b).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()

    def plain(x, y):
        prev = list(range(len(y) + 1))
        for i, u in enumerate(x):
            cur = [i + 1]
            for j, v in enumerate(y):
                cur.append(min(prev[j + 1] + 1, cur[j] + 1, prev[j] + (u != v)))
            prev = cur
        return prev[-1]

    assert peak < 48e6, peak
    assert got[-2:] == [1000, 0]
    assert all(got[i] == plain(words[i], words[i][1:] + ["y"]) for i in range(0, 20_000, 1999))


# F10
def test_ngrams_are_counted_where_the_row_is(spark):
    from collections import Counter

    from promptlake.operators import metrics as M

    plan = _plan(E.queries()["metric_bleu"](spark, SF_SMALL))
    assert "Generate" not in plan
    texts = [("a b a b a", "a b a"), ("", "a"), ("c", ""), ("a a a a", "a a b a a"), ("x y z", "x y z")]
    df = spark.createDataFrame([(i, p.split(), r.split()) for i, (p, r) in enumerate(texts)], "id int, p array<string>, r array<string>").coalesce(1)
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    got = {(x.id, x.n): (x.match, x.n_pred, x.n_ref) for x in M._ngram_overlap(df, ["id"], (1, 2, 3, 4)).collect()}
    assert len(got) == 4 * len(texts)
    for i, (p, r) in enumerate(texts):
        for n in range(1, 5):
            gp, gr = grams(p.split(), n), grams(r.split(), n)
            assert got[(i, n)] == ((gp & gr).total(), gp.total(), gr.total())


# F4
def test_changes_of_pairs_equal_a_recount(spark):
    from promptlake.operators import subwords as W

    texts = ["abcabc", "abab", "xxabyyab", "bca", "aaa", "zz", "cabbage", "日本ab"]
    words = spark.createDataFrame([(t, i + 1) for i, t in enumerate(texts)], "p string, n long").select(W.spaced("p").alias("w"), "n").coalesce(1)
    done, batch = [("a", "b")], [("ab", "c"), ("y", "y")]
    count = lambda merges: {(r.l, r.r): r.n for r in W._pair_sums(words.select(W._merged(F.col("w"), merges).alias("w"), "n")).collect()}
    before, after = count(done), count(done + batch)
    changes = {(r.l, r.r): r.n for r in W._pair_changes(words, done, batch).collect()}
    assert changes == {p: d for p in before.keys() | after.keys() if (d := after.get(p, 0) - before.get(p, 0))}


# F6
def test_ids_are_decoded_in_one_gather():
    from promptlake.operators.subwords import ids_decoder

    decode = ids_decoder({3: b"a", 4: b"\xc3", 5: b"\xa9", 300: "né".encode()})
    rows = pa.array([[3, 300, 1], None, [], [4, 5], [-1, 999, 3]], pa.list_(pa.int32()))
    assert decode(rows).to_pylist() == ["ané", None, "", "é", "a"]
    assert decode(rows.slice(1, 3)).to_pylist() == [None, "", "é"]
    assert decode(pa.array([[4], [3]], pa.list_(pa.int32()))).to_pylist() == ["�", "a"]
