"""Summary-level ROUGE against a full table and a walk back through it; sentences, empty and null sides."""

import random
from collections import Counter

import pytest

from promptlake.operators import metrics as M


def _positions(ref, cand):
    t = [[0] * (len(cand) + 1) for _ in range(len(ref) + 1)]
    for i, a in enumerate(ref):
        for j, b in enumerate(cand):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    i, j, out = len(ref), len(cand), set()
    while i and j:
        if ref[i - 1] == cand[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def _score(pred, target):
    cand, ref = ([s.split() for s in x.split("\n")] for x in (pred, target))
    union = Counter(s[i] for s in ref for i in set().union(*[_positions(s, c) for c in cand]))
    have = Counter(w for c in cand for w in c)
    hits = sum(min(n, have[w]) for w, n in union.items())
    n_pred, n_ref = sum(have.values()), sum(map(len, ref))
    return 200 * hits / (n_pred + n_ref) if hits else 0.0


def _texts(r):
    return "\n".join(" ".join(r.choice("abcd") for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(1, 5)))


def test_positions_equal_the_full_table():
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abc") for _ in range(r.randrange(0, 12))] for _ in range(2))
        assert M._lcs_positions(a, b) == _positions(a, b)
    wide = [r.choice("ab") for _ in range(200)], [r.choice("ab") for _ in range(150)]
    assert M._lcs_positions(*wide) == _positions(*wide)


def test_scores_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(f"t{i % 3}", str(i), _texts(r), _texts(r)) for i in range(60)]
    got = {x.task: x.rougeLsum for x in M.rouge_lsum(spark.createDataFrame(rows, "task string, id string, prediction string, target string")).collect()}
    for task in got:
        want = [_score(p, t) for k, _, p, t in rows if k == task]
        assert got[task] == pytest.approx(sum(want) / len(want))


def test_known_value_sentences_and_odd_rows(spark):
    rows = [
        ("known", "1", "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5"),  # 4 of 5 and of 10 words
        ("stop", "1", "b c . a", "a . b c"),  # a lone full stop ends a sentence: order does not matter
        ("null", "1", None, "a"),
        ("empty", "1", "a", ""),
    ]
    df = spark.createDataFrame(rows, "task string, id string, prediction string, target string")
    got = {x.task: x.rougeLsum for x in M.rouge_lsum(df).collect()}
    assert got == {"known": pytest.approx(100 * 8 / 15), "stop": pytest.approx(100.0), "null": 0.0, "empty": 0.0}
    marked = M.rouge_lsum(df.where("task = 'stop'").selectExpr("task", "id", "'B c! a' AS prediction", "'a. b c' AS target"), sentences=M.marked_sentences)
    assert marked.first().rougeLsum == pytest.approx(100.0)
    assert M.rouge_lsum(df.limit(0)).count() == 0
