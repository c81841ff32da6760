"""Subword merges against a sequential version, with few tracked pairs; encoding, decoding, odd rows."""

import random
from collections import Counter

import pytest

from promptlake.operators import subwords as W
from promptlake.operators.tokens import BYTE_OFFSET, FIRST_PIECE_ID


def _sequential(words, size, least=2):
    words = {w: (list(w), n) for w, n in words.items()}
    found = []
    while len(found) < size:
        pairs = Counter()
        for s, n in words.values():
            for p in zip(s, s[1:]):
                pairs[p] += n
        best = min(((-n, p) for p, n in pairs.items() if n >= least), default=None)
        if best is None:
            break
        (a, b), found = best[1], found + [(*best[1], -best[0])]
        for w, (s, n) in words.items():
            out, i = [], 0
            while i < len(s):
                step = 2 if s[i : i + 2] == [a, b] else 1
                out.append("".join(s[i : i + step]))
                i += step
            words[w] = (out, n)
    return found


def _words(seed):
    r = random.Random(seed)
    stems = ["aaaa", "aaab", "abcabc", "bcbcbc", "thethe", "é😀é", "xyz", "$1\\n"]
    return Counter("".join(r.choice(stems)[r.randrange(3) :] for _ in range(r.randrange(1, 4))) or "a" for _ in range(300))


@pytest.mark.parametrize(("tracked", "most"), [(1 << 14, 32), (6, 3)])
def test_merges_equal_one_at_a_time(spark, tracked, most):
    words = _words(3)
    rows = spark.createDataFrame(list(words.items()), "piece string, n long").select(W.spaced("piece").alias("w"), "n")
    assert W.learn_merges(rows, 24, tracked=tracked, round_merges=most) == _sequential(words, 24)


def test_merges_end_when_pairs_are_rare(spark):
    rows = spark.createDataFrame([("abab", 1), ("ab", 1), ("c", 9)], "piece string, n long").select(W.spaced("piece").alias("w"), "n")
    assert W.learn_merges(rows, 50) == [("a", "b", 3)]
    assert W.learn_merges(rows.limit(0), 50) == []


def test_a_wide_tie_with_one_tracked_pair(spark):
    words = {"ab": 2, "cd": 2, "ef": 2}
    rows = spark.createDataFrame(list(words.items()), "piece string, n long").select(W.spaced("piece").alias("w"), "n")
    assert W.learn_merges(rows, 9, tracked=1) == _sequential(words, 9)


def test_certain_merges_stop_at_shared_symbols_ties_and_known_symbols():
    counts = {("a", "b"): 9, ("c", "d"): 8, ("e", "f"): 7, ("b", "x"): 7, ("g", "h"): 6}
    assert W._next_merges(counts, 0, set(), 9, 2, False) == ([("a", "b"), ("c", "d")], False)
    assert W._next_merges(counts, 0, {"ab"}, 9, 2, False) == ([("a", "b")], True)
    assert W._next_merges({("a", "a"): 9, ("c", "d"): 8}, 0, set(), 9, 2, False) == ([("a", "a")], False)
    assert W._next_merges(counts, 9, set(), 9, 2, False) == ([], False)
    assert W._next_merges(counts, 9, set(), 9, 2, True) == ([("a", "b")], False)


def test_rare_characters_are_bytes_and_texts_come_back(spark):
    texts = [(1, "the then them " * 40), (2, None), (3, ""), (4, "  the ☃then\n"), (5, "x" * 5000)]
    df = spark.createDataFrame([(*t, "id") for t in texts], "doc_id long, text string, ids string")
    chars, merges = W.subword_merges(df, 12, 0.9995)
    assert "☃" not in {r.ch for r in chars.collect()} and not any("☃" in r.piece for r in merges.collect())
    vocab = W.subword_vocab(chars, merges)
    ids = {r.piece: r.id for r in vocab.collect()}
    assert min(ids.values()) == FIRST_PIECE_ID and len(set(ids.values())) == len(ids)
    tokens = W.subword_tokenize(df, vocab, "doc_id")
    got = {r.doc_id: r.ids for r in tokens.collect()}
    snow = [b + BYTE_OFFSET for b in "☃".encode()]
    assert got[2] is None and got[3] == [] and any(got[4][i : i + 3] == snow for i in range(len(got[4])))
    assert len(got[1]) < 40 * 12
    assert {r.doc_id: r.text for r in W.subword_decode(tokens, vocab, "doc_id").collect()} == dict(texts)


def test_longest_match_takes_the_longest_piece():
    encode = W.longest_match({"a": 1, "ab": 2, "abc": 3, "c": 4})
    assert encode("abcabac") == [3, 2, 1, 4] and encode("") == []
    assert encode("aé") == [1, *(b + BYTE_OFFSET for b in "é".encode())]
    assert W.longest_match({})("a") == [97 + BYTE_OFFSET]
