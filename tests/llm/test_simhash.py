"""SimHash operator against a brute-force version, its search on planted fingerprints, and the code tables."""

import random

import numpy as np
import pytest
import xxhash

from promptlake.llm import simhash as S
from promptlake.llm.components import components
from tests.llm.test_operators import DOCS, _texts, lower, same, words


def brute_roots(n, links):
    """Smallest position reachable from each of ``n`` positions."""
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return root


def brute_print(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(prints):
    """[(id, fingerprint)] -> smallest id reachable of each row."""
    n = len(prints)
    root = brute_roots(n, [(i, j) for i in range(n) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 4])
    least = {}
    for r, (i, _) in zip(root, prints, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root]


def _rows():
    r = random.Random(5)
    base = " ".join(f"w{r.randrange(500)}" for _ in range(900)).split(" ")
    texts = _texts()
    for i in range(40):
        near = list(base)
        for _ in range(1 + i % 3):
            near[r.randrange(900)] = f"x{i}"
        texts.append(" ".join(near))
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    return rows + [rows[0], (0, "another text of an equal id"), (None, texts[0]), (None, "null id with a few words of its own")]


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_brute_force(spark, parts):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, 7, True, "r", "b", 1) for i, t in rows], DOCS).repartition(parts)
    prints = [(i, brute_print(t)) for i, t in rows]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_labels(prints), strict=True)]
    assert len({c for _, _, c in want}) < len(want) - 10
    same(S.simhash_groups(docs), ["doc_id", "fingerprint", "component_id"], want)


def test_empty_table(spark):
    out = S.simhash_groups(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 7)
    texts = [t or "" for t in _texts()]
    import pyarrow as pa

    got = [int(x) for _, _, f in S.fingerprints(pa.array(texts), 4) for x in f.view(np.uint64)]
    assert got == [brute_print(t) for t in texts]


@pytest.mark.parametrize("block", [3, 2048])
def test_search_misses_no_link(spark, monkeypatch, block):
    """Chains and clouds of fingerprints at zero to six bits, with keys that hold many of them."""
    monkeypatch.setattr(S, "BLOCK", block)
    r = random.Random(9)
    found = {r.getrandbits(64) for _ in range(150)}
    for start in list(found)[:25]:
        f = start
        for _ in range(6):
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 6)))
            found.add(f)
    cloud = r.getrandbits(64)
    found |= {cloud ^ sum(1 << b for b in r.sample(range(36, 64), r.randint(0, 8))) for _ in range(300)}
    found |= {cloud ^ (1 << a) ^ (1 << b) ^ (1 << c) ^ (1 << d) for a, b, c, d in ((0, 17, 33, 49), (1, 18, 34, 50))}
    f = sorted(np.array(sorted(found), dtype=np.uint64).view(np.int64).tolist())
    got = {x.node: x.component for x in components(S._links(spark.createDataFrame([(x,) for x in f], "f long").repartition(4))).collect()}
    root = brute_roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if ((f[i] ^ f[j]) & (2**64 - 1)).bit_count() <= 4])
    assert [got.get(x, x) for x in f] == [f[i] for i in root]


def test_code_is_perfect_and_keys_meet():
    table, count = S._patterns()
    assert np.bitwise_count(table[np.arange(2048), 0]).max() == 3 and set(count.tolist()) == {1, 6} and (count == 6).sum() == 1771
    segments = np.arange(1 << 16)
    for bit in range(16):
        other = segments ^ (1 << bit)
        assert ((S.NEARBY[other] == S.NEARBY[segments][:, :1]) & S.IS_NEARBY[other]).any(axis=1).all()
    r = random.Random(2)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4)))
        a, b = (np.array([x], dtype=np.uint64).view(np.int64) for x in (a, b))
        assert set(S.keys(a, False)[0]) & set(S.keys(b, True)[0]) and set(S.keys(b, False)[0]) & set(S.keys(a, True)[0])
