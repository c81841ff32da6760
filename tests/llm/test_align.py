"""Alignment of tokenisers against whole-text encoding and a plain merge."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from promptlake.llm import align as A
from tests.llm.test_operators import DOCS, _texts, same

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _byte_of():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    assert {chr(256 + i) for i in range(len(rest))} | {chr(b) for b in kept} == set(ByteLevel.alphabet())
    return {**{chr(b): b for b in kept}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def brute(texts):
    """Groups [(a ids, b ids)] of each text by whole-text encoding."""
    byte_of = _byte_of()
    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    out = []
    for t in texts:
        if not t:
            out.append([])
            continue
        a = tok.encode(" " + t, add_special_tokens=False).ids
        b = sp.encode(t)
        bytes_a = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + t).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append([])
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        out.append(groups)
    return out


def expected(rows):
    found = brute([t for _, t in rows])
    count = Counter((a[-1], b[-1]) for groups in found for a, b in groups)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for (i, _), groups in zip(rows, found, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        linked = [(a[-1], b[-1]) for a, b in groups]
        best = sum(count[x] == top[x[1]] for x in linked)
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(groups), best, sum(count[x] for x in linked), digest))
    return out


def _rows():
    r = random.Random(6)
    odd = ["<|endoftext|> plain <s> </s> <unk> <0x0A>", " ", "  ", "\n", " \n", "\n\n  a\n b\t\tc \n", "▁", "a ▁b", "x▁ y", "a\x00b", "日本語 テキスト 😀 é", "don't we'll  I'm", "tail ", "123456 7,890.12", ");\r\n}\r\n"]
    alphabet = "ab T.,'\n  \téß–0"
    odd += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(_texts() + odd)]
    return rows + [rows[0], (None, None), (None, "a null id")]


@pytest.mark.parametrize("block", [300, 1 << 22])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(A, "TEXT_BYTES", block)
    monkeypatch.setattr(A, "LANE_BYTES", 7 if block == 300 else 512)
    rows = _rows()
    docs = spark.createDataFrame([(i, t, 7, True, "r", "b", 1) for i, t in rows], DOCS).repartition(3)
    out = A.align(docs, *PATHS, with_groups=True).cache()
    want = expected(rows)
    assert sum(x[1] == 0 for x in want) < 15
    same(out, COLS, want)
    assert all(hashlib.sha256(x.groups.encode()).hexdigest() == x.groups_sha256 if x.groups else x.groups_sha256 == "" for x in out.collect())


def test_empty_table(spark):
    out = A.align(spark.createDataFrame([], DOCS), *PATHS)
    assert set(out.columns) == set(COLS) and out.count() == 0


def test_lockstep_in_slices(monkeypatch):
    monkeypatch.setattr(A, "DIGITS", 5)
    import pyarrow as pa

    texts = [" " + t for t in _texts() if t]
    buf = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    a, b = A.byte_coder(PATHS[0]), A.piece_coder(PATHS[1])
    (ids_a, bounds_a, _), (ids_b, bounds_b, _) = a(buf, offsets), b(buf, offsets)
    links = A.lockstep(A._ends(a, ids_a, bounds_a, offsets), A._ends(b, ids_b, bounds_b, offsets), offsets)
    got = A._groups(ids_a, bounds_a, ids_b, bounds_b, links, True)[1]
    assert got == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for g in brute([t[1:] for t in texts])]
    assert pa.array(got).null_count == 0
