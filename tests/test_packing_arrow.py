"""Segments, prefix-LM features and id texts made over Arrow batches."""

import numpy as np
import pyarrow as pa
import pytest

from promptlake.operators import packing, tokens
from promptlake.operators.packing import PREFIX_FEATURES, lm_segments_text, pack_prefix_lm
from promptlake.operators.tokens import ids_text, ids_text_arrow
from promptlake.plans import QUERIES

from .conftest import SF_SMALL


def _expected(a, b, m, length):
    a, b = ((list(x or [])[:length] + [0] * length)[:length] for x in (a, b))
    enc, dec = a[:m] + b[: length - m], a[m:] + b[length - m :]
    k = length - m
    return {
        "encoder_input_tokens": enc,
        "decoder_target_tokens": dec,
        "encoder_segment_ids": [1] * m + [2] * k,
        "encoder_positions": [*range(m), *range(k)],
        "decoder_segment_ids": [1] * k + [2] * m,
        "decoder_positions": [*range(k), *range(m)],
        "decoder_input_tokens": [0 if i in (0, k) else dec[i - 1] for i in range(length)],
        "decoder_loss_weights": [int(x != 0) for x in dec],
    }


@pytest.fixture
def small_steps(spark, monkeypatch):
    monkeypatch.setattr(packing, "STEP", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_features_against_plain_lists(spark, small_steps, kind):
    rng = np.random.default_rng(3)
    big = 1 << 40 if kind == "bigint" else 1 << 20
    segs = {(s, i): [int(x) * (-1) ** i + big * (i % 3) for x in rng.integers(0, 200, 8)] for s in "xy" for i in range(41)}
    segs["x", 40] = segs["x", 40][:3]
    segs["y", 7] = []
    segs["y", 8] = segs["y", 8] + [9, 9]  # longer than a segment: cut
    df = spark.createDataFrame([(s, i, t) for (s, i), t in segs.items()], f"lang string, seg bigint, tokens array<{kind}>")
    out = pack_prefix_lm(df, "lang", 8)
    assert out.columns == ["lang", "pair", "m", *PREFIX_FEATURES]
    got = out.collect()
    assert len(got) == 42 and {r.m for r in got} <= set(range(1, 8))
    for r in got:
        want = _expected(segs[r.lang, 2 * r.pair], segs.get((r.lang, 2 * r.pair + 1)), r.m, 8)
        assert {f: r[f] for f in PREFIX_FEATURES} == want


@pytest.mark.parametrize("arrow", [False, True])
def test_segments_of_bytes_and_document_ends(spark, small_steps, arrow):
    texts = ["", None, "aé\U0001f600", "", "x" * 30, "\x00\x7f", None]
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate(texts)], "lang string, doc_id bigint, text string")
    got = {r.seg: r.tokens for r in lm_segments_text(df, "lang", "doc_id", "text", 4, arrow=arrow).collect()}
    flat = [i for t in texts for i in [*(b + 3 for b in (t or "").encode()), 1]]
    assert got == {s: flat[4 * s : 4 * s + 4] for s in range(-(-len(flat) // 4))}


def test_ids_text_of_nulls_and_wide_ids(spark):
    rows = [[1, 2, 3], [], None, [None], [4, None, -100], [1 << 40, -(1 << 40)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<bigint>")
    got = df.select("i", ids_text_arrow("x").alias("t"), ids_text("x").alias("same")).collect()
    assert all(r.t == r.same for r in got)
    assert {r.i: r.t for r in got} == {0: "1 2 3", 1: "", 2: None, 3: "", 4: "4 -100", 5: f"{1 << 40} -{1 << 40}"}


def test_ids_text_in_steps(monkeypatch):
    monkeypatch.setattr(tokens.steps, "__defaults__", (7,))
    rows = [None if i % 11 == 0 else [j % 5 - 1 for j in range(i % 13)] for i in range(60)]
    ids = pa.array([[0], *rows], pa.list_(pa.int32()))[1:]
    assert tokens._joined(ids).to_pylist() == [None if x is None else " ".join(map(str, x)) for x in rows]


def test_features_become_text_in_one_pass(spark):
    """No array is joined id by id, and the features do not go back to the JVM to become text."""
    plan = QUERIES["pack_prefix_lm"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "decode(" not in plan
    assert plan.count("ArrowEvalPython") == 2  # ids of segments; features and their text
    assert "MapInArrow" not in plan


def test_segments_go_to_their_pair_as_bytes(spark):
    """What is shuffled for pairs compresses to about the bytes of the text, not to several times that."""
    import zlib

    rng = np.random.default_rng(5)
    ids = [[int(x) for x in rng.integers(100, 126, 512)] for _ in range(20)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x array<int>")
    planes = df.select("i", packing._to_planes("x", 512, np.int32).alias("p")).orderBy("i").collect()
    for x, r in zip(ids, planes, strict=True):
        assert len(zlib.compress(bytes(r.p), 1)) < 1.2 * len(zlib.compress(bytes(x), 1))
    array = pa.array([None, *[bytes(r.p) for r in planes], None], pa.binary())
    assert packing._from_planes(array, 512, np.int32).tolist() == [[0] * 512, *ids, [0] * 512]
    assert packing._from_planes(array[2:4], 512, np.int32).tolist() == ids[1:3]
    assert packing._from_planes(array[:1], 512, np.int32).tolist() == [[0] * 512]
    plan = QUERIES["pack_prefix_lm"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.split("\n") if "functions=[first(" in line or "functions=[partial_first(" in line]
    assert len(grouped) == 2 and not any("tokens" in line for line in grouped)
