"""Prefix-LM preparation and packing as table jobs.

* ``lm_segments``: per document all its tokens (or, if asked for, a random chunk of at most
  ``max_chunk``) plus EOS; the documents of a stream (ordered by key) are concatenated and cut
  into ``length``-token segments. Only (document, segment) pairs are exploded, never single
  tokens: each document gets its global start offset from a two-phase running sum over (key,
  length) rows, which carry no text, emits the slices of the segments it overlaps, and segments
  are reassembled with an ordered ``collect_list`` (at most ``length`` tokens per group).
* ``pack_prefix_lm``: consecutive segments (2j, 2j+1) become one encoder-decoder example
  split at a hashed point ``m``; the last odd one is filled up with padding. Both halves meet in one
  row by a shuffle, which carries their ids in byte planes; its eight features are made over Arrow
  batches, a bounded number of rows at once.
* ``pack_examples``: next-fit packing of whole sequences into rows of at most ``length``
  tokens inside shards of about ``shard_tokens`` (next-fit is sequential, so the shard is the unit
  of work; only (key, piece, length) rows go through the per-shard step). Sequences longer than a
  row are cut into consecutive pieces.
* ``lm_split``: one span split into (inputs, targets) at a hashed point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_u
from ..functions.hof import let
from .ordered import ordered_cumsum
from .tokens import BYTE_OFFSET, EOS, PAD, STEP, bytes_ids

def doc_chunks(docs: DataFrame, tokens: str, key: str, max_chunk: int | None = None, seed: str = "chunk") -> DataFrame:
    """All tokens of a document (or a random chunk of at most ``max_chunk``), then EOS."""
    eos = F.array(F.lit(EOS))
    if max_chunk is None:
        return docs.withColumn("chunk", F.concat(F.col(tokens), eos))
    n = F.size(tokens)
    start = F.floor(hash_u(seed, key) * (n - F.lit(max_chunk) + 1))
    piece = F.when(n > max_chunk, F.slice(tokens, (start + 1).cast("int"), max_chunk)).otherwise(F.col(tokens))
    return docs.withColumn("chunk", F.concat(piece, eos))


def _with_starts(c: DataFrame, stream: str, key: str) -> DataFrame:
    """``c`` (stream, key, ..., len) with the position of each row in its stream.

    Only (stream, key, len) rows go through the ranges and windows; the positions are joined back."""
    starts = ordered_cumsum(c.select(stream, key, "len"), stream, key, "len", "start").select(stream, key, "start")
    return c.join(starts, [stream, key])


def lm_segments(chunks: DataFrame, stream: str, key: str, length: int, chunk: str = "chunk") -> DataFrame:
    """Concatenate ``chunk`` arrays per ``stream`` in ``key`` order and cut into ``length`` segments."""
    c = _with_starts(chunks.select(stream, key, chunk).withColumn("len", F.size(chunk)), stream, key)
    L = F.lit(length)
    first = F.floor(F.col("start") / L)
    last = F.floor((F.col("start") + F.col("len") - 1) / L)

    def pieces(ch):
        def piece(s):
            lo = F.greatest(s * L - F.col("start"), F.lit(0))
            hi = F.least((s + 1) * L - F.col("start"), F.col("len"))
            return F.struct(
                s.alias("seg"),
                F.greatest(F.col("start") - s * L, F.lit(0)).alias("off"),
                F.slice(ch, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("toks"),
            )

        return F.transform(F.sequence(first, last), piece)

    parts = c.where(F.col("len") > 0).select(stream, F.explode(let(F.col(chunk), pieces)).alias("p")).select(stream, "p.*")
    g = parts.groupBy(stream, "seg").agg(F.array_sort(F.collect_list(F.struct("off", "toks"))).alias("__ps"))
    return g.select(stream, "seg", F.flatten(F.transform("__ps", lambda x: x["toks"])).alias("tokens"))


def _part_ids(parts: pa.Array) -> pa.Array:
    """Ids of segments from lists of their (bytes, eos) parts: each byte plus 3, EOS where a document ends."""
    flat = parts.flatten()
    binary = flat.field("bytes").cast(pa.large_binary())
    _, offs, data = binary.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1] if len(binary) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.empty(0, dtype=np.uint8)
    eos = flat.field("eos").to_numpy(zero_copy_only=False).astype(bool)
    upto = np.concatenate(([0], off[1:] - off[0] + np.cumsum(eos)))  # ids up to the end of each part
    last = upto[1:][eos] - 1
    ids = np.empty(upto[-1], dtype=np.int32)
    byte = np.ones(len(ids), dtype=bool)
    byte[last] = False
    ids[byte] = raw
    ids += BYTE_OFFSET
    ids[last] = EOS
    n = pc.list_value_length(parts).fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(upto[np.concatenate(([0], np.cumsum(n, dtype=np.int64)))], pa.int32()), pa.array(ids))


def lm_segments_text(docs: DataFrame, stream: str, key: str, text: str, length: int, max_chunk: int | None = None, seed: str = "chunk", arrow: bool = False) -> DataFrame:
    """``lm_segments`` for byte tokens, computed on bytes.

    Byte tokens are one per UTF-8 byte, so a document is carried as ``binary`` (1 byte per token
    through the shuffles, instead of an int array) and expanded to ids only per finished
    segment: by expressions, or with ``arrow`` over Arrow batches, for plans that go on in Python.
    Same result as ``doc_chunks`` + ``lm_segments`` over ``byte_tokens(text)``.
    """
    chunk = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    if max_chunk is not None:
        n = F.octet_length(F.col(text))
        start = F.floor(hash_u(seed, key) * (n - F.lit(max_chunk) + 1))
        chunk = F.when(n > max_chunk, F.substring(chunk, (start + 1).cast("int"), max_chunk)).otherwise(chunk)
    c = docs.select(stream, key, chunk.alias("bin")).withColumn("len", F.octet_length("bin") + 1)
    c = _with_starts(c, stream, key)
    L = F.lit(length)
    first = F.floor(F.col("start") / L)
    last = F.floor((F.col("start") + F.col("len") - 1) / L)

    def pieces(bin_):
        def piece(s):
            lo = F.greatest(s * L - F.col("start"), F.lit(0))
            hi = F.least((s + 1) * L - F.col("start"), F.col("len"))
            nbytes = F.least(hi, F.col("len") - 1) - lo
            return F.struct(
                s.alias("seg"),
                F.greatest(F.col("start") - s * L, F.lit(0)).alias("off"),
                F.when(nbytes > 0, F.substring(bin_, (lo + 1).cast("int"), nbytes.cast("int"))).otherwise(F.lit(b"").cast("binary")).alias("bytes"),
                (hi == F.col("len")).alias("eos"),
            )

        return F.transform(F.sequence(first, last), piece)

    parts = c.select(stream, F.explode(let(F.col("bin"), pieces)).alias("p")).select(stream, "p.*")
    g = parts.groupBy(stream, "seg").agg(F.array_sort(F.collect_list(F.struct("off", "bytes", "eos"))).alias("__ps"))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def arrow_ids(ps: pa.Array) -> pa.Array:
        return _part_ids(ps)

    def ids(p):
        return F.concat(bytes_ids(p["bytes"]), F.when(p["eos"], F.array(F.lit(EOS))).otherwise(F.array().cast("array<int>")))

    tokens = arrow_ids("__ps") if arrow else F.flatten(F.transform("__ps", ids))
    return g.select(stream, "seg", tokens.alias("tokens"))


def _padded(ids: pa.Array, length: int) -> np.ndarray:
    """Lists as rows of ``length`` ids, cut or filled up with padding; null is all padding."""
    n = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = ids.flatten().to_numpy(zero_copy_only=False)
    if (n == length).all():
        return values.reshape(-1, length)
    at = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((len(ids), length), PAD, dtype=values.dtype)
    out[np.arange(length) < n[:, None]] = values[at < length]
    return out


def _to_planes(ids: str, length: int, wide: type) -> Column:
    """Lists of ids as ``length`` ids in bytes: the lowest byte of each, then the next of each, and so on. High
    bytes are mostly equal, so that the shuffle's compression leaves little more than one byte an id."""
    width = np.dtype(wide).itemsize

    @F.arrow_udf(T.BinaryType())
    def planes(x: pa.Array) -> pa.Array:
        rows = _padded(x, length).astype(wide, copy=False)
        raw = np.ascontiguousarray(rows.view(np.uint8).reshape(-1, length, width).transpose(0, 2, 1))
        off = np.arange(0, raw.size + 1, width * length, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(raw)])

    return planes(ids)


def _from_planes(planes: pa.Array, length: int, wide: type) -> np.ndarray:
    """Rows of ids from their bytes; null is all padding."""
    out = np.full((len(planes), length), PAD, dtype=wide)
    there = pc.is_valid(planes).to_numpy(zero_copy_only=False)
    raw = planes.drop_null()
    if len(raw) == 0:
        return out
    _, offs, data = raw.buffers()
    first = int(np.frombuffer(offs, dtype=np.int32)[raw.offset])
    width = out.itemsize
    byte = np.frombuffer(data, dtype=np.uint8)[first : first + len(raw) * length * width].reshape(-1, width, length)
    ids = byte[:, 0].astype(wide)
    for i in range(1, width):
        if byte[:, i].any():
            ids |= byte[:, i].astype(wide) << wide(8 * i)
    out[there] = ids
    return out


def _shifted(targets: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Targets shifted right by one; the first position of both segments (0 and ``k``) is padding."""
    out = np.full_like(targets, PAD)
    out[:, 1:] = targets[:, :-1]
    out[at == k] = PAD
    return out


def _inputs(a, b, at, m, k):
    return np.take_along_axis(np.concatenate([a, b], axis=1), np.where(at < m, at, at + k), 1)


def _targets(a, b, at, m, k):
    return np.take_along_axis(np.concatenate([a, b], axis=1), np.where(at < k, at + m, at + len(at)), 1)


# Features of pairs (a, b) split at m, in column order, over rows of L positions ``at``, with k = L - m: those
# made of tokens and those that follow from the split point alone.
_FROM_TOKENS = {
    "encoder_input_tokens": _inputs,
    "decoder_target_tokens": _targets,
    "decoder_input_tokens": lambda a, b, at, m, k: _shifted(_targets(a, b, at, m, k), at, k),
    "decoder_loss_weights": lambda a, b, at, m, k: (_targets(a, b, at, m, k) != PAD).astype(np.int32),
}
_FROM_SPLIT = {
    "encoder_segment_ids": lambda at, m, k: np.where(at < m, 1, 2),
    "encoder_positions": lambda at, m, k: np.where(at < m, at, at - m),
    "decoder_segment_ids": lambda at, m, k: np.where(at < k, 1, 2),
    "decoder_positions": lambda at, m, k: np.where(at < k, at, at - k),
}
PREFIX_FEATURES = (
    "encoder_input_tokens decoder_target_tokens encoder_segment_ids encoder_positions "
    "decoder_segment_ids decoder_positions decoder_input_tokens decoder_loss_weights"
).split()


def _prefix_feature(name: str, length: int, wide: type) -> Column:
    """One feature of the rows (a, b, m), a bounded number of them at a time."""
    kind = np.int32 if name in _FROM_SPLIT or name == "decoder_loss_weights" else wide
    lists = T.ArrayType(T.LongType() if kind is np.int64 else T.IntegerType())

    def rows(m: pa.Array, values) -> pa.Array:
        out, step = np.empty((len(m), length), dtype=kind), max(1, STEP // length)
        at = np.arange(length, dtype=np.int32)
        for i in range(0, len(m), step):
            split = m.slice(i, step).to_numpy()[:, None].astype(np.int32)
            out[i : i + step] = values(i, step, at, split, length - split)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, length), pa.int32()), pa.array(out.ravel()))

    if name in _FROM_SPLIT:
        of_split = _FROM_SPLIT[name]

        @F.arrow_udf(lists)
        def feature(m: pa.Array) -> pa.Array:
            return rows(m, lambda i, step, *at: of_split(*at))

        return feature("m")
    of_tokens = _FROM_TOKENS[name]

    @F.arrow_udf(lists)
    def feature(a: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        return rows(m, lambda i, step, *at: of_tokens(_from_planes(a.slice(i, step), length, wide), _from_planes(b.slice(i, step), length, wide), *at))

    return feature("a", "b", "m")


def pack_prefix_lm(segments: DataFrame, stream: str, length: int, seed: str = "prefix") -> DataFrame:
    """Pairs (2j, 2j+1) of each stream -> encoder/decoder features with split point m in [1, L).

    A last segment without a partner is paired with padding, which has loss weight 0."""
    wide = np.int64 if segments.schema["tokens"].dataType.elementType == T.LongType() else np.int32
    halves = segments.select(stream, "seg", _to_planes("tokens", length, wide).alias("half"))
    # each pair holds one segment of either kind at most, so both come from one pass over the segments
    half = lambda k: F.first(F.when(F.col("seg") % 2 == k, F.col("half")), ignorenulls=True)
    j = halves.groupBy(stream, F.floor(F.col("seg") / 2).cast("long").alias("pair")).agg(half(0).alias("a"), half(1).alias("b"))
    m = (F.lit(1) + F.floor(hash_u(seed, F.concat_ws(":", stream, "pair")) * (length - 1))).cast("int")
    j = j.select(stream, "pair", m.alias("m"), "a", "b")
    return j.select(stream, "pair", "m", *[_prefix_feature(f, length, wide).alias(f) for f in PREFIX_FEATURES])


def lm_split(tokens, seed_key) -> tuple:
    """(inputs, targets) of one span: split point in [1, n) from the hash (n >= 2)."""
    n = F.size(tokens)
    m = (F.lit(1) + F.floor(hash_u("split", seed_key) * (n - 1))).cast("int")
    return F.slice(tokens, 1, m), F.slice(tokens, m + 1, n - m), m


def _next_fit(length: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "piece"], kind="stable")
        bins = np.empty(len(pdf), dtype=np.int64)
        b, used = 0, 0
        for i, n in enumerate(pdf["len"].to_numpy(dtype=np.int64)):
            if used + n > length and used > 0:
                b += 1
                used = 0
            bins[i] = b
            used += n
        return pdf[["shard", "key", "piece"]].assign(bin=bins)

    return fit


def pack_examples(df: DataFrame, key: str, tokens: str, length: int, shard_tokens: int = 1 << 20) -> DataFrame:
    """Next-fit packing: sequences (ordered by key, then piece) of a hashed shard fill a row until
    the next one would overflow ``length``. A longer sequence becomes consecutive pieces.

    There is one shard per ``shard_tokens`` tokens in all, so the sequential step sees a bounded
    number of (key, piece, length) rows; tokens are joined back and each packed row is assembled by
    an ordered ``collect_list`` bounded by ``length`` tokens.
    """
    total = df.agg(F.sum(F.size(tokens))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    n = F.size(F.col(tokens))

    def pieces(t):
        return F.transform(F.sequence(F.lit(0), F.ceil(n / length).cast("int") - 1), lambda i: F.struct(i.alias("piece"), F.slice(t, i * length + 1, length).alias("toks")))

    base = df.where(n > 0).select(F.floor(hash_u("pack", key) * shards).cast("long").alias("shard"), F.col(key).cast("string").alias("key"), F.explode(let(F.col(tokens), pieces)).alias("p"))
    base = base.select("shard", "key", "p.*")
    lens = base.select("shard", "key", "piece", F.size("toks").alias("len"))
    bins = lens.groupBy("shard").applyInPandas(_next_fit(length), "shard long, key string, piece int, bin long")
    j = base.join(bins, ["shard", "key", "piece"])
    g = j.groupBy("shard", "bin").agg(F.array_sort(F.collect_list(F.struct("key", "piece", "toks"))).alias("__s"))
    seg_ids = F.flatten(
        F.transform("__s", lambda s, i: F.array_repeat((i + 1).cast("int"), F.size(s["toks"])))
    )
    positions = F.flatten(F.transform("__s", lambda s: F.sequence(F.lit(0), F.size(s["toks"]) - 1)))
    return g.select(
        "shard",
        "bin",
        F.transform("__s", lambda s: s["key"]).alias("keys"),
        F.transform("__s", lambda s: s["piece"]).alias("pieces"),
        F.flatten(F.transform("__s", lambda s: s["toks"])).alias("tokens"),
        seg_ids.alias("segment_ids"),
        positions.alias("positions"),
    )
