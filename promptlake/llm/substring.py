"""Exact substring dedup: an FM-index per shard, searched backward by the segments of documents.

A window is ``size`` consecutive words of one document. Every word covered by a window whose words
also start in a document with a smaller id is removed.

1. Each window names its minimizer, the k-word sequence with the smallest hash in it; equal windows
   name the same. Minimizers that lie in one document only are dropped (partial aggregation).
2. Consecutive windows with one shared minimizer form a segment: (minimizer, hash of its words).
   Equal segments are collapsed to the smallest document before their words are fetched.
3. Segments are dealt to shards by minimizer, so all windows that could match meet in one shard; a
   minimizer with very many different segments is handled window by window instead: the smallest
   document of each window is found by partial aggregation over a 128-bit hash of its words and
   joined back from written tables, so a window that is everywhere is never in one task. A shard builds
   a compressed FM-index (wavelet matrix) over its segments and searches all their windows
   backward; the match of full length gives the rows, and the rows the smallest document.
4. Those first documents go back to all segments, and intervals with an earlier document to the
   texts, from which the covered words are removed.

Shards hold about ``SHARD_SEGMENTS`` segments, however large the corpus; nothing is compared
pairwise or gathered by document group.

Defined results: null, empty and short texts lose nothing and hash as their words joined; repeated
windows inside one document alone are kept; a null id counts as larger than all ids and removes
nothing elsewhere; rows with equal ids are told apart by a 64-bit hash of their texts and do not
remove words from each other; empty tables give empty tables; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ._words import Words, chunks, mix, window_hash
from .fmindex import FMIndex

MINIMIZER = 6  # words
SHARD_SEGMENTS = 12_000
HOT_SEGMENTS = 4_000  # different segments of one minimizer beyond which its windows are handled singly
NO_ID = (1 << 63) - 1
SECOND = np.uint64(0xA0761D6478BD642F)  # of the second hash of a window
OUT = "doc_id long, n_words long, n_removed long, kept_text string"


def _segments(w: Words, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Segments of a run of texts: text number, first word in it, windows, minimizer and segment hash."""
    n = len(w.hash)
    if n < size:
        e = np.empty(0, dtype=np.int64)
        return e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    g = window_hash(w.hash, k)
    span = size - k + 1
    view = np.lib.stride_tricks.sliding_window_view(g, span)  # one row per window
    at = view.argmin(axis=1) + np.arange(len(view))
    text = np.searchsorted(w.bounds, np.arange(len(view)), side="right") - 1
    valid = np.arange(len(view)) + size <= w.bounds[text + 1]
    start = np.flatnonzero(valid)
    at, text = at[start], text[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    # sums over the segment's words, position by position, make its hash
    length = count + size - 1
    h = np.zeros(len(begin), dtype=np.uint64)
    for j in range(int(length.max(initial=0))):
        live = length > j
        h[live] = (h[live] ^ w.hash[begin[live] + j]) * np.uint64(0x9FB21C651E98DF25)
        h[live] ^= h[live] >> np.uint64(29)
    return text[first], begin - w.bounds[text[first]], count, g[at[first]], h ^ length.astype(np.uint64)


def _emit(size: int, k: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 2))
            for a, _, buf, off in chunks(batch.column(1)):
                text, start, count, fp, seg = _segments(Words(buf, off), size, k)
                cols = [pa.array(fp.view(np.int64)), pa.array(ids[a + text])]
                if full:
                    cols += [pa.array(hashes[a + text]), pa.array(seg.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["fp", "doc_id", "text_hash", "seg", "start", "count"][: len(cols)])

    return run


def _payloads(size: int, hot: bool):
    """Documents with their first segments -> words of each segment; ``hot``: hashes of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in chunks(batch.column(1)):
                w = Words(buf, off)
                own = batch.column(2).slice(a, b - a)
                n = pc.list_value_length(own).to_numpy()
                s = own.flatten()
                fp, seg, start, count = (s.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                doc = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), n)
                base = np.repeat(w.bounds[:-1], n) + start
                if hot:
                    row = np.repeat(np.arange(len(fp)), count)
                    shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    k1, k2 = (window_hash(h, size)[base[row] + shift].view(np.int64) for h in (w.hash, mix(w.hash ^ SECOND)))
                    cols = [k1, k2, fp[row], seg[row], shift.astype(np.int32), doc[row]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k1", "k2", "fp", "seg", "shift", "doc_id"])
                    continue
                length = count + size - 1
                at = np.cumsum(length) - length
                words = w.hash[np.repeat(base - at, length) + np.arange(int(length.sum()))]
                offsets = pa.array(np.append(at, at[-1] + length[-1]) if len(at) else [0], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp), pa.array(seg), pa.array(np.zeros(len(fp), dtype=np.int32)), pa.array(doc), pa.ListArray.from_arrays(offsets, pa.array(words.view(np.int64)))],
                    names=["fp", "seg", "shift", "doc_id", "words"],
                )

    return run


def _index_shard(rows: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    """First document of every window of the segments of one shard."""
    t = pa.Table.from_batches(rows).combine_chunks()
    words = t.column("words").combine_chunks()
    lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
    symbols = words.flatten().to_numpy()
    index = FMIndex(symbols, lengths)
    codes = index.encode(symbols)
    windows = lengths - size + 1
    of = np.repeat(np.arange(len(lengths)), windows)
    begin = np.repeat(np.cumsum(lengths) - lengths, windows) + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    # a window whose hash occurs once has its own document only; the others are searched once each
    _, once, which, n = np.unique(window_hash(symbols.view(np.uint64), size)[begin], return_index=True, return_inverse=True, return_counts=True)
    docs = t.column("doc_id").to_numpy()
    own = docs[of[once]]
    again = n > 1
    lo, hi = index.search(codes, begin[once[again]] + size, size)
    own[again] = index.least(lo, hi, docs)
    least = own[which]
    offsets = pa.array(np.concatenate(([0], np.cumsum(windows))), pa.int32())
    cols = [t.column(c).combine_chunks() for c in ("fp", "seg", "shift")]
    return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, pa.array(least))], names=["fp", "seg", "shift", "firsts"])


def _search(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            s = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if s[a] != shard and held:
                    yield _index_shard(held, size)
                    held = []
                shard = s[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield _index_shard(held, size)

    return run


def _remove(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in chunks(batch.column(1)):
                w = Words(buf, off)
                own = batch.column(2).slice(a, b - a)
                n = pc.list_value_length(own).fill_null(0).to_numpy()
                starts = own.flatten().to_numpy() + np.repeat(w.bounds[:-1], n)
                cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + size, -1)
                gone = np.cumsum(cover[:-1]) > 0
                lost = np.concatenate(([0], np.cumsum(gone)))
                raw = w.buf.tobytes()
                texts = []
                for lo, hi in zip(w.bounds[:-1], w.bounds[1:], strict=True):
                    keep = np.flatnonzero(~gone[lo:hi]) + lo
                    texts.append(b" ".join([raw[p:q] for p, q in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(w.bounds)), pa.array(np.diff(lost[w.bounds])), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return run


def dedup_substrings(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", minimizer: int = MINIMIZER, shard_segments: int = SHARD_SEGMENTS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (words that stay, joined by a space)."""
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    src = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    one = ["doc_id", "text_hash"]
    here = src.mapInArrow(_emit(size, minimizer, False), "fp long, doc_id long")
    shared = here.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("fp")
    shared = cut_lineage(shared, "minimizers")
    places = src.mapInArrow(_emit(size, minimizer, True), "fp long, doc_id long, text_hash long, seg long, start int, count int")
    places = cut_lineage(places.join(shared, "fp", "left_semi"), "segments")

    first = places.groupBy("fp", "seg").agg(F.min(F.struct(*one, "start")).alias("at"), F.first("count").alias("count"))
    first = cut_lineage(first.select("fp", "seg", "count", "at.*"), "distinct_segments")
    crowded = first.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_segments).select("fp", F.lit(True).alias("hot"))
    first = first.join(cut_lineage(crowded, "crowded"), "fp", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    row = "fp long, seg long, shift int, doc_id long"

    def payloads(some: DataFrame, hot: bool) -> DataFrame:
        of_doc = some.groupBy(*one).agg(F.collect_list(F.struct("fp", "seg", "start", "count")).alias("segments"))
        of_doc = cut_lineage(of_doc, "segments_of_documents")
        out = src.join(of_doc, one).select("doc_id", "text", "segments")
        return out.mapInArrow(_payloads(size, hot), f"k1 long, k2 long, {row}" if hot else f"{row}, words array<long>")

    windows = cut_lineage(payloads(first.where("hot"), True), "hot_windows")
    least = cut_lineage(windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first")), "hot_firsts")
    hot_found = windows.join(least, ["k1", "k2"]).select("fp", "seg", "shift", F.array("first").alias("firsts"))

    shards = max(1, -(-first.where("not hot").count() // shard_segments))
    dealt = payloads(first.where("not hot"), False).withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards))).select("shard", "fp", "seg", "shift", "doc_id", "words")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(_search(size), "fp long, seg long, shift int, firsts array<long>")
    found = cut_lineage(found.unionByName(hot_found), "first_documents")

    hit = places.join(found, ["fp", "seg"])
    earlier = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.col("start") + F.col("shift") + i)), lambda x: x.isNotNull())
    starts = hit.select(*one, earlier.alias("starts")).where(F.size("starts") > 0)
    starts = cut_lineage(starts.groupBy(*one).agg(F.flatten(F.collect_list("starts")).alias("starts")), "removed_windows")
    out = src.join(starts, one, "left").select("doc_id", "text", "starts").mapInArrow(_remove(size), OUT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id")))
