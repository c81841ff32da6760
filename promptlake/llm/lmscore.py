"""Cross-entropy difference between matched target and background bigram models.

Both models share one vocabulary, all words of all documents (or, if ``vocab`` is given, only the
``vocab`` most frequent ones, ties by word, all others one unknown word), order and smoothing:
Pr(w | v) = (c(v, w) + mu * Pr(w)) / (c(v) + mu) with Pr(w) = (c(w) + 1) / (n + words + 2), ``words``
being the size of the vocabulary. Target counts come from the documents named as target, background
counts from all documents. A document is never in the models that score it: its own counts are taken
out of the background's and, if it is a target, of the target's. What is left of the background's
counts is scaled to the size of what is left of the target's, so both models are smoothed alike. A
token's loss difference is ln Pr_background(w | v) - ln Pr_target(w | v), and a document's score is
its mean: the lower, the more like the target.

The models grow with the corpus and are never in one place. A hash of the row deals the documents to
blocks of about ``BLOCK_BYTES`` of text. A block sums its words, contexts and bigrams, each named by
a 63-bit hash, and sends the sorted names and packed sums to buckets of the names, one row per
bucket. A bucket adds up the rows of all blocks and sends totals back for the names that occur in
several blocks; the others have the sums the block knows. Then each block scores its documents. A
name stands once in a block's rows however frequent it is, texts are shuffled but never copied, and
only the numbers of bytes, words and tokens reach the driver.

Defined results: null and empty texts have no tokens and a null score; a null id is never a target;
rows with equal ids are all target or all not, each is counted and each takes out its own counts
only; without other target documents the score is 0; empty tables give empty tables; only the ids
and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import broadcast_checked
from ..session import cut_lineage
from ._words import Words, chunks, mix

HELD = 1_000_000  # entries a task sums up before it passes them on
BLOCK_BYTES = 4 << 20  # text bytes of a block
BUCKET_BYTES = 12 << 20  # text bytes whose names make a bucket, about a million and a half
ESCAPE = 255  # sums from here on are written in full
_U = np.uint64
_UNKNOWN, _START = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def out():
        words = [w.decode() for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, _, buf, off in chunks(batch.column(0)):
            w = Words(buf, off, lower=True)
            raw = w.buf.tobytes()
            _, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            for p, q, c in zip(w.starts[first].tolist(), w.ends[first].tolist(), n.tolist(), strict=True):
                held[raw[p:q]] = held.get(raw[p:q], 0) + c
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def _vocabulary_hashes(vocabulary: list[str]) -> np.ndarray:
    parts = [Words(buf, off).hash for _, _, buf, off in chunks(pa.array(vocabulary, pa.string()))]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)


def _tokens(text: pa.Array, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the bigram, the word and the context of every token, and the tokens of each text.

    Names of bigrams are odd, those of words even; a context has the name of its word."""
    hashes, contexts, sizes = [], [], []
    for _, _, buf, off in chunks(text):
        w = Words(buf, off, lower=True)
        h = w.hash if known is None else np.where(np.isin(w.hash, known), w.hash, _UNKNOWN)
        context = np.empty(len(h), dtype=np.uint64)
        context[1:] = h[:-1]
        context[w.bounds[:-1][w.bounds[:-1] < w.bounds[1:]]] = _START
        hashes.append(h)
        contexts.append(context)
        sizes.append(np.diff(w.bounds))
    h, context = np.concatenate(hashes), np.concatenate(contexts)
    bigram = mix(mix(context ^ _U(0x9FB21C651E98DF25)) + h) | _U(1)
    word, context = (mix(x ^ _U(0xD6E8FEB86659FD93)) & ~_U(1) for x in (h, context))
    return np.concatenate((bigram, word, context)), h, np.concatenate(sizes)


def _sums(names: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, where each of ``names`` is among them, and four sums of each.

    Sums: as a bigram or word in target documents and in all, as a context in both."""
    found, which = np.unique(names, return_inverse=True)
    n, k = len(target), len(found)
    own, context = which[: 2 * n], which[2 * n :]
    sums = [np.bincount(own, np.tile(target, 2), k), np.bincount(own, minlength=k), np.bincount(context, target, k), np.bincount(context, minlength=k)]
    return found, which, np.stack(sums, axis=1).astype(np.int64)


def _packed(parts: list[np.ndarray]) -> bytes:
    """Arrays of sums: a byte each, followed by those that do not fit in it."""
    raw = []
    for x in parts:
        raw += [np.minimum(x, ESCAPE).astype(np.uint8).tobytes(), x[x >= ESCAPE].astype(np.int64).tobytes()]
    return b"".join(raw)


def _unpacked(raw: memoryview, sizes: list[int]) -> list[np.ndarray]:
    """The arrays of sums back."""
    out, at = [], 0
    for n in sizes:
        x = np.frombuffer(raw[at : at + n], dtype=np.uint8).astype(np.int64)
        big = x == ESCAPE
        end = at + n + 8 * int(big.sum())
        x[big] = np.frombuffer(raw[at + n : end], dtype=np.int64)
        out.append(x)
        at = end
    return out


def _rows_of(names: np.ndarray, sums: np.ndarray) -> bytes:
    """Sorted names (as differences, byte by byte) and their sums; only words have sums as a context."""
    planes = np.ascontiguousarray(np.diff(names, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.compress(planes + _packed(_sums_of(names, sums)), 1)


def _sums_of(names: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    word = (names & _U(1)) == 0
    return [sums[:, 0], sums[:, 1], sums[word, 2], sums[word, 3]]


def _sums_back(names: np.ndarray, raw: memoryview) -> np.ndarray:
    word = (names & _U(1)) == 0
    n, k = len(names), int(word.sum())
    parts = _unpacked(raw, [n, n, k, k])
    sums = np.zeros((n, 4), dtype=np.int64)
    sums[:, 0], sums[:, 1], sums[word, 2], sums[word, 3] = parts
    return sums


def _names_and_sums(x: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = memoryview(zstandard.decompress(x))
    steps = np.ascontiguousarray(np.frombuffer(raw[: 8 * n], np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    names = np.cumsum(steps, dtype=np.uint64)
    return names, _sums_back(names, raw[8 * n :])


def _cuts(found: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted names starts."""
    return np.concatenate(([0], np.searchsorted(found, np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)), [len(found)]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows with one value of the first column."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        s = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if s[a] != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = s[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _requests(known: np.ndarray | None, buckets: int):
    """Sums of the names of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in _runs(batches):
            names, h, sizes = _tokens(t.column("text").combine_chunks(), known)
            target = np.repeat(t.column("is_target").to_numpy(), sizes).astype(np.int64)
            found, _, sums = _sums(names, target)
            cuts = _cuts(found, buckets)
            live = np.flatnonzero(cuts[:-1] < cuts[1:])
            packed = [_rows_of(found[a:b], sums[a:b]) for a, b in zip(cuts[live], cuts[live + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(np.full(len(live), block)), pa.array(np.diff(cuts)[live]), pa.array(packed, pa.binary())], names=["bucket", "block", "n", "names"])

    return run


REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary()), ("words", pa.int64()), ("n_target", pa.int64()), ("n_all", pa.int64())])


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block marks and totals of its names that others hold too, and a row (block -1) with the words and tokens of a bucket."""
    for bucket, t in _runs(batches):
        parts, values = zip(*(_names_and_sums(x, n) for x, n in zip(t.column("names").to_pylist(), t.column("n").to_pylist(), strict=True)), strict=True)
        found, which, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        totals = np.zeros((len(found), 4), dtype=np.int64)
        at = 0
        for names, x in zip(parts, values, strict=True):
            totals[which[at : at + len(names)]] += x
            at += len(names)
        words = totals[((found & _U(1)) == 0) & (totals[:, 1] > 0)]
        rows = [(-1, bucket, b"", len(words), int(words[:, 0].sum()), int(words[:, 1].sum()))]
        at = 0
        for block, names in zip(t.column("block").to_pylist(), parts, strict=True):
            place = which[at : at + len(names)]
            at += len(names)
            again = times[place] > 1
            if again.any():
                sums = _packed(_sums_of(found[place[again]], totals[place[again]]))
                rows.append((block, bucket, zstandard.compress(np.packbits(again).tobytes() + sums, 1), 0, 0, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), REPLY.types, strict=True)], schema=REPLY)


def _own(which: np.ndarray, doc: np.ndarray, n_names: int) -> np.ndarray:
    """For each token how often its name occurs in its document."""
    _, back, n = np.unique(doc * n_names + which, return_inverse=True, return_counts=True)
    return n[back]


def _score(known: np.ndarray | None, n_words: int, n_tokens: tuple[int, int], mu: float, buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        names, h, n = _tokens(docs.column("text").combine_chunks(), known)
        doc = np.repeat(np.arange(len(n)), n)
        is_target = docs.column("is_target").to_numpy().astype(np.int64)
        found, which, sums = _sums(names, is_target[doc])
        cuts = _cuts(found, buckets)
        for i, x in zip(*(replies.column(c).to_pylist() for c in ("bucket", "totals")), strict=True):
            raw = memoryview(zstandard.decompress(x))
            size = int(cuts[i + 1] - cuts[i])
            again = cuts[i] + np.flatnonzero(np.unpackbits(np.frombuffer(raw[: -(-size // 8)], np.uint8), count=size))
            sums[again] = _sums_back(found[again], raw[-(-size // 8) :])
        bigram, word, context = which.reshape(3, -1)
        own = [_own(x, doc, len(found)) for x in (bigram, word, context)]
        n_target, n_all = n_tokens[0] - is_target * n, n_tokens[1] - n  # without the document
        scale = np.where(n_all > 0, n_target / np.maximum(n_all, 1), 1.0)
        loss = np.zeros(len(h))
        for i, sign, total, times, held in ((0, -1, n_target, np.ones(len(n)), is_target), (1, 1, n_all, scale, np.ones(len(n), dtype=np.int64))):
            of_bigram, of_word, of_context = ((sums[x, j] - held[doc] * o) * times[doc] for x, j, o in zip((bigram, word, context), (i, i, i + 2), own, strict=True))
            unigram = (of_word + 1) / ((total * times)[doc] + n_words + 2)
            loss += sign * np.log((of_bigram + mu * unigram) / (of_context + mu))
        mean = np.bincount(doc, loss, len(n)) / np.maximum(n, 1)
        return pa.table([docs.column("doc_id"), pa.array(n), docs.column("is_target"), pa.array(mean, mask=n == 0)], names=["doc_id", "n_tokens", "is_target", "score"])

    return run


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, vocab: int | None = None, mu: float = 100.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, is_target, score. ``target_ids``: one column of ids."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = None
    if vocab is not None:
        counted = src.select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        known = _vocabulary_hashes([r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(vocab).collect()])

    text_bytes = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, buckets = (-(-text_bytes // size) or 1 for size in (BLOCK_BYTES, BUCKET_BYTES))
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("doc_id")).where("doc_id is not null").distinct()
    ids = broadcast_checked(ids.withColumn("is_target", F.lit(True)), "targets")
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block")
    docs = src.join(ids, "doc_id", "left").select(block, "doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    kind = dict(docs.dtypes)["doc_id"]
    dealt = docs.select("block", "text", "is_target").repartition("block").sortWithinPartitions("block")
    requests = dealt.mapInArrow(_requests(known, buckets), "bucket long, block long, n long, names binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    replies = cut_lineage(requests.mapInArrow(_replies, "block long, bucket long, totals binary, words long, n_target long, n_all long"), "totals")

    size = replies.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "n_target", "n_all")]).first()
    score = _score(known, size["words"] if known is None else len(known), (size["n_target"], size["n_all"]), mu, buckets)
    replies = replies.where("block >= 0").select("block", "bucket", "totals")
    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens long, is_target boolean, score double")
