"""Near-duplicates by SimHash fingerprints, found with a Golay code.

Words are lower-cased (A-Z); a text's shingles are its runs of ``k`` words with repeats, joined by
one space (a shorter text is one shingle). A bit of the 64-bit fingerprint is 1 if it is set in over
half the XXH64 hashes (seed 42) of the shingles. Fingerprints link at ``DISTANCE`` or fewer
differing bits.

Search: a fingerprint is four segments of 16 bits. By the pigeonhole principle two fingerprints at
four or fewer differing bits agree in two segments, or agree in one and differ by one bit in
another, or differ by exactly one bit in every segment, so that one half of the third is equal. "One
bit" is found with the perfect binary Golay code (23, 12): a segment, filled up with zeros, has
exactly one codeword within three bits, its own; a segment one bit away has that codeword within
four bits, and the other parity. Within four bits there are one or six codewords, so a segment files
itself under its own codeword and parity and looks under one or six with the other parity.

1. Documents with equal fingerprints collapse; only distinct fingerprints go on.
2. A key is two whole segments (6 of them), or a segment with the codeword index and parity of
   another (12), or one half of the third with the codeword indices of the first two and the
   parities of all (2). A fingerprint files itself under 20 keys and looks under about 126.
3. Whoever looks under a key meets the smallest fingerprint filed there (a star), and links are
   verified by the bits; these links give first components.
4. Keys with several files whose members are still in several components are gone through in blocks
   of ``BLOCK`` members: files against lookers of other components, inside tasks; one link of each
   two components comes out. No pairs are emitted, none are left out.

Defined results: texts without words have the fingerprint zero and link as any other; a null id
keeps its row and belongs to the component of its fingerprint (null if that has no id at all); rows
with equal ids are judged each by its own text; an empty table gives an empty table; only the id and
the text are read, so extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import broadcast_checked
from ..session import cut_lineage
from ._words import Words, chunks
from .components import components

DISTANCE = 4
SEED = 42
BLOCK = 2048  # members of a key on either side that are compared at once
SLICE = 1 << 16  # shingles hashed at once
GENERATOR = 0b110001110101  # Fixed value: generator polynomial of the binary Golay code, degree 11
_EQUAL = list(combinations(range(4), 2))  # two equal segments
_PAIRS = list(permutations(range(4), 2))  # an equal segment and one at one bit


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    rest = words.astype(np.int64)
    for i in range(22, 10, -1):
        rest = np.where(rest >> i & 1, rest ^ (GENERATOR << (i - 11)), rest)
    return rest


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome the error patterns of at most four bits, lightest first, and how many (one or six)."""
    of_weight = [np.array([sum(1 << i for i in c) for c in combinations(range(23), w)], dtype=np.int64) for w in range(5)]
    table, count = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for errors in of_weight:
        for s, e in zip(_syndromes(errors).tolist(), errors.tolist(), strict=True):
            table[s, count[s]] = e
            count[s] += 1
    return table, count


def _nearby() -> tuple[np.ndarray, np.ndarray]:
    """Per 16-bit segment the indices of the codewords within four bits, its own first, and which are there."""
    segments = np.arange(1 << 16, dtype=np.int64)
    table, count = _patterns()
    s = _syndromes(segments)
    return (segments[:, None] ^ table[s]) >> 11, np.arange(6) < count[s][:, None]


NEARBY, IS_NEARBY = _nearby()


def _text_hashes(w: Words, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers (ascending) and hashes of the shingles of a run of texts, in slices."""
    size = w.ends - w.starts
    begin = np.cumsum(size + 1) - (size + 1)  # of each word in a buffer with one space after each
    joined = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    inside = np.repeat(w.starts - begin, size)
    place = np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)
    joined[place] = w.buf[place + inside]
    raw = joined.tobytes()
    n = np.diff(w.bounds)
    shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), shingles)
    first = np.arange(len(doc)) + np.repeat(w.bounds[:-1] - (np.cumsum(shingles) - shingles), shingles)
    last = first + np.minimum(n, k)[doc] - 1
    for i in range(0, len(doc), SLICE):
        a, b = begin[first[i : i + SLICE]].tolist(), (begin + size)[last[i : i + SLICE]].tolist()
        yield doc[i : i + SLICE], np.fromiter((xxhash.xxh64_intdigest(raw[p:q], SEED) for p, q in zip(a, b, strict=True)), np.uint64, len(a))


def fingerprints(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, fingerprints) for runs of whole texts; nulls count as empty."""
    for a, b, buf, off in chunks(texts):
        total, ones = np.zeros(b - a, dtype=np.int64), np.zeros((b - a, 64), dtype=np.int64)
        for doc, h in _text_hashes(Words(buf, off, lower=True), k):
            at = np.flatnonzero(np.diff(doc, prepend=-1))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[doc[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
            total[doc[at]] += np.diff(at, append=len(doc))
        yield a, b, np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def _with_fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, f in fingerprints(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(f)], names=["doc_id", "f"])

    return run


def keys(f: np.ndarray, looks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and the position of the fingerprint of each: those it is filed under, or all it looks under."""
    u = f.view(np.uint64)
    part = np.stack([(u >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF for i in range(4)], axis=1)
    odd = (np.bitwise_count(part) & 1).astype(np.int64) ^ looks
    at = slice(None) if looks else slice(1)
    near, there = NEARBY[part][:, :, at], IS_NEARBY[part][:, :, at]
    out, ok = [], []
    for i, j in _EQUAL:
        out.append((part[:, i, None] << 16) | part[:, j, None])
        ok.append(np.ones((len(f), 1), dtype=bool))
    for i, j in _PAIRS:
        out.append((part[:, i, None] << 13) | (near[:, j] << 1) | odd[:, j, None])
        ok.append(there[:, j])
    both = (near[:, 0, :, None] << 16) | (near[:, 1, None, :] << 4) | (odd @ (1 << np.arange(4)))[:, None, None]
    for half in (part[:, 2] & 0xFF, part[:, 2] >> 8):
        out.append((both | (half << 28)[:, None, None]).reshape(len(f), near.shape[2] ** 2))
        ok.append((there[:, 0, :, None] & there[:, 1, None, :]).reshape(len(f), near.shape[2] ** 2))
    row, _ = np.nonzero(mask := np.concatenate(ok, axis=1))
    return np.concatenate([(tag << 36) | k for tag, k in enumerate(out)], axis=1)[mask], row


def _keyed(looks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                f = batch.column(0).slice(i, 2_000).to_numpy()
                key, row = keys(f, looks)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[row])], names=["key", "f"])

    return run


def _links_of_block(t: pa.Table) -> pa.RecordBatch:
    """One link of each two components that are linked between the files and the lookers of a block."""
    f, comp, files = (t.column(c).to_numpy() for c in ("f", "component", "files"))
    f, links = f.view(np.uint64), []
    a, b = np.flatnonzero(files), np.flatnonzero(~files)
    for i in range(0, len(a), 256):
        part = a[i : i + 256]
        near = (np.bitwise_count(f[part, None] ^ f[b]) <= DISTANCE) & (comp[part, None] != comp[b])
        x, y = np.nonzero(near)
        if len(x):
            x, y = part[x], b[y]
            _, one = np.unique(np.stack([comp[x], comp[y]]), axis=1, return_index=True)
            links.append(np.stack([f[x[one]], f[y[one]]]).view(np.int64))
    found = np.concatenate(links, axis=1) if links else np.empty((2, 0), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])


def _links_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and block pair -> links; holds the rows of one block pair."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if held and now != tuple(at[x]):
                yield _links_of_block(pa.Table.from_batches(held))
                held = []
            now = tuple(at[x])
            held.append(batch.slice(x, y - x))
    if held:
        yield _links_of_block(pa.Table.from_batches(held))


def _bits_apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _links(found: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``found`` (f) that join all that are linked at all."""
    filed = found.mapInArrow(_keyed(False), "key long, f long")
    heads = cut_lineage(filed.groupBy("key").agg(F.min("f").alias("head"), F.count(F.lit(1)).alias("n_files")), "heads")
    # most keys that are looked under hold nothing, or the looker alone; the hashed side has one row per key
    looked = found.mapInArrow(_keyed(True), "key long, f long").join(heads.hint("shuffle_hash"), "key")
    looked = cut_lineage(looked.where("n_files > 1 or head <> f"), "looked")
    star = looked.where((F.col("head") != F.col("f")) & (_bits_apart("head", "f") <= DISTANCE)).select(F.col("head").alias("a"), F.col("f").alias("b"))
    star = cut_lineage(star.distinct(), "star")
    first = components(star)

    several = heads.where("n_files > 1").select("key")
    files = filed.join(several.hint("shuffle_hash"), "key", "left_semi").withColumn("files", F.lit(True))
    members = files.unionByName(looked.where("n_files > 1").select("key", "f", F.lit(False).alias("files")))
    label = F.coalesce("component", "f").alias("component")
    members = cut_lineage(members.join(first.withColumnRenamed("node", "f"), "f", "left").select("key", "f", "files", label), "members")
    mixed = members.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count_if("files").alias("n_files"), F.count_if(~F.col("files")).alias("n_looks")
    )
    blocks = [F.ceil(F.col(c) / BLOCK).cast("int").alias(b) for c, b in (("n_files", "file_blocks"), ("n_looks", "look_blocks"))]
    left = members.join(cut_lineage(mixed.where("low < high and n_looks > 0").select("key", *blocks), "mixed"), "key")
    own = F.pmod(F.xxhash64("f"), F.when(F.col("files"), F.col("file_blocks")).otherwise(F.col("look_blocks"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("files"), F.col("look_blocks")).otherwise(F.col("file_blocks")) - 1))
    left = left.withColumn("own", own).withColumn("other", other)
    x, y = (F.when(F.col("files"), F.col(a)).otherwise(F.col(b)) for a, b in (("own", "other"), ("other", "own")))
    left = left.select("key", x.alias("x"), y.alias("y"), "f", "component", "files")
    dealt = left.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return star.unionByName(cut_lineage(dealt.mapInArrow(_links_in_blocks, "a long, b long").distinct(), "block_links"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = cut_lineage(src.mapInArrow(_with_fingerprints(k), "doc_id long, f long"), "fingerprints")
    classes = cut_lineage(prints.groupBy("f").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    labels = components(_links(classes.select("f"))).withColumnRenamed("node", "f")
    labelled = classes.join(labels, "f", "left").withColumn("component", F.coalesce("component", "f"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    of_print = labelled.join(least, "component").select("f", "component_id")
    out = prints.join(broadcast_checked(of_print, "fingerprint_components"), "f", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
