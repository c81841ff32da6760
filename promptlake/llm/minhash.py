"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct k-word shingles (lower-cased A-Z; a shorter text is one shingle).

1. Sketch: each shingle draws exponentially spaced points, the j-th from the j-th of ``M`` equally
   likely intervals of an exponential, for registers without replacement; a register keeps the
   smallest point, truncated to the integer K = floor(1 - log_b x). A shingle stops drawing once
   its interval lies above all minima of its document, so a long text costs about one draw per
   shingle. Registers of a union are the maxima of the parts' registers.
2. Equal sets are collapsed to their smallest id; only these representatives go on.
3. Bands of ``ROWS`` registers are joined: every member of a band value is paired with the
   smallest id of it (a star, never all pairs).
4. For each pair the Jaccard similarity is estimated by joint maximum likelihood over the greater,
   smaller and equal registers and the set sizes; pairs far below the threshold are dropped.
5. The rest is verified on the full sets, and components of the verified links are found.
6. Band values whose members still lie in several components are gone through in blocks of
   about ``BLOCK`` members: the members outside the largest component meet the blocks of that
   component and one another. Pairs are estimated and the likely ones verified inside the task, in
   the first band they share, and only links come out. So every pair that shares a band value is
   either linked, in one component already, or found dissimilar.

A pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 < 6e-6, less above it.

Defined results: null, empty and blank texts have an empty set and no links; a null id keeps its
row with no component and ``kept`` true; rows with equal ids are judged each by its own text; an empty table gives an empty table; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import broadcast_checked
from ..session import cut_lineage
from ._words import Words, chunks, mix, shingles
from .components import components

M = 131  # registers; prime, so that a stride visits each register once
ROWS, BANDS = 4, 32
BASE = 1.001
RATE = 20.0
TOP = 65534
BLOCK = 128
MARGIN = 0.20  # a pair whose estimate is this far below the threshold is dropped: over 5 standard errors
_U = np.uint64
SKETCH = "doc_id long, n_shingles long, set_hash binary, registers binary, bands array<long>"


def sketch(elements: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Registers (n_docs x M, uint16) of the sets whose ``elements`` belong to ``doc``."""
    low = np.ones((n_docs, M))  # smallest point of each register, as a quantile of the exponential
    flat = low.reshape(-1)
    base = mix(elements ^ _U(0x9E3779B97F4A7C15))
    first = (base % _U(M)).astype(np.int64)
    stride = (1 + (base >> _U(32)) % _U(M - 1)).astype(np.int64)
    e, d = elements, doc
    for j in range(M):
        if j:
            live = low.max(axis=1)[d] > j / M
            if not live.all():
                e, d, first, stride = e[live], d[live], first[live], stride[live]
        if len(e) == 0:
            break
        u = (mix(e + _U((j + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> _U(11)) * 2.0**-53
        np.minimum.at(flat, d * M + (first + j * stride) % M, (j + u) / M)
    x = -np.log1p(-np.minimum(low, 1 - 2.0**-53)) / RATE
    k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE))
    return np.clip(k, 0, TOP + 1).astype(np.uint16)


def _bands(registers: np.ndarray) -> np.ndarray:
    r = registers[:, : ROWS * BANDS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407), r.shape[:2])
    for i in range(ROWS):
        h = mix(h * _U(31) + r[:, :, i] + _U(1))
    return h.view(np.int64)


def _lower_sets(text: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, buf, off in chunks(text):
        yield a, b, list(shingles(Words(buf, off, lower=True), k))


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _lower_sets(batch.column(1), k):
                n = np.array([len(s) for s in sets], dtype=np.int64)
                r = sketch(np.concatenate(sets), np.repeat(np.arange(b - a), n), b - a)
                bands = _bands(r)[n > 0]
                offsets = np.concatenate(([0], np.cumsum((n > 0) * BANDS)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([row.tobytes() if size else b"" for row, size in zip(r, n, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands.reshape(-1))),
                    ],
                    names=["doc_id", "n_shingles", "set_hash", "registers", "bands"],
                )

    return run


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum likelihood of the Jaccard similarity from two rows of registers and the set sizes."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    c = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-x * c) / np.log(BASE)

    def slope(j):  # of the log likelihood
        pu, pv = np.maximum(p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(p(np.maximum(v - u * j, 0)), 1e-12)
        du = -v * c / (np.log(BASE) * (1 - np.maximum(u - v * j, 0) * c))
        dv = -u * c / (np.log(BASE) * (1 - np.maximum(v - u * j, 0) * c))
        return more * du / pu + less * dv / pv - same * (du + dv) / np.maximum(1 - pu - pv, 1e-12)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave in j
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def _registers(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint16).reshape(-1, M)


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                s = b.slice(i, 20_000)
                j = estimate(_registers(s.column(4)), _registers(s.column(5)), s.column(2).to_numpy(), s.column(3).to_numpy())
                yield s.select(["a", "b"]).filter(pa.array(j >= threshold - MARGIN))

    return run


def _sets(k: int):
    """Rows with texts -> their sets as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _lower_sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "shingles"])

    return run


def _block_links(rows: pa.Table, threshold: float, percent: int) -> list[tuple[int, int]]:
    """Verified links between members of one block pair that lie in different components.

    A pair that shares an earlier band is left to the block of that band. Likely pairs are verified
    best first; once two components are joined here, their other pairs need no check."""
    band, lo, hi = (rows.column(c)[0].as_py() for c in ("band", "lo", "hi"))
    ids, comp, n = (rows.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
    left = rows.column("is_left").to_numpy()
    regs = _registers(rows.column("registers"))
    sets = rows.column("shingles").combine_chunks()
    ok = (comp[:, None] != comp[None, :]) & (np.minimum.outer(n, n) >= threshold * np.maximum.outer(n, n))
    ok &= (ids[:, None] < ids[None, :]) if lo == hi else (left[:, None] & ~left[None, :])
    i, j = np.nonzero(ok)
    if len(i) == 0:
        return []
    at = int(np.flatnonzero(_bands(regs[:1])[0] == band)[0])
    earlier = regs[:, : ROWS * at].reshape(len(regs), at, ROWS)
    likely = []
    for s in range(0, len(i), 5_000):
        p, q = i[s : s + 5_000], j[s : s + 5_000]
        new = ~(earlier[p] == earlier[q]).all(axis=2).any(axis=1)
        p, q = p[new], q[new]
        est = estimate(regs[p], regs[q], n[p], n[q])
        likely += [(-e, x, y) for e, x, y in zip(est, p, q, strict=True) if e >= threshold - MARGIN]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    links = []
    for _, x, y in sorted(likely):
        cx, cy = find(int(comp[x])), find(int(comp[y]))
        if cx != cy:
            u, v = (np.frombuffer(sets[int(k)].as_py(), dtype=np.uint64) for k in (x, y))
            both = len(np.intersect1d(u, v, assume_unique=True))
            if 100 * both >= percent * (len(u) + len(v) - both):
                root[cx] = cy
                links.append((int(ids[x]), int(ids[y])))
    return links


def _links_in_blocks(threshold: float, percent: int):
    """Rows sorted by block pair -> links; holds the rows of one block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush():
            links = _block_links(pa.Table.from_batches(held), threshold, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and key != tuple(keys[a]):
                    yield flush()
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                s = batch.slice(i, 500)
                sets = [[x for _, _, part in _lower_sets(s.column(c), k) for x in part] for c in (2, 3)]
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield s.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (the smallest id of its component)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    threshold = percent / 100
    sketches = cut_lineage(src.mapInArrow(_sketches(k), SKETCH), "sketches")
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(filled.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes.withColumnRenamed("rep", "doc_id"), ["set_hash", "n_shingles", "doc_id"], "left_semi")
    reps = cut_lineage(reps.dropDuplicates(["set_hash"]).select("doc_id", "set_hash", "n_shingles", "registers", "bands"), "reps")
    members = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = cut_lineage(members.groupBy("band").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    members = cut_lineage(members.join(shared, "band"), "members")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        pairs = cut_lineage(pairs.distinct(), name)
        t = _texts_of(src, pairs)
        full = pairs.join(t.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        return cut_lineage(full.select("a", "b", "ta", "tb").mapInArrow(_verified(k, percent), "a long, b long"), name)

    size = reps.select("doc_id", F.col("n_shingles").alias("n"), "registers")
    star = members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = star.join(size.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a")
    star = star.join(size.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "b")
    star = star.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "ra", "rb")
    linked = verify(star.mapInArrow(_likely(threshold), "a long, b long"), "star")
    first = components(linked)

    # band values that still hold several components
    label = F.coalesce("component", "doc_id").alias("component")
    labelled = members.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", "n", label)
    labelled = cut_lineage(labelled, "labelled")
    parts = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("band", F.col("top.component").alias("main"), blocks_of(F.col("top.c")).alias("main_blocks"), blocks_of(F.col("n") - F.col("top.c")).alias("other_blocks"))
    left = labelled.join(cut_lineage(mixed, "mixed"), "band")
    # members of the largest component need not meet each other: each stands in one of its blocks (numbered
    # -1, -2, ...) and meets the blocks of the others there; the others meet all those and one another
    is_main = F.col("component") == F.col("main")
    left = left.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    seat = lambda lo, hi, is_left: F.struct(lo.alias("lo"), hi.alias("hi"), is_left.alias("is_left"))
    main_seats = F.transform(upto("other_blocks"), lambda o: seat(-F.col("block") - 1, o, F.lit(True)))
    other_seats = F.concat(
        F.transform(upto("main_blocks"), lambda m: seat(-m - 1, F.col("block"), F.lit(False))),
        F.transform(upto("other_blocks"), lambda o: seat(F.least("block", o), F.greatest("block", o), F.col("block") <= o)),
    )
    placed = left.select("band", "doc_id", "component", F.explode(F.when(is_main, main_seats).otherwise(other_seats)).alias("seat"))
    placed = placed.select("band", "seat.*", "doc_id", "component")
    placed = cut_lineage(placed, "placed")
    ids = placed.select("doc_id").distinct()
    sets = src.join(broadcast_checked(ids, "left_ids"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(k), "doc_id long, shingles binary")
    sets = size.withColumnRenamed("n", "n_shingles").join(sets, "doc_id").where(F.octet_length("shingles") == 8 * F.col("n_shingles"))
    rows = placed.join(cut_lineage(sets, "left_sets"), "doc_id").select("band", "lo", "hi", "is_left", "doc_id", "component", "n_shingles", "registers", "shingles")
    rows = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    more = cut_lineage(rows.mapInArrow(_links_in_blocks(threshold, percent), "a long, b long"), "block_links")
    labels = components(linked.union(more))

    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    of_class = cut_lineage(of_class, "class_components")
    out = sketches.select("doc_id", "n_shingles", "set_hash").join(of_class, ["set_hash", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _texts_of(src: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts (doc_id, text) of the documents in pairs; their ids are broadcast only if few."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return src.join(broadcast_checked(ids, "ids"), "doc_id", "left_semi")
