"""Pattern packing of token sequences by non-negative least squares.

Pieces of at most ``size`` tokens are put into sequences of ``size``. Their lengths make a histogram
of at most ``size`` entries, however large the corpus. Patterns of one to three lengths that fill a
sequence are enumerated, repeat counts are fitted to the histogram by non-negative least squares and
rounded; the residual is packed best-fit by length classes, together with a share of the shortest
pieces that the fit leaves out to fill it up. The plan (patterns and repeat counts) is bounded by
``size`` and solved on the driver; pieces are matched to its slots by their rank within their
length, found in two phases, so no length class meets in one task.

Documents longer than ``size`` are cut; only their first piece may be shorter than ``size``.

Defined results: null and empty texts are the end id alone; rows with equal ids are separate
documents; an empty table gives an empty table; only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import two_phase_rank
from ..session import cut_lineage
from .tokens import encoder

BUCKET_ROWS = 500  # rows of a length class that are ranked together
KEPT_BACK = (0.05, 0.1, 0.2, 0.3)  # shares of the shortest pieces that are left to the residual, in the order tried
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, kind: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as token pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, kind)
        for batch in batches:
            for a, b, off, flat in encode(batch.column(1)):
                n = np.diff(off) + 1
                ids = np.insert(flat, off[1:], end_id).astype("<u4")
                begins = np.cumsum(n) - n
                count = -(-n // size)
                first = n - (count - 1) * size
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
                length = np.where(piece == 0, first[doc], size)
                raw = memoryview(ids.tobytes())
                at = begins[doc] + start
                crc = [zlib.crc32(raw[4 * p : 4 * (p + q)]) for p, q in zip(at.tolist(), length.tolist(), strict=True)]
                cols = [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return src.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to ``size``, from the lengths there are."""
    there = np.zeros(size + 1, dtype=bool)
    there[lengths] = True
    out = [np.array([[size, 0, 0]])] if there[size] else []
    a = np.flatnonzero(there[1 : size // 2 + 1]) + 1
    two = a[there[size - a]]
    out.append(np.stack([two, size - two, 0 * two], axis=1))
    for x in a[a <= size // 3]:
        y = a[(a >= x) & (a <= (size - x) // 2)]
        y = y[there[size - x - y]]
        out.append(np.stack([0 * y + x, y, size - x - y], axis=1))
    return np.concatenate(out)


def fit(pats: np.ndarray, hist: np.ndarray, add: int = 64, rounds: int = 24, near: float = 0.005) -> np.ndarray:
    """Repeat counts x >= 0 that bring A x near ``hist`` (A: how often a pattern holds a length).

    Active set: each round takes in the patterns with the steepest descent, no length in two of
    them, solves the least squares over the set and steps back to x >= 0 as usual. The set stays
    near the number of lengths, so few counts are fractional and rounding loses little. Ends when
    the residual is below ``near`` of the pieces."""
    size = len(hist) - 1
    x = np.zeros(len(pats))
    active = np.zeros(0, dtype=int)
    cols, gram = np.zeros((size + 1, 0)), np.zeros((0, 0))
    for _ in range(rounds):
        left = hist - np.bincount(pats.ravel(), np.repeat(x, 3), size + 1)
        left[0] = 0
        if np.abs(left).sum() <= near * hist.sum():
            break
        slope = left[pats].sum(axis=1)
        slope[active] = -np.inf
        used, new = np.zeros(size + 1, dtype=bool), []
        for p in np.argsort(-slope)[: 40 * add]:
            if slope[p] <= 0.5 or len(new) == add:
                break
            lengths = pats[p][pats[p] > 0]
            if not used[lengths].any():
                used[lengths] = True
                new.append(p)
        if not new:
            break
        more = np.zeros((size + 1, len(new)))
        np.add.at(more, (pats[new].T, np.arange(len(new))), 1.0)
        more[0] = 0
        cross = cols.T @ more
        gram = np.block([[gram, cross], [cross.T, more.T @ more]])
        cols, active = np.hstack([cols, more]), np.concatenate([active, new]).astype(int)
        while len(active):
            z = np.linalg.solve(gram + 1e-6 * np.eye(len(active)), cols.T @ hist)
            bad = z < 0
            if not bad.any():
                x[active] = z
                break
            now = x[active]
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-12))
            now = np.maximum(now + step * (z - now), 0)
            gone = bad & ((now <= 1e-9) | (z < -0.05 * np.abs(z).max()))
            gone = gone if gone.any() else bad
            x[active] = np.where(gone, 0, now)
            keep = ~gone
            cols, gram, active = cols[:, keep], gram[np.ix_(keep, keep)], active[keep]
    return x


def best_fit(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over length classes: (lengths in a sequence, how many such sequences)."""
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]  # by space left
    for length in range(size, 0, -1):
        todo = int(hist[length])
        for space in range(length, size):
            moved = {}
            while todo and open_[space]:
                content, n = open_[space].popitem()
                k = min(n, todo)
                if n > k:
                    open_[space][content] = n - k
                # as many of this length as still fit, since the tightest sequence stays the tightest
                each = min((space // length), -(-todo // k))
                full = todo // each if each * k > todo else k
                moved[content, each] = moved.get((content, each), 0) + full
                todo -= full * each
                if full < k:
                    rest = todo
                    if rest:
                        moved[content, rest] = moved.get((content, rest), 0) + 1
                        todo = 0
                    back = k - full - (1 if rest else 0)
                    if back:
                        open_[space][content] = open_[space].get(content, 0) + back
            for (content, each), n in moved.items():
                slot = open_[space - each * length]
                key = content + (length,) * each
                slot[key] = slot.get(key, 0) + n
        if todo:
            each = size // length
            for n, k in ((todo // each, each), (1 if todo % each else 0, todo % each)):
                if n:
                    slot = open_[size - k * length]
                    slot[(length,) * k] = slot.get((length,) * k, 0) + n
    return [(c, n) for group in open_ for c, n in sorted(group.items())]


def rounded(pats: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts near ``x``: whole parts first, then one more each by largest remainder, as
    long as the pieces are there; they are taken off ``left``."""
    whole = np.floor(x + 1e-6)
    rest = x - whole
    some = np.flatnonzero(rest > 0.05)
    out = []
    for order, repeat in ((np.argsort(-whole, kind="stable")[: np.count_nonzero(whole)], whole), (some[np.argsort(-rest[some], kind="stable")], np.ones(len(x)))):
        for p in order:
            lengths, need = np.unique(pats[p][pats[p] > 0], return_counts=True)
            n = int(min(repeat[p], (left[lengths] // need).min()))
            if n > 0:
                left[lengths] -= n * need
                out.append((tuple(int(v) for v in pats[p][::-1] if v > 0), n))
    return out


def fitted(hist: np.ndarray, size: int, kept_back: float, rounds: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeat count): fitted patterns, and best fit for the residual.

    The shortest pieces, a share of ``kept_back``, are left out of the fit: they fill up what the long
    pieces of the residual leave. What rounding leaves over is fitted again while that finds more."""
    short = np.minimum(hist, np.maximum(int(kept_back * hist.sum()) - (np.cumsum(hist) - hist), 0))
    left, out = hist - short, []
    for _ in range(rounds):
        pats = patterns(np.flatnonzero(left), size)
        more = rounded(pats, fit(pats, left.astype(float)), left) if len(pats) else []
        if not more:
            break
        out += more
    return out + best_fit(left + short, size)


def plan(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeat count) over the whole histogram: the fit that needs the fewest sequences.

    Fits that keep back more and more short pieces are tried until one meets the lower bound, as many
    sequences as the tokens fill."""
    bound = -(-int((hist * np.arange(size + 1)).sum()) // size)
    best: list[tuple[tuple[int, ...], int]] = []
    for share in KEPT_BACK:
        found = fitted(hist, size, share)
        if not best or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) <= bound:
            break
    return best


def _slots(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) sorted by length and rank."""
    rows, next_rank, sequence = [], {}, 0
    for content, n in chosen:
        offset = 0
        for length in content:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, offset))
            next_rank[length] = rank + n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset, gapless from 0 in each sequence."""
    pieces = cut_lineage(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= size:
        raise ValueError(f"lengths must be 1 to {size}")
    hist = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        hist[length] = n
    slots = _slots(plan(hist, size))
    key = slots[:, 0] << 44 | slots[:, 1]

    buckets = F.element_at(F.array(*[F.lit(int(-(-n // BUCKET_ROWS)) or 1) for n in hist[1:]]), F.col("length").cast("int"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    ranked = two_phase_rank(pieces, "length", order, F.pmod(F.xxhash64(*order), buckets), "_rank")
    names = pieces.columns
    schema = pa.schema([*_arrow(pieces), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy() - 1
            at = np.searchsorted(key, b.column(b.schema.get_field_index("length")).to_numpy() << 44 | rank, side="right") - 1
            own = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3])], schema=schema)

    return ranked.mapInArrow(place, f"{pieces._jdf.schema().toDDL()}, sequence_id long, offset long")


def _arrow(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))
