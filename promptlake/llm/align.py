"""Alignment of two tokenisations of a text, and how often their tokens end together.

Tokeniser A (``tokenizers``, byte-level) encodes a space and the text, B (``sentencepiece``, which
adds that space itself) the text; neither adds special tokens, and the strings of special tokens
inside a text are plain text. Both give the bytes of the same string, so a token is a byte range.
Where an A and a B token end together the pair is a link, and the string is cut into groups.

Merging runs in lockstep: every text (a long one in parts of ``LANE_BYTES``, which cannot share an
end) is a lane with a pointer into the ends of its A and B tokens. One NumPy state vector holds the
pointers of all lanes of a run of texts. A step compares the ends under all pointers, emits the
lanes that are equal as links and cuts, advances the smaller pointer (both if equal), and compacts
the lanes that are done. No token has no bytes, so ends differ within a tokeniser.

Counts of linked id pairs grow with the corpus, so they are never in one place: a run of texts (a
block) sums its distinct pairs, the sums are added by pair and compared with the highest of the B id
(one row per id of B's vocabulary, so that table is broadcast), and totals go back to the blocks
that hold the pair. Texts are read once; links wait in a written table.

Defined results: null and empty texts, and those that a tokeniser does not give back byte by byte,
have no tokens: counts are zero and ``groups_sha256`` is empty. Null ids keep their row, rows with
equal ids are each aligned, ties share the highest count, an empty table gives an empty table; only
the id and the text are read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import cut_lineage
from ._words import chunks
from .tokens import _ALPHABET, _cuts

TEXT_BYTES = 1 << 21  # text of a block
ROWS = 1024  # rows of a block at most
LANE_BYTES = 512
CACHE_PIECES = 100_000  # pieces remembered per worker and tokeniser
DIGITS = 1 << 18  # tokens written out at once
_coders: dict[str, Coder] = {}


class Coder:
    """Ids of texts from their distinct pieces, which the tokeniser treats independently.

    ``cuts`` finds the pieces, ``encode`` gives the ids of each, ``token_bytes`` the bytes of every id."""

    def __init__(self, cuts: Callable, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]):
        self.cuts, self._encode, self.size = cuts, encode, len(token_bytes)
        self.lengths = np.fromiter(map(len, token_bytes), np.int32, len(token_bytes))
        self._begin = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self._table = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self._known: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as 32-bit integers."""
        found = [self._known.get(p) for p in pieces]
        rest = [i for i, f in enumerate(found) if f is None]
        for a in range(0, len(rest), 10_000):
            part = rest[a : a + 10_000]
            coded = self._encode([pieces[j] for j in part])
            flat, at = array("I", chain.from_iterable(coded)).tobytes(), 0
            for i, ids in zip(part, coded, strict=True):
                end = at + 4 * len(ids)
                found[i] = flat[at:end]
                at = end
        if len(self._known) < CACHE_PIECES:
            self._known.update((pieces[i], found[i]) for i in rest[: CACHE_PIECES - len(self._known)])
        return found

    def _joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of tokens."""
        n = self.lengths[ids]
        ends = np.cumsum(n, dtype=np.int32)
        return self._table[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(self._begin[ids] - ends + n, n)]

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a run of texts, where each text starts among them, and whether their bytes are the text."""
        starts = self.cuts(buf, offsets)
        ends = np.append(starts, len(buf)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
        coded = self._ids(pieces.dictionary.to_pylist())
        n = np.fromiter(map(len, coded), np.int32, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), dtype=np.uint32)
        code = pieces.indices.to_numpy()
        to = np.concatenate(([0], np.cumsum(n[code], dtype=np.int64)))
        first = np.cumsum(n, dtype=np.int32) - n
        ids = flat[np.arange(to[-1], dtype=np.int32) + np.repeat(first[code] - to[:-1].astype(np.int32), n[code])]
        where = np.searchsorted(starts, offsets)
        bounds = to[where]
        bad = np.concatenate(([0], np.cumsum(self._differ(pieces.dictionary, flat, first, n)[code])))[where]
        same = np.ones(len(offsets) - 1, dtype=bool)
        for i in np.flatnonzero(np.diff(bad)).tolist():  # a piece alone may differ and the text not
            same[i] = np.array_equal(self._joined(ids[bounds[i] : bounds[i + 1]]), buf[offsets[i] : offsets[i + 1]])
        return ids, bounds, same

    def _differ(self, pieces: pa.Array, flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which pieces are not the bytes of their tokens."""
        size = pc.binary_length(pieces).to_numpy()
        upto = np.concatenate(([0], np.cumsum(self.lengths[flat], dtype=np.int64)))
        out = size != upto[first + n] - upto[first]
        raw = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)[: size.sum()]
        unlike = self._joined(flat[np.repeat(~out, n)]) != raw[np.repeat(~out, size)]
        out[np.repeat(np.arange(len(n))[~out], size[~out])[unlike]] = True
        return out


def byte_coder(path: str) -> Coder:
    if path not in _coders:
        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        tok.encode_special_tokens = True
        code = {c: b for b, c in _ALPHABET.items()}
        entries = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
        token_bytes = [bytes(code.get(c, 0) for c in t) for t in entries]
        _coders[path] = Coder(_cuts, lambda pieces: [e.ids for e in tok.encode_batch_fast(pieces, add_special_tokens=False)], token_bytes)
    return _coders[path]


def _piece_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pieces start at a run of spaces, at a newline and after one."""
    space, line = buf == 0x20, buf == 0x0A
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[:-1] = line | space
    edge[1:-1] &= ~(space[1:] & space[:-1])
    edge[1:] |= line
    edge[offsets] = True
    edge[-1] = False
    return np.flatnonzero(edge)


def _text_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])


def piece_coder(path: str) -> Coder:
    """Texts start with the space that the model adds.

    They are cut only if no entry holds a newline, or a space behind another character, and the model
    changes no text before it encodes it; otherwise they stay whole."""
    if path not in _coders:
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto()).normalizer_spec
        entries = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        token_bytes = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(entries)]
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        cut = plain and not any("\n" in t or "▁" in t.lstrip("▁") for t in entries)
        line = len(sp.encode("\n"))  # tokens of the added space and a newline, which no entry goes over

        def encode(pieces: list[str]) -> list[list[int]]:
            alone = [len(p) > 1 and p[0] == " " for p in pieces]  # the model adds the space itself
            coded = sp.encode([p[1:] if a else "\n" + p for p, a in zip(pieces, alone, strict=True)], num_threads=1)
            return [ids if a else ids[line:] for ids, a in zip(coded, alone, strict=True)]

        whole = lambda texts: sp.encode([t[1:] for t in texts], num_threads=1)
        _coders[path] = Coder(_piece_cuts, encode, token_bytes) if cut else Coder(_text_cuts, whole, token_bytes)
    return _coders[path]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) of the A and B tokens that end together; ends are ascending over all texts."""
    parts = np.maximum(-(-np.diff(offsets) // LANE_BYTES), 1)
    begin = np.repeat(offsets[:-1], parts) + LANE_BYTES * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    edges = np.append(begin, offsets[-1])
    at_a, at_b = np.searchsorted(ends_a, edges, side="right"), np.searchsorted(ends_b, edges, side="right")
    state = np.stack([at_a[:-1], at_b[:-1], at_a[1:], at_b[1:]])  # pointers and where their lanes end
    links = []
    while True:
        open_ = (state[0] < state[2]) & (state[1] < state[3])
        if not open_.all():
            state = state[:, open_]
        if state.shape[1] == 0:
            break
        a, b = ends_a[state[0]], ends_b[state[1]]
        together = a == b
        links.append(state[:2, together])
        state[0] += a <= b
        state[1] += b <= a
    found = np.concatenate(links, axis=1) if links else np.empty((2, 0), dtype=np.int64)
    return tuple(found[:, np.argsort(found[0])])


def _written(ids_a: np.ndarray, ids_b: np.ndarray, links: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The groups ``a1,a2|b1;a3|b2,b3;`` of a run of texts in slices: bytes, and how many are of each token.

    Tokens stand in order of their groups, those of A first."""
    last_a, last_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
    last_a[links[0]], last_b[links[1]] = True, True
    n = len(ids_a) + len(ids_b)
    order, mark = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.uint8)
    place_a = np.arange(len(ids_a)) + np.concatenate(([0], links[1] + 1))[np.cumsum(last_a) - last_a]
    place_b = np.arange(len(ids_b)) + (links[0] + 1)[np.cumsum(last_b) - last_b]
    order[place_a], order[place_b] = ids_a, ids_b
    mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    digits, width = _decimals(int(order.max(initial=0)) + 1)
    for s in range(0, n, DIGITS):
        x = order[s : s + DIGITS]
        cells, end = digits[x], width[x]
        cells[np.arange(len(x)), end] = mark[s : s + DIGITS]
        yield cells[np.arange(cells.shape[1], dtype=np.uint8) <= end[:, None]], end + 1


@cache
def _decimals(upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below ``upto``, from the left in cells with room for a mark, and how many they have."""
    x = np.arange(1 << (upto - 1).bit_length())
    width = (1 + np.searchsorted(10 ** np.arange(1, 10), x, side="right")).astype(np.uint8)
    cells = np.zeros((len(x), int(width.max()) + 1), dtype=np.uint8)
    for i in range(cells.shape[1] - 1):
        cells[:, i] = 48 + x // 10 ** np.maximum(width.astype(np.int64) - 1 - i, 0) % 10
    return cells, width


def _groups(ids_a, bounds_a, ids_b, bounds_b, links, with_groups: bool) -> tuple[list[str], list[str | None]]:
    """Digest and, if asked for, the groups of each text."""
    upto = bounds_a + bounds_b  # tokens of both before each text
    live = np.flatnonzero(np.diff(upto)).tolist()
    digests, texts = [""] * (len(upto) - 1), [None] * (len(upto) - 1)
    now, seen, parts = hashlib.sha256(), 0, []
    doc = iter(live)
    i = next(doc, None)
    for flat, size in _written(ids_a, ids_b, links):
        raw, to = flat.tobytes(), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        at = seen
        while i is not None and at < seen + len(size):
            end = min(int(upto[i + 1]), seen + len(size))
            done = end == upto[i + 1]
            part = raw[to[at - seen] : to[end - seen] - done]
            now.update(part)
            if with_groups:
                parts.append(part)
            at = end
            if done:
                digests[i], texts[i] = now.hexdigest(), b"".join(parts).decode() if with_groups else None
                now, parts, i = hashlib.sha256(), [], next(doc, None)
        seen += len(size)
    return digests, texts


def _kept(ids: np.ndarray, bounds: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds without those of the texts that are not ``ok``."""
    n = np.diff(bounds)
    return (ids if ok.all() else ids[np.repeat(ok, n)]), np.concatenate(([0], np.cumsum(n * ok)))


def _ends(coder: Coder, ids: np.ndarray, bounds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each token ends in the buffer of its texts."""
    n = np.diff(bounds)
    ends = np.cumsum(coder.lengths[ids], dtype=np.int64)
    before = np.concatenate(([0], ends))[bounds[:-1]]
    return ends + np.repeat(offsets[:-1] - before, n)


def _narrow(path_a: str, path_b: str) -> np.dtype:
    """The unsigned integers that a link is kept in."""
    size = max(byte_coder(path_a).size, piece_coder(path_b).size)
    return np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)


def _aligned(path_a: str, path_b: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kind = TaskContext.get().partitionId() << 32, _narrow(path_a, path_b)
        a, b = byte_coder(path_a), piece_coder(path_b)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
            for first, end, buf, offsets in chunks(text, TEXT_BYTES):
                (ids_a, bounds_a, ok_a), (ids_b, bounds_b, ok_b) = a(buf, offsets), b(buf, offsets)
                ok = ok_a & ok_b
                (ids_a, bounds_a), (ids_b, bounds_b) = _kept(ids_a, bounds_a, ok), _kept(ids_b, bounds_b, ok)
                links = lockstep(_ends(a, ids_a, bounds_a, offsets), _ends(b, ids_b, bounds_b, offsets), offsets)
                of_doc = np.searchsorted(links[0], bounds_a)
                digests, groups = _groups(ids_a, bounds_a, ids_b, bounds_b, links, with_groups)
                pairs = np.stack([ids_a[links[0]], ids_b[links[1]]], axis=1).astype(kind)
                n = pa.array(np.diff(of_doc))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(end - first, block)),
                        batch.column(0).slice(first, end - first),
                        pa.array(np.diff(bounds_a)),
                        pa.array(np.diff(bounds_b)),
                        n,
                        n,
                        pa.array(digests, pa.string()),
                        pa.array(groups, pa.string()),
                        pa.array([pairs[x:y].tobytes() for x, y in zip(of_doc[:-1], of_doc[1:], strict=True)], pa.binary()),
                    ],
                    names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "links"],
                )
                block += 1
            pa.default_memory_pool().release_unused()  # a worker lives on after its task

    return run


def _pairs(links: list[bytes], kind: np.dtype) -> np.ndarray:
    """Links as one number each: the B id below the A id."""
    x = np.frombuffer(b"".join(links), dtype=kind).reshape(-1, 2).astype(np.int64)
    return (x[:, 0] << 32) | x[:, 1]


def _block_pairs(kind: np.dtype):
    """Distinct pairs and their sums of each run of rows of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x < y:
                    pair, n = np.unique(_pairs(batch.column(1).slice(x, y - x).to_pylist(), kind), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block[x])), pa.array(pair), pa.array(n)], names=["block", "pair", "n"])

    return run


def _scored(kind: np.dtype, with_groups: bool):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        pair, first = np.unique(totals.column("pair").to_numpy(), return_index=True)
        total, best = (totals.column(c).to_numpy()[first].astype(np.int64) for c in ("total", "best"))
        links = docs.column("links").to_pylist()
        at = np.searchsorted(pair, _pairs(links, kind))
        bounds = np.concatenate(([0], np.cumsum([len(x) // (2 * kind.itemsize) for x in links])))
        sums = [np.diff(np.concatenate(([0], np.cumsum(x[at])))[bounds]) for x in (best, total)]
        out = docs.drop_columns(["block", "links"] + ([] if with_groups else ["groups"]))
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (and ``groups``), n_best, count_sum.

    ``groups``: ids of A and of B of each group, ``a1,a2|b1;a3|b2,b3`` (null without tokens).
    ``n_best``: links whose pair is linked as often in all documents as any pair with its B id.
    ``count_sum``: over the links, how often their pair is linked in all documents."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    rows = cut_lineage(src.mapInArrow(_aligned(path_a, path_b, with_groups), f"block long, {counts}, groups string, links binary"), "aligned")
    kind = _narrow(path_a, path_b)
    pairs = cut_lineage(rows.select("block", "links").mapInArrow(_block_pairs(kind), "block long, pair long, n long"), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    summed = cut_lineage(pairs.groupBy("pair").agg(F.sum("n").alias("total")).select("pair", b_id, "total"), "pair_counts")
    highest = F.broadcast(summed.groupBy("b").agg(F.max("total").alias("highest")))  # a row per id of B's vocabulary at most
    totals = summed.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    back = pairs.select("block", "pair").join(totals, "pair")
    shape = f"{counts}, {'groups string, ' if with_groups else ''}n_best long, count_sum long"
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scored(kind, with_groups), shape)
