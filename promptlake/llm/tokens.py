"""Encoding whole texts with a given tokenizer file: distinct text pieces are encoded once.

A text is cut into pieces that the tokenizer treats independently; each distinct piece of a batch
is encoded by the ``tokenizers`` library and the ids are put together with numpy, which equals
encoding the whole text. Cuts are made only where both byte-level and word pre-tokenizers always
cut, whatever stands further away:

* before a single space, and before and after a single ``\\n``, between two visible characters;
* between a letter and an ASCII mark other than the apostrophe (contractions hold one).

"Visible" and "letter" mean ASCII or U+00C0 to U+00FF; anything else is not cut at. A text that
holds ``<|``, as special tokens do, stays whole. A piece of letters goes to the tokenizer's model
in the byte alphabet (normaliser and pre-tokenizer leave it whole), every other piece through the
full tokenizer.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from ._words import chunks

CACHE_PIECES = 200_000  # pieces remembered per worker; others are encoded again when they occur
TEXT_BYTES = 1 << 22  # text handled at once

_PLAIN = {"space": re.compile(" ?([a-zß-öø-ÿ]+)"), "byte": re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _VISIBLE, _MARK = (np.zeros(256, dtype=bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_VISIBLE[33:127] = True
_MARK[[i for i in range(33, 65) if not 48 <= i < 58 and i != 39]] = True
_encoders: dict[tuple[str, str], Callable] = {}


def _byte_alphabet() -> dict[int, str]:
    """Latin-1 code of a byte -> the character that stands for it in a byte-level vocabulary."""
    chars = sorted(ByteLevel.alphabet())
    kept = {ord(c) for c in chars if ord(c) < 256}
    moved = iter(c for c in chars if ord(c) >= 256)
    return {b: chr(b) if b in kept else next(moved) for b in range(256)}


_ALPHABET = _byte_alphabet()


def _cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of each piece."""
    n = len(buf)
    lead = buf == 0xC3  # of U+00C0 to U+00FF
    high = np.zeros(n, dtype=bool)
    high[1:] = lead[:-1]
    times = np.zeros(n, dtype=bool)  # the two signs among those letters
    times[1:] = lead[:-1] & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
    letter_end = _LETTER[buf] | (high & ~times)
    seen_end, seen_start = _VISIBLE[buf] | high, _VISIBLE[buf] | lead
    edge = np.zeros(n + 1, dtype=bool)
    if n > 2:
        between = seen_end[:-2] & seen_start[2:]
        space, line = between & (buf[1:-1] == 0x20), between & (buf[1:-1] == 0x0A)
        edge[1 : n - 1] |= space | line
        edge[2:n] |= line
    edge[1:n] |= letter_end[: n - 1] & _MARK[buf[1:]]
    raw = buf.tobytes()
    at = raw.find(b"<|")
    while at >= 0:
        doc = int(np.searchsorted(offsets, at, side="right"))
        edge[offsets[doc - 1] : offsets[doc]] = False
        at = raw.find(b"<|", int(offsets[doc]))
    edge[offsets] = True
    edge[n] = False
    return np.flatnonzero(edge)


def encoder(path: str, kind: str) -> Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Encoder of a string array: yields (first, end, offsets, ids) for runs of whole texts.

    ``kind``: ``space`` for a tokenizer that lowers case and drops white space, ``byte`` for a
    byte-level one that keeps everything. Nulls count as empty."""
    if (path, kind) in _encoders:
        return _encoders[path, kind]
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    model, plain, cache = tok.model, _PLAIN[kind].fullmatch, {}

    def ids_of(pieces: list[str]) -> list[bytes]:
        """Ids of each piece as native 32-bit integers."""
        found = [cache.get(p) for p in pieces]
        rest = []
        for i, f in enumerate(found):
            if f is None:
                if m := plain(pieces[i]):
                    found[i] = array("I", [t.id for t in model.tokenize(m[m.lastindex or 0].encode().decode("latin-1").translate(_ALPHABET))]).tobytes()
                else:
                    rest.append(i)
        for a in range(0, len(rest), 10_000):
            part = rest[a : a + 10_000]
            for i, e in zip(part, tok.encode_batch_fast([pieces[j] for j in part], add_special_tokens=False), strict=True):
                found[i] = array("I", e.ids).tobytes()
        if len(cache) < CACHE_PIECES:
            cache.update(zip(pieces, found, strict=True))
        return found

    def encode(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for a, b, buf, offsets in chunks(text, TEXT_BYTES):
            if kind == "space" and b"<|" not in buf.tobytes():
                buf = _LOWER[buf]
            starts = _cuts(buf, offsets)
            where = np.searchsorted(starts, offsets)
            ends = np.append(starts, len(buf)).astype(np.int64)
            pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf)))
            coded = pieces.dictionary_encode()
            each = ids_of(coded.dictionary.to_pylist())
            size = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
            flat = np.frombuffer(b"".join(each), dtype=np.uint32)
            first = np.cumsum(size) - size
            code = coded.indices.to_numpy()
            n = size[code]
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = flat[np.arange(ends[-1]) + np.repeat(first[code] - ends[:-1], n)] if len(code) else flat[:0]
            yield a, b, ends[where], ids
        pa.default_memory_pool().release_unused()  # a worker lives on after its task

    _encoders[path, kind] = encode
    return encode
