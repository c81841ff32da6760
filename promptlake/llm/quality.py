"""Quality rules, line first: bad lines go, then documents that lost too much of their text.

Per line (lines are split at ``\\n``; a line without a word is neither judged nor counted):

* punctuation: no sentence mark anywhere in the line;
* symbols: more than one in ten characters of its words is one of ``# * $ % & | < >``;
* navigation: three or more separators, and one for every four words or denser;
* boilerplate: at most 25 words and one of the fixed phrases.

A document is kept if it passes the base checks (20 words or more; at most 30 % of its words in
8-word windows that occur twice or more in it) and its failing lines hold at most half its words.

Defined results: a null or blank text has no words and fails the base check; repeated rows are
judged one by one; an empty table gives an empty table; the other columns are passed on in the
struct ``row`` if asked for, so their names cannot clash. Map only: no shuffle, memory bounded by
one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import Words, chunks

# Marks, separators and phrases of the line rules.
SENTENCE_MARKS = "[.!?…。！？]"
SEPARATORS = "[|»›•·]"
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of (use|service)|cookie policy|uses cookies|enable javascript|"
    "lorem ipsum|click here|read more|sign up|log in|share (on|this)|skip to (main )?content"
)
WORD = "[^\\x20\\x09-\\x0D]+"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PCT = 30
MAX_LOST_PCT = 50
BOILERPLATE_WORDS = 25

_SYMBOL = np.zeros(256, dtype=np.int32)
_SYMBOL[list(b"#*$%&|<>")] = 1
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_failed_lines long, n_lost_words long, base_failed boolean, kept boolean, clean_text string"
)


def line_fails(line: str, n_words: int, word_chars: int) -> bool:
    if not _MARK.search(line):
        return True
    if 10 * len(_SYM.findall(line)) > word_chars:
        return True
    seps = len(_SEP.findall(line))
    if seps >= 3 and 4 * seps >= n_words:
        return True
    return n_words <= BOILERPLATE_WORDS and _BOILER.search(line) is not None


_MARK, _SYM, _SEP, _WORD = (re.compile(x) for x in (SENTENCE_MARKS, SYMBOLS, SEPARATORS, WORD))
_BOILER = re.compile(BOILERPLATE, re.IGNORECASE)


def _lines(text: str) -> tuple[int, int, int, str]:
    """Repeated lines, failing lines, words in failing lines, the text without failing lines."""
    seen: set[str] = set()
    dup = failed = lost = 0
    keep = []
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if words:
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fails(line, len(words), sum(map(len, words))):
                failed += 1
                lost += len(words)
                continue
        keep.append(line)
    return dup, failed, lost, "\n".join(keep)


def _repeat_words(g: np.ndarray, n: int) -> int:
    """Words covered by windows (hashes ``g``) that occur twice or more; ``n`` words in all."""
    _, inverse, counts = np.unique(g, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if len(again) == 0:
        return 0
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _measure(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        for a, b, buf, off in chunks(text):
            w = Words(buf, off)
            g = w.windows(WINDOW)
            inside = np.zeros(len(buf) + 1, dtype=np.int64)
            space = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
            np.cumsum(((buf & 0xC0) != 0x80) & ~space, out=inside[1:])
            symbols = np.zeros(len(buf) + 1, dtype=np.int64)
            np.cumsum(_SYMBOL[buf], out=symbols[1:])
            rows = []
            for i, s in enumerate(text.slice(a, b - a).to_pylist()):
                lo, hi = int(w.bounds[i]), int(w.bounds[i + 1])
                n = hi - lo
                repeat = _repeat_words(g[lo : hi - WINDOW + 1], n) if n >= WINDOW else 0
                dup, failed, lost, clean = _lines(s or "")
                base = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PCT * n
                rows.append((n, dup, repeat, failed, lost, base, not base and 100 * lost <= MAX_LOST_PCT * n, clean if with_text else None))
            n, dup, repeat, failed, lost, base, kept, clean = map(list, zip(*rows, strict=True))
            long = lambda x: pa.array(x, pa.int64())
            more = [batch.column(2).slice(a, b - a)] if batch.num_columns > 2 else []
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a).cast(pa.int64()), long(n), long(np.diff(inside[off])), long(np.diff(symbols[off])), long(dup), long(repeat), long(failed), long(lost),
                 pa.array(base, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(clean, pa.string()), *more],
                names=[*(c.split()[0] for c in SCHEMA.split(", ")), "row"][: 11 + len(more)],
            )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, with_row: bool = False) -> DataFrame:
    """Per row of ``docs``: counts, ``base_failed``, ``kept``, the text without failing lines
    (``with_text``) and a struct of the other columns (``with_row``)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = SCHEMA
    if with_row:
        rest = F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")
        src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest)
        schema += f", row {src.schema['row'].dataType.simpleString()}"
    return src.mapInArrow(lambda it: _measure(it, with_text), schema)
