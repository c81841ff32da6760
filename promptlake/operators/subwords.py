"""Subword vocabulary: merges learnt over the table of word types, and longest-match encoding.

Words are space-separated pieces, as in vocab mode. Characters outside the coverage cut words and are
encoded as bytes. A merge joins the most frequent pair of neighbouring symbols (ties: smaller left,
then smaller right symbol) everywhere, from left to right. Ids: specials and bytes as in byte mode,
then the covered characters by (count desc, character), then merged pieces in the order learnt.

A word type is held as text with a space on either side of each symbol, so that a merge is one
``replace``. One Spark job a round counts what the merges of the round change: only words that hold one
of them are taken apart. Several merges share a round as far as they are certain to be the next ones
(``_next_merges``). The driver holds the counts of at most ``tracked`` pairs and of the pairs that arise
above their floor; if those run out, or a merge makes a symbol that exists already, all pairs are
counted again. Words never reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .tokens import BYTE_OFFSET, FIRST_PIECE_ID, _col, char_coverage, covered, map_in_steps, piece_counts, piece_encoder

# Pairs the driver keeps counts of, merges of one round, merges between two rewrites of the words.
TRACKED = 1 << 14
ROUND = 32
REWRITE = 32
# Fixed value: pieces whose ids a task keeps for its next texts.
REMEMBERED = 1 << 16

Pair = tuple[str, str]


def spaced(word) -> Column:
    """A word as its characters, each with a space on either side."""
    return F.regexp_replace(_col(word), "(?s)(.)", " $1 ")


def word_types(df: DataFrame, uncovered: str = "", text: str = "text") -> DataFrame:
    """(w, n): spaced words cut at ``uncovered`` characters, with their occurrences."""
    counts = piece_counts(df, text)
    if uncovered:
        cut = F.explode(F.split(F.translate("piece", uncovered, " " * len(uncovered)), " "))
        counts = counts.select(cut.alias("piece"), "count").where(F.col("piece") != "").groupBy("piece").agg(F.sum("count").alias("count"))
    return counts.select(spaced("piece").alias("w"), F.col("count").alias("n"))


def _pair_sums(words: DataFrame, symbols: set[str] | None = None) -> DataFrame:
    """(l, r, n): occurrences of neighbouring symbols in (w, n), if asked for only of pairs with one of ``symbols``."""
    parts = words.select(F.split(F.trim("w"), "  ").alias("s"), "n").where(F.size("s") > 1)
    ends = F.size("s") - 1
    zipped = F.arrays_zip(F.slice("s", 1, ends).alias("l"), F.slice("s", 2, ends).alias("r"))
    pairs = parts.select(F.explode(zipped).alias("p"), "n").select("p.l", "p.r", "n")
    if symbols is not None:
        pairs = pairs.where(F.col("l").isin(*symbols) | F.col("r").isin(*symbols))
    return pairs.groupBy("l", "r").agg(F.sum("n").alias("n"))


def _pair_changes(words: DataFrame, done: list[Pair], batch: list[Pair]) -> DataFrame:
    """(l, r, n): how the occurrences of pairs change when the words, ``done`` merged, are merged by ``batch``.

    A word that holds a pair has its two symbols' text in one piece, whatever is merged; only such words
    are brought up to date. Only pairs with a symbol that a merge takes or makes can change."""
    piece = F.replace("w", F.lit(" "))
    near = reduce(or_, [F.contains(piece, F.lit(left + right)) for left, right in batch])
    # exploded, so that the merges so far are made once a word, not in every place that names the result
    now = words.where(near).select(F.explode(F.array(_merged(F.col("w"), done))).alias("w"), "n")
    both = now.select(F.array(F.struct("w", (-F.col("n")).alias("n")), F.struct(_merged(F.col("w"), batch).alias("w"), "n")).alias("x"))
    sides = both.where(F.col("x")[0]["w"] != F.col("x")[1]["w"]).select(F.explode("x").alias("x"))
    symbols = {s for left, right in batch for s in (left, right, left + right)}
    return _pair_sums(sides.select("x.*"), symbols).where(F.col("n") != 0)


def _merged(w: Column, merges: list[Pair]) -> Column:
    for left, right in merges:
        w = F.replace(w, F.lit(f" {left}  {right} "), F.lit(f" {left}{right} "))
    return w


def _written(words: DataFrame) -> DataFrame:
    """Words dealt to all cores and written: a round's work is by word, not by byte."""
    return cut_lineage(words.repartition(words.sparkSession.sparkContext.defaultParallelism, "w"), "word_types")


def _next_merges(counts: dict[Pair, int], floor: int, known: set[str], most: int, least: int, fresh: bool) -> tuple[list[Pair], bool]:
    """Pairs that certainly are the next merges, in order, and whether the last makes a known symbol.

    Merging (a, b) leaves pairs without a or b as they are, and a pair it makes occurs no more often than
    one with a or b had before. So pairs in order of their counts are the next merges while none shares a
    symbol with one before it, all but the first being more frequent than the first pair left out and
    than ``floor``, which the pairs not held do not exceed. Of ``fresh`` counts the first is certain in any
    case. A pair of equal symbols, or one whose symbol exists, may raise other counts and ends the round."""
    taken, used, made = [], set(), set()
    again, bound = False, floor
    for pair, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        left, right = pair
        if (n <= floor and (taken or not fresh)) or n < least or len(taken) == most or again or left in used or right in used or (taken and taken[-1][0] == taken[-1][1]):
            bound = max(floor, n)
            break
        taken.append(pair)
        used |= {left, right}
        again = left + right in known or left + right in made
        made.add(left + right)
    safe = taken[:1] + [p for p in taken[1:] if counts[p] > bound]
    return safe, again and len(safe) == len(taken)


def learn_merges(words: DataFrame, size: int, least: int = 2, tracked: int = TRACKED, round_merges: int = ROUND) -> list[tuple[str, str, int]]:
    """The first ``size`` merges (left, right, occurrences when merged) over spaced words (w, n).

    Pairs of fewer than ``least`` occurrences are not merged."""
    spark = words.sparkSession
    words = _written(words)
    found: list[tuple[str, str, int]] = []
    known: set[str] = set()
    counts: dict[Pair, int] = {}
    done: list[Pair] = []  # merges that the written words do not have yet
    floor, again, fresh = 0, True, False
    while len(found) < size:
        batch: list[Pair] = []
        if not again:
            batch, again = _next_merges(counts, floor, known, min(round_merges, size - len(found)), least, fresh)
        if not batch:
            if fresh or (not again and floor < least):
                break  # no pair is left, or those not held are too rare
            top = _pair_sums(words.select(_merged(F.col("w"), done).alias("w"), "n")).where(F.col("n") >= least).orderBy(F.desc("n"), "l", "r").limit(tracked).collect()
            counts = {(r.l, r.r): r.n for r in top}
            floor = top[-1].n if len(top) == tracked else 0
            again, fresh = False, True
            continue
        fresh = False
        if not again:
            deltas = _pair_changes(words, done, batch)
            if floor:
                symbols = {s for p in batch for s in p}
                touched = [p for p in counts if p[0] in symbols or p[1] in symbols]
                keys = F.broadcast(spark.createDataFrame(touched, "l string, r string"))  # at most the tracked pairs
                old = deltas.join(keys.withColumn("held", F.lit(True)), ["l", "r"], "left")
                deltas = old.where(F.col("held") | (F.col("n") > floor))
            rows = deltas.select("l", "r", "n").collect()
        found += [(left, right, counts[(left, right)]) for left, right in batch]
        known |= {left + right for left, right in batch}
        if not again:
            for r in rows:
                counts[(r.l, r.r)] = counts.get((r.l, r.r), 0) + r.n
            counts = {p: n for p, n in counts.items() if n > floor}
        done += batch
        if len(done) >= REWRITE:
            words, done = _written(words.select(_merged(F.col("w"), done).alias("w"), "n")), []
    return found


def subword_merges(df: DataFrame, size: int, coverage: float = 0.99999, text: str = "text", least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Covered characters (ch, count) and merges (step, left, right, piece, count) of the texts.

    Null and empty texts have no words. The driver holds the characters (at most those of Unicode) and
    the ``size`` merges."""
    spark = df.sparkSession
    chars = cut_lineage(char_coverage(df, 1.0, text), "chars")
    kept = covered(chars, coverage).where(F.col("ch") != " ")
    rare = chars.where(F.col("ch") != " ").join(kept.select("ch"), "ch", "left_anti")
    uncovered = "".join(sorted(r.ch for r in rare.select("ch").collect()))
    merges = learn_merges(word_types(df, uncovered, text), size, least)
    rows = [(i + 1, left, right, left + right, n) for i, (left, right, n) in enumerate(merges)]
    return kept, spark.createDataFrame(rows, "step int, left string, right string, piece string, count long")


def subword_vocab(chars: DataFrame, merges: DataFrame) -> DataFrame:
    """(piece, id) of covered characters and merged pieces; a piece made by two merges has one id."""
    by_count = [r.ch for r in chars.orderBy(F.desc("count"), "ch").collect()]
    pieces = list(dict.fromkeys(by_count + [r.piece for r in merges.orderBy("step").collect()]))
    return chars.sparkSession.createDataFrame([(p, FIRST_PIECE_ID + i) for i, p in enumerate(pieces)], "piece string, id int")


def longest_match(ids: dict[str, int]):
    """Function from a piece to ids: the longest known prefix each time, the bytes of a character that is not known."""
    longest = max(map(len, ids), default=1)

    def encode(piece: str) -> list[int]:
        out, at = [], 0
        while at < len(piece):
            for end in range(min(len(piece), at + longest), at, -1):
                if piece[at:end] in ids:
                    out.append(ids[piece[at:end]])
                    break
            else:
                end = at + 1
                out += [b + BYTE_OFFSET for b in piece[at].encode()]
            at = end
        return out

    return encode


def subword_tokenize(df: DataFrame, vocab: DataFrame, key: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Texts as subword ids, a space byte between words, over Arrow batches and without a shuffle. The
    vocabulary, of the size asked for, goes to the tasks as a broadcast table. Null stays null."""
    table = {r["piece"]: r["id"] for r in vocab.select("piece", "id").collect()}
    shared = df.sparkSession.sparkContext.broadcast(table)

    def encoder() -> Callable[[pa.Array], pa.Array]:
        return piece_encoder(lru_cache(maxsize=REMEMBERED)(longest_match(shared.value)))

    return map_in_steps(df, key, text, out, T.ArrayType(T.IntegerType()), encoder)


def ids_decoder(pieces: dict[int, bytes]) -> Callable[[pa.Array], pa.Array]:
    """Function from an array of id lists to texts: the bytes of all lists are gathered at once and cut per
    list. Ids without bytes are skipped."""
    most = max(pieces, default=0)
    size = np.zeros(most + 2, dtype=np.int64)
    for i, b in pieces.items():
        size[i] = len(b)
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(pieces[i] for i in sorted(pieces)), dtype=np.uint8)

    def decode(ids: pa.Array) -> pa.Array:
        values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        values[(values < 0) | (values > most)] = most + 1
        rows = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size[values])))
        data = flat[np.repeat(first[values] - ends[:-1], size[values]) + np.arange(ends[-1])]
        cuts = ends[np.concatenate(([0], np.cumsum(rows)))]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        null = pc.is_null(ids)
        try:
            texts = raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())
        return pc.if_else(null, pa.scalar(None, pa.string()), texts)

    return decode


def subword_decode(df: DataFrame, vocab: DataFrame, key: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Subword ids back to texts; specials are skipped, invalid UTF-8 is replaced."""
    table = {r["id"]: r["piece"].encode() for r in vocab.select("piece", "id").collect()}
    shared = df.sparkSession.sparkContext.broadcast(table | {b + BYTE_OFFSET: bytes([b]) for b in range(256)})
    return map_in_steps(df, key, ids, out, T.StringType(), lambda: ids_decoder(shared.value))
