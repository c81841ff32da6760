"""Line dedup by winnowing over line hashes.

A text's lines are split at ``\\n``; blank lines are not counted. A window is ``run`` consecutive
lines, or, if ``words`` is given, fewer that hold more than ``words`` words together. With it, each
line starts one window and ends one, the shortest: these cover every repeated passage of ``run``
lines or of more than ``words`` words, also one that stands on a single line. The smallest line hash of a window (ties: the first) is its fingerprint, so every repeated
passage of that size shares a fingerprint with its copies at the same place. Fingerprints
that occur at one place only end there. The windows around the others are joined with the first
place where their whole line sequence occurs; adjoining windows are united, and the lines of all later copies are deleted. Exactly those lines go that a window
covers whose lines also occur at an earlier place (smaller id, or earlier in the same text).

DataFrame functions only. Fingerprints and windows are aggregated with partial sums before they
are joined, from written tables, so a line or a run that is everywhere can be split.

Defined results: a null text stays null and has no lines; texts of fewer than ``run`` lines lose
nothing unless they hold more than ``words`` words; a null id counts as the smallest and keeps its lines; rows with equal ids and texts are
one document, each gets its result; with equal ids and other texts they are told apart, and windows
at the same line number of them count as one place; empty tables give empty tables; the other
columns are returned in the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hof import let
from ..session import cut_lineage


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _plain(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\f\x0b", "    "))


def _windows(text: Column, run: int, words: int | None) -> Column:
    """Array of windows: line numbers, fingerprint and a 128-bit hash of the lines."""
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    solid = F.filter(numbered, lambda r: _plain(r["x"]) != "")
    size = (lambda x: F.lit(0)) if words is None else (lambda x: F.size(F.split(_plain(x), " +")))
    hashed = F.transform(solid, lambda r: F.struct(F.xxhash64(r["x"]).alias("h"), r["i"].alias("i"), F.xxhash64(F.lit("b"), r["x"]).alias("g"), size(r["x"]).alias("n")))

    def windows(a: Column, length: int) -> Column:
        starts = F.when(F.size(a) >= length, F.sequence(F.lit(1), F.size(a) - length + 1)).otherwise(F.array().cast("array<int>"))
        if words is not None:

            def total(s: Column, first: int, end: int) -> Column:
                return sum((F.get(a, s - 1 + j)["n"] for j in range(first, end)), F.lit(0))

            def shortest(s: Column) -> Column:
                long = F.lit(length == run) | (total(s, 0, length) > words)
                return long & ((total(s, 0, length - 1) <= words) | (total(s, 1, length) <= words))

            starts = F.filter(starts, shortest)
        return F.transform(
            starts,
            lambda s: let(
                F.slice(a, s, length),
                lambda w: F.struct(
                    w["i"].alias("lines"),
                    F.array_min(w).alias("least"),
                    F.xxhash64(w["h"], w["g"]).alias("k1"),
                    F.xxhash64(w["g"], w["h"]).alias("k2"),
                ),
            ),
        )

    lengths = range(run if words is None else 1, run + 1)
    return let(hashed, lambda a: F.concat(*[windows(a, k) for k in lengths]))


def dedup_lines(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text without later repeated runs, n_lines, n_removed, row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"))
    src = src.withColumn("text_hash", F.xxhash64("text"))
    place = F.struct("doc_id", F.col("lines")[0].alias("line"))
    windows = src.where("text is not null").select("doc_id", "text_hash", F.explode(_windows(F.col("text"), run, words)).alias("w"))
    windows = windows.select("doc_id", "text_hash", F.col("w.lines").alias("lines"), F.col("w.least.h").alias("fp"), F.col("w.least.i").alias("fp_line"), F.col("w.k1").alias("k1"), F.col("w.k2").alias("k2"))
    windows = cut_lineage(windows, "line_windows")

    at = F.struct("doc_id", "fp_line")
    again = windows.groupBy("fp").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo < hi").select("fp")
    likely = windows.join(cut_lineage(again, "fingerprints"), "fp", "left_semi").select("doc_id", "text_hash", "lines", "k1", "k2")
    likely = cut_lineage(likely, "candidates")
    first = likely.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    later = likely.join(cut_lineage(first, "first_places"), ["k1", "k2"]).where(F.col("first") < place)
    gone = later.select("doc_id", "text_hash", F.explode("lines").alias("line")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("gone"))
    gone = cut_lineage(gone, "deleted_lines")

    # dense marks up to the last deleted line: linear in the lines, however many are deleted
    marks = F.flatten(
        F.zip_with("gone", F.concat(F.array(F.lit(-1)), F.col("gone")), lambda a, b: F.when(a.isNotNull(), F.concat(F.array_repeat(F.lit(False), a - b - 1), F.array(F.lit(True)))).otherwise(F.array().cast("array<boolean>")))
    )
    # deletions grow with the corpus: a merge join at every size
    marked = gone.select("doc_id", "text_hash", marks.alias("marks"), F.size("gone").alias("n_gone")).hint("merge")
    joined = src.join(marked, ["doc_id", "text_hash"], "left")
    left = let(F.struct(_lines(F.col("text")).alias("x"), F.col("marks").alias("m")), lambda s: F.filter(s["x"], lambda x, i: ~F.coalesce(F.get(s["m"], i), F.lit(False))))
    solid = F.size(F.filter(_lines(F.coalesce("text", F.lit(""))), lambda x: F.trim(F.translate(x, "\t\r\f\x0b", "    ")) != ""))
    return joined.select(
        "doc_id",
        F.when(F.col("n_gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", left)).alias("text"),
        solid.cast("long").alias("n_lines"),
        F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_removed"),
        "row",
    )
