"""Benchmark decontamination: exact containment of item-sized windows by a prefix-filtered set join.

Texts are lower-cased (A-Z) and cut into words. A window is ``size`` consecutive words of an item
(an item of fewer words is one window). For containment of a whole window every word of it is
necessary, so a prefix of one word suffices: the rarest word of the window by its count over all
documents. Document words join the windows' rarest words; the length bound and the position of
that word in the window fix where the window would have to lie, and the words there are compared.

DataFrame functions only. The windows (a function of the benchmark, not of the documents) are
broadcast if their measured size is within ``MAX_WINDOW_BYTES``; explode, lookup and comparison
then run in one pass over the documents without a shuffle of their words. Beyond it the join is a
shuffled one on (word) and the comparison joins the documents back by id.

Defined results: null, empty and word-less texts have no words and no hits, null items no windows;
rows with equal item ids are one item of several texts; documents with equal ids are told apart by
nothing, so each of them reports the hits of all; a null id reports no hits; empty tables give no
rows or no hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a lower-cased text
MAX_WINDOW_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased; the first and the last may be empty strings."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)
    return F.split(F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)), NOT_WORD)


def _count(words: Column) -> Column:
    return F.size(words) - (F.element_at(words, 1) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """(item_id, window): the distinct windows of each item."""
    w = items.select("item_id", F.filter(words_of(F.col("text")), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - F.lit(size) + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()


def occurrences(docs: DataFrame, items: DataFrame, size: int = 10, max_window_bytes: int = MAX_WINDOW_BYTES) -> DataFrame:
    """(doc_id, at, length, item_id): where item windows occur; ``at`` counts the document's words from 0."""
    windows = cut_lineage(windows_of(items, size), "windows")
    small = (windows.agg(F.sum(F.octet_length(F.concat_ws(" ", "window")) + 64)).first()[0] or 0) <= max_window_bytes
    near = F.broadcast if small else (lambda df: df)
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()

    texts = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    each = texts.select(F.explode("words").alias("word")).join(near(vocabulary), "word", "left_semi")
    counts = cut_lineage(vocabulary.join(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "word_counts")

    # the prefix of each window: its rarest word (ties: the word itself, then the first place)
    placed = windows.select("item_id", "window", F.posexplode("window").alias("place", "word")).join(near(counts), "word")
    rarest = placed.groupBy("item_id", "window").agg(F.min(F.struct("n", "word", "place")).alias("p"))
    prefix = cut_lineage(rarest.select("item_id", "window", F.size("window").alias("length"), F.col("p.word").alias("word"), F.col("p.place").alias("place")), "prefixes")

    start = F.col("pos") - F.col("place")
    fits = (start >= 0) & (start + F.col("length") <= F.size("words"))
    same = F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("length")) == F.col("window")
    if small:
        hits = texts.select("doc_id", "words", F.posexplode("words").alias("pos", "word")).join(F.broadcast(prefix), "word").where(fits & same)
    else:
        spots = texts.select("doc_id", F.posexplode("words").alias("pos", "word")).join(prefix, "word").where(start >= 0)
        hits = spots.join(texts, "doc_id").where(fits & same)
    lead = (F.element_at("words", 1) == "").cast("int")
    return hits.select("doc_id", (start - lead).alias("at"), "length", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_window_bytes: int = MAX_WINDOW_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids, as strings), contaminated."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    found = cut_lineage(occurrences(src, bench, size, max_window_bytes), "occurrences")
    hit = found.select("doc_id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("pos")).distinct()
    hit = hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    # the items of one document: no more than the benchmark has
    of_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    marks = cut_lineage(hit.join(of_doc, "doc_id"), "marks")
    counted = src.select("doc_id", _count(words_of(F.col("text"))).cast("long").alias("n_words"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(marks, "doc_id", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n_hit > 0).alias("contaminated")
    )
