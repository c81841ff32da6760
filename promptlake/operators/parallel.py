"""Parallel text: translation pairs as ``map<lang, text>`` and the machine-translation prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .interleave import index_sources


def zip_pairs(docs: DataFrame, pairs: DataFrame, lang: str = "lang", order: str = "doc_id", text: str = "text") -> DataFrame:
    """k-th document of language ``a`` aligned with the k-th of ``b`` for every (pair, a, b) row.

    Documents of the longer language without a partner are no pair and are left out. Ids are
    indexed and paired first (two equi joins on (language, index)); the texts are joined to the
    pairs last, by key. Output: ``pair, idx, translation map<string,string>`` with keys in (a, b) order.
    """
    ids = id_pairs(docs, pairs, lang, order)
    texts = docs.select(order, text)
    j = ids.join(texts.select(F.col(order).alias("id_a"), F.col(text).alias("text_a")), "id_a")
    j = j.join(texts.select(F.col(order).alias("id_b"), F.col(text).alias("text_b")), "id_b")
    return j.select("pair", "idx", F.create_map("a", "text_a", "b", "text_b").alias("translation"))


def id_pairs(docs: DataFrame, pairs: DataFrame, lang: str = "lang", order: str = "doc_id") -> DataFrame:
    """(pair, idx, a, b, id_a, id_b) of ``zip_pairs``, without texts."""
    from ..session import cut_lineage

    ix = cut_lineage(index_sources(docs.select(lang, order), lang, order), "language_index")
    left = ix.select(F.col(lang).alias("a"), "idx", F.col(order).alias("id_a"))
    right = ix.select(F.col(lang).alias("b"), "idx", F.col(order).alias("id_b"))
    return left.join(pairs, "a").join(right, ["b", "idx"]).select("pair", "idx", "a", "b", "id_a", "id_b")


def mt_unpack(df: DataFrame) -> DataFrame:
    """(src, tgt) = first two keys, (input, target) = their values."""
    k, v = F.map_keys("translation"), F.map_values("translation")
    return df.withColumn("src", F.element_at(k, 1)).withColumn("tgt", F.element_at(k, 2)).withColumn(
        "input", F.element_at(v, 1)
    ).withColumn("target", F.element_at(v, 2))


def mt_prompt(df: DataFrame) -> DataFrame:
    """inputs = "Translate from {src} to {tgt}: {input}", targets = target."""
    return df.withColumn(
        "inputs", F.concat(F.lit("Translate from "), "src", F.lit(" to "), "tgt", F.lit(": "), "input")
    ).withColumn("targets", F.col("target"))


def split_pair(pair_col: str = "pair", fixed_width: bool = False):
    """Language codes of a pair: ``a-b`` split on ``-``, or ``aabb`` split 2 + 2."""
    if fixed_width:
        return F.substring(pair_col, 1, 2), F.substring(pair_col, 3, 2)
    parts = F.split(pair_col, "-")
    return F.element_at(parts, 1), F.element_at(parts, 2)


def mt_bidirectional(df: DataFrame, a, b) -> DataFrame:
    """Both directions of each pair: inputs "Translate to {tgt}: {translation[src]}"."""
    dirs = F.explode(F.array(F.struct(a.alias("s"), b.alias("t")), F.struct(b.alias("s"), a.alias("t"))))
    d = df.select("*", dirs.alias("dir")).select("*", F.col("dir.s").alias("src"), F.col("dir.t").alias("tgt")).drop("dir")
    return d.withColumn("task", F.concat(F.lit("flores_"), "src", F.lit("_"), "tgt", F.lit("_mt"))).withColumn(
        "inputs", F.concat(F.lit("Translate to "), "tgt", F.lit(": "), F.element_at("translation", F.col("src")))
    ).withColumn("targets", F.element_at("translation", F.col("tgt")))
