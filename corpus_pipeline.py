"""Corpus pipeline: quality rules, line dedup, MinHash near-dedup, decontamination, packing.

Every stage works on all documents its predecessor kept and returns the columns of documents, but
for the last, which returns packed token pieces. The order of the columns is kept, ``n_chars``
follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlake.llm.decontam import decontaminate
from promptlake.llm.linededup import dedup_lines
from promptlake.llm.minhash import near_duplicates
from promptlake.llm.packing import pack, pieces_of
from promptlake.llm.quality import quality
from promptlake.operators.ranking import broadcast_checked
from promptlake.session import cut_lineage


def _with_text(out: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``out`` (text and a struct ``row`` of the others)."""
    value = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return out.select(*[(value[c] if c in value else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` but for the rows with these ids; rows without an id stay."""
    return docs.join(broadcast_checked(ids.distinct(), name), "doc_id", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then the documents that the rules reject."""
    return _with_text(quality(docs, with_row=True).where("kept"), docs, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of three lines or over 50 words go, and documents of which nothing but blanks is left by that."""
    out = dedup_lines(docs, words=50)
    return _with_text(out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))), docs, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, once."""
    found = near_duplicates(docs)
    left = _without(docs, found.where("not kept").select("doc_id"), "dropped")
    repeated = cut_lineage(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    once = left.join(broadcast_checked(repeated, "repeated"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(left, repeated, "repeated").select(docs.columns).unionByName(once.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return _without(docs, decontaminate(docs, items).where("contaminated").select("doc_id"), "contaminated").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in as few sequences of 1024 as possible."""
    return pack(pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", 2, with_ids=True))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # tokenizers and packing have no SQL; tests/llm checks the stages by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
