"""Scans of the input tables and the corpus views derived from them.

The input parquet tables play the reference's named datasets (see README, "data mapping"):
``documents`` is a multi-dataset corpus where ``source`` is the dataset name, ``lang`` the
subset and the split is a fixed hash of ``doc_id``; ``labels`` carries class labels for some
of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_u, hash_u_sql

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Split assignment of corpus rows (hash seed and cumulative shares).
SPLIT_SEED = "split"
VALIDATION_SHARE = 0.1
TEST_SHARE = 0.2  # cumulative: [0.1, 0.2) -> test


# Row key of the large tables (used when a caller asks to spread a scan).
SPREAD_KEYS = {"documents": "doc_id", "conversations": "conv_id", "lineitem": "l_orderkey", "pages": "page_id", "events": "event_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one input table. With the session setting ``promptlake.spread.partitions`` (a number, unset
    by default) the large tables are dealt over that many partitions by their row key: a caller asks
    for it when the input is a few files that cannot be split, as one row group is one task. Filters
    and column pruning are still pushed below the exchange.
    """
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), name)


def spread(df: DataFrame, name: str) -> DataFrame:
    want = df.sparkSession.conf.get("promptlake.spread.partitions", None)
    key = SPREAD_KEYS.get(name)
    return df.repartition(int(want), key) if want and key in df.columns else df


def split_of(key) -> Column:
    u = hash_u(SPLIT_SEED, key)
    return F.when(u < VALIDATION_SHARE, F.lit("validation")).when(u < TEST_SHARE, F.lit("test")).otherwise(F.lit("train"))


def split_sql(key_sql: str) -> str:
    u = hash_u_sql(f"'{SPLIT_SEED}'", key_sql)
    return f"(CASE WHEN {u} < {VALIDATION_SHARE} THEN 'validation' WHEN {u} < {TEST_SHARE} THEN 'test' ELSE 'train' END)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a dataset table: (dataset, subset, split, id, text, n_chars)."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("dataset"),
        F.col("lang").alias("subset"),
        split_of("doc_id").alias("split"),
        F.col("doc_id").alias("id"),
        "text",
        "n_chars",
    )


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus left-joined with labels (quality, toxic null where unlabelled)."""
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return corpus(spark, sf_dir).join(lab, "id", "left")


CORPUS_SQL = f"""
  SELECT source AS dataset, lang AS subset, {split_sql('doc_id')} AS split, doc_id AS id, text, n_chars
  FROM documents
"""

LABELLED_SQL = f"""
  SELECT c.*, l.quality, l.toxic FROM ({CORPUS_SQL}) c LEFT JOIN labels l ON l.doc_id = c.id
"""
