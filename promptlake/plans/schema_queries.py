"""Registered queries: rows brought to declared features, and rejected rows with reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features_schema import ClassLabel, Sequence, Tensor, Value, conform, split_conforming
from ..sources.tables import read
from .registry import register

# The declared features of the two tables (three of the four languages, three parts of a text, eight numbers in two rows).
LANGS = ["de", "en", "fr"]
DOCUMENT = {
    "doc_id": Value("int64"),
    "lang": ClassLabel(LANGS),
    "body": {"lines": Sequence(Value("string"), length=3), "n_chars": Value("uint16")},
}
VECTOR = {"vec_id": Value("int64"), "head": Tensor((2, 4), "float64"), "label": ClassLabel(["zero", "one", "two", "three", "four"])}


@register(
    "declared_documents",
    """WITH d AS (SELECT doc_id, lang, n_chars, string_split(text, chr(10)) AS lines FROM documents)
       SELECT doc_id, CAST(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE -1 END AS BIGINT) AS lang,
              CAST(len(lines) AS INTEGER) AS n_lines, CAST(n_chars AS INTEGER) AS n_chars,
              CASE WHEN lang NOT IN ('de', 'en', 'fr') THEN 'lang: unknown class'
                   WHEN len(lines) <> 3 THEN 'body.lines: length ' || len(lines)
                   WHEN n_chars NOT BETWEEN 0 AND 65535 THEN 'body.n_chars: no uint16' END AS fault
       FROM d""",
)
def q_declared_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    rows = d.select("doc_id", "lang", F.struct(F.split("text", "\n", -1).alias("lines"), "n_chars").alias("body"))
    c = conform(rows, DOCUMENT)
    return c.select("doc_id", "lang", F.size("body.lines").alias("n_lines"), F.col("body.n_chars").alias("n_chars"), "fault")


@register(
    "declared_vectors",
    """SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[4] AS DOUBLE) AS row_end, CAST(embedding[8] AS DOUBLE) AS last
       FROM embeddings WHERE label BETWEEN -1 AND 4 AND len(embedding) >= 8""",
)
def q_declared_vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", "label", F.array(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4)).alias("head"))
    good, _ = split_conforming(rows, VECTOR)
    at = lambda i, j: F.get(F.get("head", F.lit(i)), F.lit(j))
    return good.select("vec_id", "label", at(0, 0).alias("first"), at(0, 3).alias("row_end"), at(1, 3).alias("last"))
