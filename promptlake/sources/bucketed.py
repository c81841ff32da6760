"""Tables laid out once by a key, so that joins on it need no exchange.

``write_layout`` deals the rows to a fixed number of buckets by the key's hash, sorted inside, one file
per bucket, and notes the layout beside the data. ``open_layout`` reads it back as a table whose
buckets Spark knows, in this or any later session: two layouts with the same key and number of
buckets are joined bucket by bucket, and the wide side, the texts, is never shuffled again. The
one shuffle of the layout pays from the second join on.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64  # a table of 100 TB wants several thousand: the number is the caller's, equal for tables that meet


def _note(path: str) -> str:
    return posixpath.join(posixpath.dirname(path.rstrip("/")), posixpath.basename(path.rstrip("/")) + ".layout.json")


def write_layout(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write ``df`` to ``path`` by ``key``; rows with a null key share a bucket. The note is written last:
    a folder without it is not whole and is replaced by the next call."""
    spark = df.sparkSession
    name = f"layout_{uuid.uuid4().hex}"
    # as many tasks as buckets, dealt as the buckets are: each task writes one file
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the data stays: the table is external
    note = json.dumps({"key": key, "buckets": buckets, "schema": df.schema.jsonValue()})
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_note(path))
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(note.encode()))
    out.close()


def has_layout(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_note(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def open_layout(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with its buckets, registered in this session under a name of its own."""
    note = json.loads(spark.read.text(_note(path), wholetext=True).first()["value"])
    shape = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(json.dumps(note["schema"])).toDDL()
    name = f"layout_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({shape}) USING parquet CLUSTERED BY (`{note['key']}`) SORTED BY (`{note['key']}`) INTO {note['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def laid_out(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The table at ``path``, written from ``df`` only if it is not there yet."""
    if not has_layout(df.sparkSession, path):
        write_layout(df, path, key, buckets)
    return open_layout(df.sparkSession, path)
