"""Streams over tables that are folders of files: whole, in batches by bytes, empty ones too."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from promptlake.session import scratch_path
from promptlake.sources.tables import read
from promptlake.streaming import prompts as P

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def folder(spark):
    """The tables that the stream queries read, each as a folder of three files."""
    path = scratch_path(spark, "folders")
    for name in ("documents", "labels"):
        read(spark, SF_SMALL, name).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_cache", "stream_prompts", "stream_sample"])
def test_folder_gives_the_rows_of_the_file(spark, folder, name):
    q = E.queries()[name]
    rows = sorted(map(tuple, q(spark, folder).collect()))
    assert rows and rows == sorted(map(tuple, q(spark, SF_SMALL).collect()))


def test_batches_follow_bytes_not_files(spark, folder):
    def batches(batch_bytes):
        seen = []
        stream = P.corpus_stream(spark, folder, batch_bytes=batch_bytes)
        q = stream.writeStream.foreachBatch(lambda df, i: seen.append(df.count())).option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        return seen

    docs = read(spark, SF_SMALL, "documents").count()
    assert batches(P.BATCH_BYTES) == [docs]
    small = batches(1)
    assert len(small) == 3 and sum(small) == docs


def test_no_rows_are_an_empty_result(spark, folder):
    out = P.run_to_parquet(P.corpus_stream(spark, folder).where(F.lit(False)).select("doc_id", "lang"), "none", ["lang"])
    assert out.columns == ["doc_id", "lang"] and out.count() == 0
