"""Shards: one file each under the manifest's name, read by name in tasks."""

import glob
import gzip
import json
import os

import pytest

from promptlake.plans import QUERIES
from promptlake.plans.io_queries import _shards
from promptlake.session import shared_dir
from promptlake.sources import files as FS
from promptlake.sources.tables import corpus

from .conftest import SF_SMALL


def _local(path):
    return path.removeprefix("file:")


def test_query_writes_one_file_per_shard_by_its_manifest_name(spark):
    before = set(glob.glob(f"{_local(shared_dir(spark))}/promptlake/shards-*"))
    rows = QUERIES["fractional_read"](spark, SF_SMALL).collect()
    (folder,) = set(glob.glob(f"{_local(shared_dir(spark))}/promptlake/shards-*")) - before
    names = {f for f in os.listdir(folder) if not f.startswith((".", "_"))}
    manifest = {r.file for r in FS.shard_manifest(_shards(spark, SF_SMALL)).where("split = 'train'").collect()}
    assert names and names <= manifest
    lines = [json.loads(x) for f in names for x in gzip.open(f"{folder}/{f}", "rt")]
    train = corpus(spark, SF_SMALL).where("split = 'train'").select("subset", "id", "text").collect()
    assert sorted((x["url"], x["text"]) for x in lines) == sorted((f"https://example.com/{r.subset}/{r.id}", r.text) for r in train)
    assert {r.url for r in rows} <= {x["url"] for x in lines}


@pytest.fixture
def small_steps(spark, monkeypatch):
    monkeypatch.setattr(FS, "READ_BYTES", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_write_and_read_only_what_is_planned(spark, tmp_path, small_steps):
    folder = f"file://{tmp_path}/s"
    texts = [None, "", "one\ntwo\r  \"q\" é", "x" * 1000, "tail"]
    rows = [(f, t, "2024-01-01T00:00:00Z", f"{f}#{i}") for f in ("c4-a/b%.json.gz", "c4-b.json.gz", "c4-c.json.gz") for i, t in enumerate(texts)]
    named = spark.createDataFrame(rows, "file string, text string, timestamp string, url string")
    written = {r.file: r.rows for r in FS.write_shards(named, folder).collect()}
    assert written == {"c4-a/b%.json.gz": 5, "c4-b.json.gz": 5, "c4-c.json.gz": 5}
    assert len([f for f in os.listdir(tmp_path / "s") if not f.startswith(".")]) == 3
    (tmp_path / "s" / "c4-c.json.gz").write_bytes(b"not opened")
    plan = spark.createDataFrame([("c4-a/b%.json.gz",), ("c4-b.json.gz",)], "file string")
    got = FS.read_planned(spark, folder, plan).collect()
    assert sorted((r.url, r.text) for r in got if r.text is not None) == sorted((u, t) for f, t, _, u in rows if t is not None and "-c." not in f)
    assert len(got) == 10 and all(r.ts is not None for r in got)


def test_reads_members_blank_lines_and_a_last_line_without_end(spark, tmp_path, small_steps):
    line = lambda u: json.dumps({"url": u, "text": "t" * 100}).encode()
    data = gzip.compress(line("a") + b"\r\n\n \n") + gzip.compress(line("b") + b"\n{broken\n" + line("c"))
    (tmp_path / "f.json.gz").write_bytes(data)
    plan = spark.createDataFrame([("f.json.gz",), ("f.json.gz",)], "file string")
    got = FS.read_planned(spark, f"file://{tmp_path}", plan).collect()
    assert sorted(r.url or "" for r in got) == ["", "a", "b", "c"]
    assert FS.read_planned(spark, f"file://{tmp_path}", plan.limit(0)).count() == 0
    with pytest.raises(Exception, match="gone.json.gz"):
        FS.read_planned(spark, f"file://{tmp_path}", spark.createDataFrame([("gone.json.gz",)], "file string")).collect()
