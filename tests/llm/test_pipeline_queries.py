"""The pipeline's stages against brute force, the registered queries against their SQL, plan shape of native operators."""

import ast
import os
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from promptlake.llm import queries as Q
from tests.llm.test_operators import brute_components, brute_quality, lower, words

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_registered():
    names = list(Q.QUERIES)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 14)) and len(names) == 13
    assert "pipeline" in E.queries() and set(names) <= set(E.queries()) and set(Q.ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cur = duck.execute(Q.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: [(x is not None, x) for x in r]
    want = sorted(cur.fetchall(), key=key)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and abs(a - b) < 2e-6) for a, b in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", ["op3_chat_snapshots", "op4_decontamination", "op7_line_winnowing"])
def test_native_plans(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("module", ["chat", "decontam", "linededup"])
def test_native_modules_have_no_python_functions(module):
    source = open(f"{REPO}/promptlake/llm/{module}.py").read()
    used = {n.attr for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Attribute)}
    assert not used & {"rdd", "udf", "pandas_udf", "mapInArrow", "mapInPandas", "applyInPandas", "applyInArrow", "toPandas", "collect"}


def test_nothing_outside_imports_the_subpackage():
    for base, dirs, files in os.walk(f"{REPO}/promptlake"):
        if "llm" in dirs:
            dirs.remove("llm")
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in re.findall(r"import[^\n]*|from[^\n]*", open(os.path.join(base, f)).read()).__str__()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "packing"]
    step = dict(corpus_pipeline.STAGES)

    kept = step["quality rules"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and kept.schema == docs.schema
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, t in text.items() if brute_quality(t)[-1]}
    assert all(r.n_chars == len(r.text) for r in kept.collect())

    lines = step["line dedup"](spark, kept, SF).cache()
    assert lines.schema == docs.schema
    seen, want = set(), {}
    for r in sorted(kept.collect()):
        x = r.text.split("\n")
        own = [k for k, v in enumerate(x) if v.strip(" \t\r\f\x0b")]
        gone = set()
        n = [len(words(x[k])) for k in own]
        for a in range(len(own)):
            for size in (1, 2, 3):
                z = a + size
                enough = z <= len(own) and (size == 3 or sum(n[a:z]) > 50)
                if enough and (sum(n[a : z - 1]) <= 50 or sum(n[a + 1 : z]) <= 50):
                    run = tuple(x[k] for k in own[a:z])
                    if run in seen:
                        gone |= set(own[a:z])
                    seen.add(run)
        if not gone or len(gone) < len(own):
            want[r.doc_id] = "\n".join(v for k, v in enumerate(x) if k not in gone)
    assert {r.doc_id: r.text for r in lines.collect()} == want

    near = step["near-dedup"](spark, lines, SF).cache()
    assert near.schema == docs.schema
    _, root = brute_components(sorted(want.items()))
    assert {r.doc_id for r in near.collect()} == {i for i, c in root.items() if i == c}

    clean = step["decontamination"](spark, near, SF).cache()
    assert clean.schema == docs.schema
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    grams = {tuple(w[a : a + 10]) for w in map(cut, bench) if w for a in range(max(len(w) - 9, 1))}
    sizes = {len(g) for g in grams}
    bad = {r.doc_id for r in near.collect() for w in [cut(r.text)] if any(tuple(w[p : p + k]) in grams for k in sizes for p in range(len(w) - k + 1))}
    assert bad and {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - bad

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = step["packing"](spark, clean, SF).orderBy("doc_id", "piece").collect()
    ids = {}
    for r in packed:
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [2] for r in clean.collect()}
    used = np.bincount([r.sequence_id for r in packed], [r.length for r in packed])
    assert used.max() <= 1024


def test_pipeline_keeps_odd_rows(spark):
    rows = [(None, "word " * 3 + " ".join(f"w{i}." for i in range(40)), "l", "s", 1), (None, None, None, None, None), (1, "", "l", "s", 0), (2, " ".join(f"x{i}." for i in range(40)), "l", "s", 0)]
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where(F.lit(False)), SF).count() == 0
    assert words("a b") == ["a", "b"]
