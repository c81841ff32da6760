"""Declared features: schemas, casts, faults from outside in, null values, tables of another shape."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlake.operators.features_schema import ClassLabel, Sequence, Tensor, Value, conform, spark_schema, split_conforming

FEATURES = {
    "id": Value("int64"),
    "lang": ClassLabel(["de", "en"]),
    "answers": Sequence({"text": Value("string"), "start": Value("int32")}, length=2),
    "grid": Tensor((2, None), "float32"),
    "tags": [Value("uint8")],
}


def test_schema_of_every_kind():
    got = spark_schema(FEATURES)
    assert got.simpleString() == "struct<id:bigint,lang:bigint,answers:struct<text:array<string>,start:array<int>>,grid:array<array<float>>,tags:array<smallint>>"
    assert got["lang"].metadata == {"names": ["de", "en"]}
    nested = spark_schema({"x": Sequence(Sequence({"y": {"z": ClassLabel(["a"])}}), 3)})["x"].dataType
    assert nested == T.StructType([T.StructField("y", T.StructType([T.StructField("z", T.ArrayType(T.ArrayType(T.LongType())))]))])


@pytest.mark.parametrize("feature", [Value("text"), "string", [Value("bool"), Value("bool")], None])
def test_unknown_features_are_errors(feature):
    with pytest.raises(ValueError, match="no Spark type"):
        spark_schema({"x": feature})


SCHEMA = "id string, lang string, answers struct<text: array<string>, start: array<long>>, grid array<array<double>>, tags array<int>, fault2 string"


def _rows(spark):
    ok = ("1", "en", (["a", "b"], [1, 2]), [[1.0], [2.0, 3.0]], [0, 255], "x")
    rows = [
        ok,
        ("x", *ok[1:]),
        ("2", "EN", *ok[2:]),
        ("3", "de", (["a"], [1, 2]), *ok[3:]),
        ("4", "de", (["a", "b"], [1, 1 << 40]), *ok[3:]),
        ("5", "de", ok[2], [[1.0]], *ok[4:]),
        ("6", "de", ok[2], ok[3], [7, 256], "x"),
        (None, None, None, None, None, None),
        ("8", "de", ([None, "b"], [None, 2]), [None, [None]], [], "x"),
        ("9", "xx", ([], []), [], [], "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_first_fault_of_each_row(spark):
    got = conform(_rows(spark), FEATURES).select("fault").collect()
    assert [r.fault for r in got] == [
        None,
        "id: no int64",
        "lang: unknown class",
        "answers.text: length 1",
        "answers.start[]: no int32",
        "grid: length 1",
        "tags[]: no uint8",
        None,
        None,
        "lang: unknown class",
    ]


def test_rows_are_split_and_typed(spark):
    good, bad = split_conforming(_rows(spark), FEATURES)
    assert good.schema.simpleString() == spark_schema(FEATURES).simpleString() and good.schema["lang"].metadata == {"names": ["de", "en"]}
    assert (good.count(), bad.count()) == (3, 7)
    first = good.where("id = 1").first()
    assert first.lang == 1 and first.answers.start == [1, 2] and first.grid == [[1.0], [2.0, 3.0]] and first.tags == [0, 255]
    empty = good.where(F.col("id").isNull()).first()
    assert empty.lang is None and empty.answers is None and empty.tags is None
    assert conform(_rows(spark).limit(0), FEATURES).count() == 0


def test_numbers_as_class_labels(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (2,), (-2,), (None,)], "lang int")
    got = conform(df, {"lang": FEATURES["lang"]}).collect()
    assert [r.fault is None for r in got] == [True, True, True, False, False, True]


def test_a_table_of_another_shape_is_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "id long, grid string")
    for features in ({"grid": FEATURES["grid"]}, {"other": Value("int8")}, {"id": {"x": Value("int8")}}):
        with pytest.raises(ValueError, match="cannot hold"):
            conform(df, features)


def test_plan_has_no_exchange(spark):
    plan = conform(_rows(spark), FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
