"""Declared features: a tree of values, class labels, fixed shapes, sequences and structs becomes a Spark
schema, and rows are brought to it or told apart with a reason.

    features = {
        "doc_id": Value("int64"),
        "lang": ClassLabel(["de", "en"]),
        "lines": Sequence(Value("string"), length=3),
        "vector": Tensor((2, 4), "float32"),
        "answers": Sequence({"text": Value("string"), "start": Value("int32")}),
    }

A sequence of a struct is a struct of arrays of that length, as dataset libraries store it; a sequence of a
sequence is an array of arrays. A list of one feature is a sequence of any length. Class labels are long
indexes, -1 meaning none; strings are looked up in the names. Null conforms to every feature, also inside
arrays. Everything is per-row Column logic without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of value types and the Spark types that hold them.
VALUE_TYPES = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
}


@dataclass(frozen=True)
class Value:
    dtype: str


@dataclass(frozen=True)
class ClassLabel:
    names: list[str]


@dataclass(frozen=True)
class Tensor:
    shape: tuple[int | None, ...]
    dtype: str


@dataclass(frozen=True)
class Sequence:
    feature: object
    length: int = -1


def _plain(feature):
    """The feature with lists, tensors and sequences of structs written as sequences and structs."""
    if isinstance(feature, list) and len(feature) == 1:
        return _plain(Sequence(feature[0]))
    if isinstance(feature, Tensor):
        inner = Value(feature.dtype)
        for n in reversed(feature.shape):
            inner = Sequence(inner, -1 if n is None else n)
        return inner
    if isinstance(feature, Sequence):
        inner = _plain(feature.feature)
        if isinstance(inner, dict):
            return {k: _plain(Sequence(v, feature.length)) for k, v in inner.items()}
        return Sequence(inner, feature.length)
    if isinstance(feature, dict):
        return {k: _plain(v) for k, v in feature.items()}
    if isinstance(feature, ClassLabel) or (isinstance(feature, Value) and feature.dtype in VALUE_TYPES):
        return feature
    raise ValueError(f"no Spark type for the feature {feature!r}")


def _type(feature) -> T.DataType:
    if isinstance(feature, Value):
        return VALUE_TYPES[feature.dtype]
    if isinstance(feature, ClassLabel):
        return T.LongType()
    if isinstance(feature, Sequence):
        return T.ArrayType(_type(feature.feature))
    return T.StructType([_field(k, v) for k, v in feature.items()])


def _field(name: str, feature) -> T.StructField:
    meta = {"names": list(feature.names)} if isinstance(feature, ClassLabel) else {}
    return T.StructField(name, _type(feature), True, meta)


def spark_schema(features: dict) -> T.StructType:
    """Schema of the declared features; class names are in the metadata of their field."""
    return T.StructType([_field(k, _plain(v)) for k, v in features.items()])


def _value(feature, c: Column, given: T.DataType) -> Column:
    """``c`` in the type of the feature; what cannot be cast is null."""
    if isinstance(feature, ClassLabel) and isinstance(given, T.StringType):
        at = F.array_position(F.array(*[F.lit(n) for n in feature.names]), c) - 1
        return F.when(c.isNotNull(), at).cast("long")
    if isinstance(feature, Sequence):
        return F.transform(c, lambda x: _value(feature.feature, x, given.elementType))
    if isinstance(feature, dict):
        made = F.struct(*[_value(f, c[k], given[k].dataType).alias(k) for k, f in feature.items()])
        return F.when(c.isNotNull(), made)
    return c.try_cast(_type(feature))


def _fault(feature, c: Column, given: T.DataType, path: str) -> Column:
    """What is wrong with ``c`` first, outside before inside; null if nothing is."""
    nothing = F.lit(None).cast("string")
    if isinstance(feature, ClassLabel):
        if isinstance(given, T.StringType):
            return F.when(~c.isin(*feature.names), F.lit(f"{path}: unknown class"))
        return F.when((c < -1) | (c >= len(feature.names)), F.lit(f"{path}: unknown class"))
    if isinstance(feature, Sequence):
        size = F.when(F.size(c) != feature.length, F.concat(F.lit(f"{path}: length "), F.size(c).cast("string"))) if feature.length >= 0 else nothing
        inner = F.filter(F.transform(c, lambda x: _fault(feature.feature, x, given.elementType, f"{path}[]")), lambda x: x.isNotNull())
        return F.when(c.isNotNull(), F.coalesce(size, F.get(inner, F.lit(0))))
    if isinstance(feature, dict):
        return F.coalesce(nothing, *[_fault(f, c[k], given[k].dataType, f"{path}.{k}") for k, f in feature.items()])
    low, high = {"uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 2**32 - 1)}.get(feature.dtype, (None, None))
    bad = c.isNotNull() & c.try_cast(_type(feature)).isNull()
    if low is not None:
        bad = bad | ~c.try_cast("double").between(low, high)
    return F.when(bad, F.lit(f"{path}: no {feature.dtype}"))


def _shaped(feature, given: T.DataType) -> bool:
    """Whether a column of the type can hold the feature at all."""
    if isinstance(feature, Sequence):
        return isinstance(given, T.ArrayType) and _shaped(feature.feature, given.elementType)
    if isinstance(feature, dict):
        return isinstance(given, T.StructType) and all(k in given.names and _shaped(f, given[k].dataType) for k, f in feature.items())
    if isinstance(feature, ClassLabel):
        return isinstance(given, (T.StringType, T.IntegralType))
    return not isinstance(given, (T.ArrayType, T.StructType, T.MapType))


def conform(df: DataFrame, features: dict, fault: str = "fault") -> DataFrame:
    """The declared columns in their types, and in ``fault`` the first thing that is wrong with a row (null
    if it conforms). Columns that are not declared are left out; a missing or differently nested column is
    an error of the table, not of a row."""
    made, faults = [], []
    for name, feature in features.items():
        feature = _plain(feature)
        if name not in df.columns or not _shaped(feature, df.schema[name].dataType):
            raise ValueError(f"column {name} cannot hold {feature!r}")
        given = df.schema[name].dataType
        meta = _field(name, feature).metadata
        made.append(_value(feature, F.col(f"`{name}`"), given).alias(name, metadata=meta))
        faults.append(_fault(feature, F.col(f"`{name}`"), given, name))
    return df.select(*made, F.coalesce(F.lit(None).cast("string"), *faults).alias(fault))


def split_conforming(df: DataFrame, features: dict) -> tuple[DataFrame, DataFrame]:
    """(rows that conform, rows that do not with their ``fault``)."""
    rows = conform(df, features)
    return rows.where(F.col("fault").isNull()).drop("fault"), rows.where(F.col("fault").isNotNull())
