"""Prompt templates with blocks, filters and paths, compiled to Catalyst expressions.

A template's text holds ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% set name = expression %}`` and ``{# comment #}``; ``-`` inside a tag strips the white space on
that side. Expressions have fields, dotted and indexed paths into structs, maps and lists, slices,
literals, comparisons, ``in``, ``is none`` / ``is defined``, ``and`` / ``or`` / ``not``, arithmetic, ``~``,
inline ``if``, and the filters and methods of ``FILTERS`` and ``METHODS``. Templates are configuration
and few: the driver compiles each distinct text once, against the schema of the rows, into a typed
Column. Rows meet their templates by an equi join and are rendered by the Column of theirs; no row
is parsed, and all of it is one projection in the JVM.

What cannot be compiled (loops, macros, other filters, unknown fields, wrong types, bad syntax) is a
reject with its reason, never a silent text. Null is false in conditions, unequal to every value but
``none``, and renders as nothing; an index out of range is null; ``and`` / ``or`` of values of different
types is their truth. ``|||`` may stand inside blocks:
exactly two parts are (inputs, targets), stripped, an empty target is ``<NO LABEL>``; any other count
is ("", ""). A value that holds ``|||`` is no separator.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hof import let
from ..functions.text import strip
from .ranking import broadcast_checked
from .templates import NO_LABEL, attach_templates

TAG = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.DOTALL)
PARTS = "\u0001\u0002\u0001"  # stands for ``|||`` of a template's own text while it is rendered
MAX_TEMPLATES = 10_000  # collected by the driver
BRANCHES = 64  # templates rendered by one projection


class Reject(Exception):
    """A template that cannot be compiled; its text is the reason."""


class Value(NamedTuple):
    col: Column
    type: T.DataType


def _is(v: Value, *kinds) -> bool:
    return isinstance(v.type, kinds)


_NUMBER = (T.IntegralType, T.FractionalType)
_STR, _INT, _DOUBLE, _BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def text_of(v: Value) -> Column:
    """What ``{{ v }}`` renders."""
    if _is(v, T.NullType):
        return F.lit("")
    if _is(v, T.BooleanType):
        return F.when(v.col, "True").when(~v.col, "False").otherwise("")
    if _is(v, T.StringType, *_NUMBER, T.DateType, T.TimestampType):
        return F.coalesce(v.col.cast("string"), F.lit(""))
    raise Reject(f"no text form: {v.type.simpleString()}")


def truth(v: Value) -> Column:
    if _is(v, T.NullType):
        return F.lit(False)
    if _is(v, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if _is(v, T.StringType):
        return F.coalesce(v.col != "", F.lit(False))
    if _is(v, *_NUMBER):
        return F.coalesce(v.col != 0, F.lit(False))
    if _is(v, T.ArrayType, T.MapType):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def _number(v: Value) -> Value:
    if not _is(v, *_NUMBER):
        raise Reject(f"not a number: {v.type.simpleString()}")
    return v


def _text(v: Value) -> Value:
    if not _is(v, T.StringType, T.NullType):
        raise Reject(f"not a text: {v.type.simpleString()}")
    return Value(v.col.cast("string"), _STR)


def _list(v: Value) -> Value:
    if not _is(v, T.ArrayType):
        raise Reject(f"not a list: {v.type.simpleString()}")
    return v


def _strings(f: Callable[..., Column]) -> Callable[..., Value]:
    return lambda v, *args: Value(f(_text(v).col, *[_text(a).col for a in args]), _STR)


def _length(v: Value) -> Value:
    return Value((F.size(v.col) if _is(v, T.ArrayType, T.MapType) else F.length(_text(v).col)).cast("long"), _INT)


def _default(v: Value, other: Value | None = None) -> Value:
    return _either(v.col.isNotNull(), v, other if other is not None else Value(F.lit(""), _STR))


def _int(v: Value, other: Value | None = None) -> Value:
    known = v.col if _is(v, *_NUMBER, T.BooleanType) else _text(v).col.try_cast("long")
    return Value(F.coalesce(known.cast("long"), (_number(other).col if other is not None else F.lit(0)).cast("long")), _INT)


def _join(v: Value, sep: Value | None = None) -> Value:
    texts = F.transform(_list(v).col, lambda x: text_of(Value(x, v.type.elementType)))
    return Value(F.call_function("array_join", texts, sep.col if sep is not None else F.lit("")), _STR)


def _first(v: Value) -> Value:
    return Value(F.get(_list(v).col, 0), v.type.elementType)


def _last(v: Value) -> Value:
    return Value(F.get(_list(v).col, F.size(v.col) - 1), v.type.elementType)


_capital = _strings(lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30))))
_trim = _strings(lambda x: strip(x))
FILTERS: dict[str, Callable[..., Value]] = {
    "lower": _strings(F.lower),
    "upper": _strings(F.upper),
    "trim": _trim,
    "capitalize": _capital,
    "replace": _strings(lambda x, old, new: F.replace(x, old, new)),
    "length": _length,
    "count": _length,
    "default": _default,
    "d": _default,
    "int": _int,
    "string": lambda v: Value(text_of(v), _STR),
    "abs": lambda v: Value(F.abs(_number(v).col), v.type),
    "join": _join,
    "first": _first,
    "last": _last,
}
METHODS: dict[str, Callable[..., Value]] = {
    "lower": FILTERS["lower"],
    "upper": FILTERS["upper"],
    "strip": _trim,
    "capitalize": _capital,
    "replace": FILTERS["replace"],
    "startswith": lambda v, x: Value(F.startswith(_text(v).col, _text(x).col), _BOOL),
    "endswith": lambda v, x: Value(F.endswith(_text(v).col, _text(x).col), _BOOL),
    "split": lambda v, x: Value(F.split(_text(v).col, F.concat(F.lit("\\Q"), _text(x).col, F.lit("\\E")), -1), T.ArrayType(_STR)),
}
_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


def _either(cond: Column, a: Value, b: Value) -> Value:
    """``a`` or ``b``: of one type, or both as text."""
    if _is(a, T.NullType) or _is(b, T.NullType):
        kind = b.type if _is(a, T.NullType) else a.type
        return Value(F.when(cond, a.col.cast(kind)).otherwise(b.col.cast(kind)), kind)
    if a.type == b.type:
        return Value(F.when(cond, a.col).otherwise(b.col), a.type)
    if _is(a, *_NUMBER) and _is(b, *_NUMBER):
        kind = _INT if _is(a, T.IntegralType) and _is(b, T.IntegralType) else _DOUBLE
        return Value(F.when(cond, a.col.cast(kind)).otherwise(b.col.cast(kind)), kind)
    return Value(F.when(cond, text_of(a)).otherwise(text_of(b)), _STR)


def _equal(a: Value, b: Value) -> Column:
    if _is(a, T.NullType) or _is(b, T.NullType):
        return (b if _is(a, T.NullType) else a).col.isNull()
    if _is(a, *_NUMBER, T.BooleanType) != _is(b, *_NUMBER, T.BooleanType):
        return F.lit(False)  # a number is no text
    if _is(a, T.BooleanType) != _is(b, T.BooleanType):
        a, b = (Value(x.col.cast("double"), _DOUBLE) for x in (a, b))
    return a.col.eqNullSafe(b.col)


def _parsed(text: str) -> ast.expr:
    """An expression as a Python tree; ``|`` (a filter) and ``~`` get operators of their binding strength."""
    try:
        chars = list(text)
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.OP and t.string in "|~":
                chars[sum(map(len, text.splitlines(True)[: t.start[0] - 1])) + t.start[1]] = "@" if t.string == "|" else "&"
        source = "".join(chars).strip()
        return ast.parse(" ".join(source.splitlines()), mode="eval").body
    except (SyntaxError, tokenize.TokenError) as e:
        raise Reject(f"syntax: {text.strip()}") from e


class _Compiler:
    def __init__(self, fields: dict[str, Value]):
        self.fields = dict(fields)

    def value(self, text: str) -> Value:
        return self.of(_parsed(text))

    def of(self, x: ast.expr) -> Value:
        handler = getattr(self, f"_{type(x).__name__.lower()}", None)
        if handler is None:
            raise Reject(f"unsupported expression: {type(x).__name__}")
        return handler(x)

    def _constant(self, x) -> Value:
        kinds = {str: _STR, bool: _BOOL, int: _INT, float: _DOUBLE, type(None): T.NullType()}
        if type(x.value) not in kinds:
            raise Reject(f"unsupported expression: {x.value!r}")
        kind = kinds[type(x.value)]
        return Value(F.lit(x.value).cast(kind) if x.value is not None else F.lit(None), kind)

    def _name(self, x) -> Value:
        if x.id in ("true", "false", "none"):
            return self._constant(ast.Constant({"true": True, "false": False, "none": None}[x.id]))
        if x.id not in self.fields:
            raise Reject(f"unknown field: {x.id}")
        return self.fields[x.id]

    def _part(self, v: Value, key: str) -> Value:
        if _is(v, T.StructType) and key in v.type.names:
            return Value(v.col.getField(key), v.type[key].dataType)
        if _is(v, T.MapType) and isinstance(v.type.keyType, T.StringType):
            return Value(F.try_element_at(v.col, F.lit(key)), v.type.valueType)
        raise Reject(f"unknown field: {key}")

    def _attribute(self, x) -> Value:
        return self._part(self.of(x.value), x.attr)

    def _subscript(self, x) -> Value:
        v = self.of(x.value)
        if isinstance(x.slice, ast.Slice):
            ends = [x.slice.lower or ast.Constant(0), x.slice.upper or ast.Constant(1 << 30)]
            if x.slice.step or not all(isinstance(e, ast.Constant) and isinstance(e.value, int) for e in ends):
                raise Reject("unsupported slice")
            lo, n = ends[0].value, max(ends[1].value - ends[0].value, 0)
            return Value(F.slice(v.col, lo + 1, n), v.type) if _is(v, T.ArrayType) else Value(F.substring(_text(v).col, lo + 1, n), _STR)
        if isinstance(x.slice, ast.Constant) and isinstance(x.slice.value, str):
            return self._part(v, x.slice.value)
        i = self.of(x.slice)
        if not _is(i, T.IntegralType):
            raise Reject("index is no whole number")
        return Value(F.when(i.col >= 0, F.get(_list(v).col, i.col.cast("int"))), v.type.elementType)

    def _list(self, x) -> Value:
        items = [self.of(e) for e in x.elts]
        if not items or any(type(i.type) is not type(items[0].type) for i in items):
            raise Reject("list of mixed types")
        return Value(F.array(*[i.col for i in items]), T.ArrayType(items[0].type))

    _tuple = _list

    def _boolop(self, x) -> Value:
        both, values = isinstance(x.op, ast.And), [self.of(v) for v in x.values]
        if any(v.type != values[0].type for v in values):
            tests = [truth(v) for v in values]
            return Value(reduce(Column.__and__ if both else Column.__or__, tests), _BOOL)
        return reduce(lambda a, b: _either(truth(a), b, a) if both else _either(truth(a), a, b), values)

    def _unaryop(self, x) -> Value:
        v = self.of(x.operand)
        if isinstance(x.op, ast.Not):
            return Value(~truth(v), _BOOL)
        if isinstance(x.op, ast.USub):
            return Value(-_number(v).col, v.type)
        raise Reject(f"unsupported expression: {type(x.op).__name__}")

    def _ifexp(self, x) -> Value:
        return _either(truth(self.of(x.test)), self.of(x.body), self.of(x.orelse))

    def _compare(self, x) -> Value:
        out, left = [], x.left
        for op, right in zip(x.ops, x.comparators, strict=True):
            out.append(self._one_comparison(left, op, right))
            left = right
        return Value(reduce(Column.__and__, out), _BOOL)

    def _one_comparison(self, left, op, right) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if not (isinstance(right, ast.Name) and right.id in ("none", "defined") or isinstance(right, ast.Constant) and right.value is None):
                raise Reject(f"unsupported test: {ast.unparse(right)}")
            try:
                known = self.of(left).col.isNotNull()
            except Reject:
                if getattr(right, "id", None) != "defined":
                    raise
                known = F.lit(False)
            return known if (getattr(right, "id", None) == "defined") == isinstance(op, ast.Is) else ~known
        a, b = self.of(left), self.of(right)
        if isinstance(op, (ast.Eq, ast.NotEq)):
            return _equal(a, b) if isinstance(op, ast.Eq) else ~_equal(a, b)
        if isinstance(op, (ast.In, ast.NotIn)):
            if _is(b, T.ArrayType):
                there = F.exists(b.col, lambda e: _equal(a, Value(e, b.type.elementType)))
            else:
                there = F.contains(_text(b).col, _text(a).col)
            there = F.coalesce(there, F.lit(False))
            return there if isinstance(op, ast.In) else ~there
        if not (_is(a, *_NUMBER) and _is(b, *_NUMBER)) and not (_is(a, T.StringType) and _is(b, T.StringType)):
            raise Reject("compared types differ")
        return F.coalesce(getattr(a.col, _COMPARE[type(op)])(b.col), F.lit(False))

    def _binop(self, x) -> Value:
        if isinstance(x.op, ast.MatMult):
            return self._filter(x)
        a, b = self.of(x.left), self.of(x.right)
        if isinstance(x.op, ast.BitAnd):
            return Value(F.concat(text_of(a), text_of(b)), _STR)
        if isinstance(x.op, ast.Add) and _is(a, T.StringType):
            return Value(F.concat(a.col, _text(b).col), _STR)
        whole = _is(_number(a), T.IntegralType) and _is(_number(b), T.IntegralType)
        kind = _INT if whole and not isinstance(x.op, ast.Div) else _DOUBLE
        if isinstance(x.op, (ast.FloorDiv, ast.Mod)):
            below = F.floor(F.try_divide(a.col, b.col))
            return Value((below if isinstance(x.op, ast.FloorDiv) else a.col - below * b.col).cast(kind), kind)
        done = {ast.Add: lambda: a.col + b.col, ast.Sub: lambda: a.col - b.col, ast.Mult: lambda: a.col * b.col, ast.Div: lambda: F.try_divide(a.col, b.col)}
        if type(x.op) not in done:
            raise Reject(f"unsupported expression: {type(x.op).__name__}")
        return Value(done[type(x.op)]().cast(kind), kind)

    def _filter(self, x) -> Value:
        call = x.right if isinstance(x.right, ast.Call) else ast.Call(x.right, [], [])
        if isinstance(x.left, ast.BinOp) and isinstance(x.left.op, (ast.Mult, ast.Div, ast.FloorDiv, ast.Mod)) and x.left.end_col_offset == x.left.right.end_col_offset and x.col_offset == x.left.col_offset:
            return self._binop(ast.BinOp(x.left.left, x.left.op, ast.BinOp(x.left.right, x.op, x.right, col_offset=-1)))  # a * b | f filters b
        name = getattr(call.func, "id", None)
        if name not in FILTERS or call.keywords:
            raise Reject(f"unsupported filter: {ast.unparse(x.right)}")
        try:
            v = self.of(x.left)
        except Reject:
            if name not in ("default", "d"):
                raise
            v = Value(F.lit(None), T.NullType())
        return self._applied(FILTERS[name], name, v, call.args)

    def _call(self, x) -> Value:
        if not isinstance(x.func, ast.Attribute) or x.func.attr not in METHODS or x.keywords:
            raise Reject(f"unsupported call: {ast.unparse(x.func)}")
        return self._applied(METHODS[x.func.attr], x.func.attr, self.of(x.func.value), x.args)

    def _applied(self, f: Callable[..., Value], name: str, v: Value, args: Sequence[ast.expr]) -> Value:
        try:
            return f(v, *map(self.of, args))
        except TypeError as e:
            raise Reject(f"arguments of {name}") from e

    def text(self, template: str) -> Column:
        """The rendered text, with ``PARTS`` for each ``|||`` of the template's own."""
        pieces = _pieces(template)
        out = self._block(pieces, ())
        if pieces:
            raise Reject(f"unsupported block: {pieces[0][1]}")
        return out

    def _block(self, pieces: list[tuple[str, str]], ends: tuple[str, ...]) -> Column:
        """Pieces up to (not including) a tag of ``ends``; they are taken off the list."""
        cols: list[Column] = []
        while pieces:
            kind, x = pieces[0]
            word, _, rest = x.partition(" ")
            if kind == "tag" and word in ends:
                break
            pieces.pop(0)
            if kind == "literal":
                cols.append(F.lit(x.replace("|||", PARTS)))
            elif kind == "value":
                cols.append(F.replace(text_of(self.value(x)), F.lit(PARTS), F.lit("")))
            elif word == "if":
                cols.append(self._if(rest, pieces))
            elif word == "set" and re.fullmatch(r"\s*[A-Za-z_]\w*\s*=(?!=).*", rest, re.DOTALL):
                name, _, value = rest.partition("=")
                self.fields[name.strip()] = self.value(value)
            else:
                raise Reject(f"unsupported block: {word}")
        return F.concat(*cols) if cols else F.lit("")

    def _if(self, cond: str, pieces: list[tuple[str, str]]) -> Column:
        out, before = None, dict(self.fields)
        otherwise = F.lit("")
        while True:
            test = truth(self.value(cond))
            body = self._block(pieces, ("elif", "else", "endif"))
            self.fields = dict(before)  # names set in a branch end with it
            out = F.when(test, body) if out is None else out.when(test, body)
            if not pieces:
                raise Reject("block without end: if")
            word, _, cond = pieces.pop(0)[1].partition(" ")
            if word == "else":
                otherwise = self._block(pieces, ("endif",))
                self.fields = dict(before)
                if not pieces:
                    raise Reject("block without end: if")
                pieces.pop(0)
            if word != "elif":
                return out.otherwise(otherwise)


def _pieces(template: str) -> list[tuple[str, str]]:
    """(literal | value | tag, text) in order; white space next to a ``-`` is gone."""
    out, at, cut = [], 0, False
    for m in TAG.finditer(template):
        literal = template[at : m.start()]
        tag = m.group()
        inner = tag[2:-2]
        literal = literal.lstrip() if cut else literal
        literal = literal.rstrip() if inner.startswith("-") else literal
        if literal:
            out.append(("literal", literal))
        cut = inner.endswith("-") and len(inner) > 1
        inner = inner.removeprefix("-").removesuffix("-" if cut else "").strip()
        if tag[1] != "#":
            out.append(("value" if tag[1] == "{" else "tag", re.sub(r"\s+", " ", inner) if tag[1] == "%" and "'" not in inner and '"' not in inner else inner))
        at = m.end()
    rest = template[at:].lstrip() if cut else template[at:]
    return out + [("literal", rest)] if rest else out


def compile_template(jinja: str, choices: str | None, fields: dict[str, Value]) -> Column:
    """struct(inputs, targets, answer_choices) of one template; raises ``Reject``."""
    own = {k: v for k, v in fields.items() if k != "answer_choices"}
    listed = None
    if choices is not None and choices.strip():
        listed = F.array(*[strip(_Compiler(own).text(c)) for c in choices.strip().split("|||")])

    def render(c: Column | None) -> Column:
        compiler = _Compiler(own if c is None else {**own, "answer_choices": Value(c, T.ArrayType(_STR))})

        def pair(parts: Column) -> Column:
            ok = F.size(parts) == 2
            targets = strip(F.element_at(parts, -1))
            return F.struct(
                F.when(ok, strip(F.element_at(parts, 1))).otherwise("").alias("inputs"),
                F.when(ok, F.when(targets == "", NO_LABEL).otherwise(targets)).otherwise("").alias("targets"),
                (c if c is not None else F.lit(None).cast("array<string>")).alias("answer_choices"),
            )

        return let(F.split(compiler.text(jinja), PARTS, -1), pair)

    return render(None) if listed is None else let(listed, render)


def _fields_of(schema: T.StructType) -> dict[str, Value]:
    return {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields}


def _distinct_texts(templates: DataFrame) -> list[tuple[str, str | None]]:
    rows = templates.select("jinja", "answer_choices").distinct().limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} different templates")
    return sorted(((r.jinja, r.answer_choices) for r in rows if r.jinja is not None), key=lambda x: (x[0], x[1] or ""))


def compile_all(templates: DataFrame, schema: T.StructType) -> tuple[dict[tuple[str, str | None], Column], dict[tuple[str, str | None], str]]:
    """Columns of the templates that compile against ``schema``, and reasons of the others."""
    done, rejected = {}, {}
    for text in _distinct_texts(templates):
        try:
            done[text] = compile_template(*text, _fields_of(schema))
        except Reject as e:
            rejected[text] = str(e)
    return done, rejected


def _keyed(spark, texts: list[tuple[str, str | None]], values: list, kind: str) -> DataFrame:
    rows = [(j, c, v) for (j, c), v in zip(texts, values, strict=True)]
    return spark.createDataFrame(rows, f"__jinja string, __choices string, __value {kind}")


def _with_value(templates: DataFrame, keyed: DataFrame, out: str) -> DataFrame:
    same = (F.col("jinja") == F.col("__jinja")) & F.col("answer_choices").eqNullSafe(F.col("__choices"))
    return templates.join(F.broadcast(keyed), same).drop("__jinja", "__choices").withColumnRenamed("__value", out)  # MAX_TEMPLATES rows at most


def block_rejects(templates: DataFrame, schema: T.StructType) -> DataFrame:
    """(dataset, subset, name, reason) of the templates that cannot be compiled."""
    _, rejected = compile_all(templates, schema)
    keyed = _keyed(templates.sparkSession, list(rejected), list(rejected.values()), "string")
    return _with_value(templates, keyed, "reason").select("dataset", "subset", "name", "reason")


def render_blocks(data: DataFrame, templates: DataFrame, keep: Sequence[str] = ("task", "template", "id"), join_cols: Sequence[str] = ("dataset", "subset")) -> DataFrame:
    """Every row of ``data`` with every compilable template of its dataset: keep, inputs, targets, answer_choices.

    Only the number of a template goes through the join, not its text. The rows are rendered by one
    conditional expression over the numbers, ``BRANCHES`` templates at a time."""
    done, _ = compile_all(templates, data.schema)
    texts, columns = list(done), list(done.values())
    numbered = _with_value(templates, _keyed(data.sparkSession, texts, list(range(len(texts))), "int"), "__number").drop("jinja", "answer_choices")
    numbered = broadcast_checked(numbered, "numbered_templates")
    out = None
    for a in range(0, max(len(texts), 1), BRANCHES):
        part = numbered.where((F.col("__number") >= a) & (F.col("__number") < a + BRANCHES))
        rows = attach_templates(data, part.withColumn("answer_choices", F.lit(None).cast("string")), join_cols)
        pair = F.when(F.lit(False), F.lit(None).cast("struct<inputs: string, targets: string, answer_choices: array<string>>"))
        for i, column in enumerate(columns[a : a + BRANCHES]):
            pair = pair.when(F.col("__number") == a + i, column)
        rendered = rows.select(*keep, pair.alias("__r")).select(*keep, "__r.*")
        out = rendered if out is None else out.unionByName(rendered)
    return out
