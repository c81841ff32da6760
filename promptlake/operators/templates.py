"""Prompt templates compiled to Catalyst expressions.

Two kinds of template are supported:

* **Field templates** (``templates`` table, one row per template): the text uses
  ``{{ field }}`` and ``{{ answer_choices[field] }}`` references, ``|||`` separates inputs
  from targets and ``answer_choices`` holds ``a ||| b ||| c``. The template text is parsed by
  Spark itself (``regexp_extract_all`` for the references, ``split`` for the literal runs),
  so a templates table of any size is rendered by one plan: data rows are joined to their
  templates and rendered with ``zip_with`` over the parts, looking field values up in a
  ``map<string,string>`` built from the row. Values are never re-parsed, so a value holding
  ``{{`` or ``|||`` is rendered verbatim.
* **Format templates** (``FormatTemplate``): Python ``str.format`` text plus a verbaliser
  list, compiled on the driver into ``concat`` of columns and literals.

Rendering rule for both: exactly two parts -> (inputs, targets) stripped; empty target ->
``<NO LABEL>``; any other part count -> ("", ""), removed by ``nonempty_pairs``.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hof import let
from ..functions.text import strip, task_name

# Fixed values of the prompt format.
SEP_REGEX = "\\|\\|\\|"  # the "|||" separator between inputs and targets
CHOICE_SEP_REGEX = "\\s*\\|\\|\\|\\s*"
NO_LABEL = "<NO LABEL>"
FIELD_REGEX = "\\{\\{\\s*(.*?)\\s*\\}\\}"  # {{ expr }}, group 1 = expr
FIELD_SPLIT_REGEX = "\\{\\{.*?\\}\\}"
CHOICE_REF_REGEX = "^answer_choices\\s*\\[\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*\\]$"
TRANSLATE_MARK = "-translate-"

TEMPLATE_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("subset", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("jinja", T.StringType()),
        T.StructField("answer_choices", T.StringType()),
        T.StructField("original_task", T.BooleanType()),
        T.StructField("id", T.StringType()),
    ]
)


# ---------------------------------------------------------------------------------------------
# column renaming and field maps


def rename_hyphens(df: DataFrame) -> DataFrame:
    """Replace ``-`` by ``_`` in column names; when two columns collide the later one wins."""
    final: dict[str, str] = {}
    for c in df.columns:
        final[c.replace("-", "_")] = c
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in final.items()])


def field_map(df: DataFrame, fields: list[str] | None = None) -> Column:
    """``map<string,string>`` of the row's (non-nested) fields, values cast to string."""
    names = fields if fields is not None else [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    kv: list[Column] = []
    for n in names:
        kv += [F.lit(n), F.col(f"`{n}`").cast("string")]
    return F.create_map(*kv) if kv else F.create_map().cast("map<string,string>")


# ---------------------------------------------------------------------------------------------
# field templates


def answer_choices(template_choices: Column) -> Column:
    """Split an ``a ||| b`` choice string into a trimmed array; null when absent."""
    trimmed = strip(template_choices)
    return F.when(template_choices.isNull() | (trimmed == ""), F.lit(None).cast("array<string>")).otherwise(
        F.split(trimmed, CHOICE_SEP_REGEX, -1)
    )


def _resolve(expr: Column, fields: Column, choices: Column, python_index: bool) -> Column:
    """Value of one ``{{ expr }}`` reference: a field, or ``answer_choices[field]``."""
    ref = F.regexp_extract(expr, CHOICE_REF_REGEX, 1)
    idx = F.element_at(fields, ref).try_cast("long")  # null for a field that is no number
    if python_index:
        pos = F.when(idx < 0, idx).otherwise(idx + 1)
        choice = F.when(pos == 0, F.lit(None)).otherwise(F.element_at(choices, pos.cast("int")))
    else:
        choice = F.when((idx >= 0) & (idx < F.size(choices)), F.element_at(choices, (idx + 1).cast("int")))
    value = F.when(ref != "", choice).otherwise(F.element_at(fields, expr))
    return F.coalesce(value, F.lit(""))


def _render_part(part: Column, fields: Column, choices: Column, python_index: bool) -> Column:
    lits = F.split(part, FIELD_SPLIT_REGEX, -1)
    refs = F.regexp_extract_all(part, F.lit(FIELD_REGEX), 1)
    values = F.transform(refs, lambda r: _resolve(r, fields, choices, python_index))
    tail = F.zip_with(values, F.slice(lits, 2, 1 << 30), lambda v, lit: F.concat(v, lit))
    return F.concat(F.element_at(lits, 1), F.array_join(tail, ""))


def render_field_template(
    jinja: Column, choices_tpl: Column, fields: Column, python_index: bool = False
) -> Column:
    """struct(inputs, targets, answer_choices) for one row and one template text.

    The row's field map is bound once per row (``let``), so lookups inside the per-reference
    lambdas never rebuild it."""
    return let(fields, lambda fm: _render_with(jinja, choices_tpl, fm, python_index))


def _render_with(jinja: Column, choices_tpl: Column, fields: Column, python_index: bool) -> Column:
    raw_choices = answer_choices(choices_tpl)
    # choices may themselves reference fields ({{ choice1 }} ||| {{ choice2 }})
    empty = F.array().cast("array<string>")
    choices_expr = F.transform(raw_choices, lambda c: strip(_render_part(c, fields, empty, python_index)))

    def body(choices):
        parts = F.split(jinja, SEP_REGEX, -1)
        ok = F.size(parts) == 2
        inputs = strip(_render_part(F.element_at(parts, 1), fields, choices, python_index))
        targets = strip(_render_part(F.element_at(parts, -1), fields, choices, python_index))
        targets = F.when(targets == "", F.lit(NO_LABEL)).otherwise(targets)
        return F.struct(
            F.when(ok, inputs).otherwise(F.lit("")).alias("inputs"),
            F.when(ok, targets).otherwise(F.lit("")).alias("targets"),
            choices.alias("answer_choices"),
        )

    return let(choices_expr, body)


def nonempty_pairs(df: DataFrame) -> DataFrame:
    return df.where((F.length("inputs") > 0) & (F.length("targets") > 0))


def template_filter(templates: DataFrame, include_translated: bool = False, original_only: bool = False) -> DataFrame:
    t = templates
    if not include_translated:
        t = t.where(~F.col("name").contains(TRANSLATE_MARK))
    if original_only:
        t = t.where(F.coalesce(F.col("original_task"), F.lit(False)))
    return t


def template_fields(templates: DataFrame) -> DataFrame:
    """Distinct field names referenced by each template (for validation)."""
    refs = F.regexp_extract_all(F.concat_ws(" ", "jinja", F.coalesce("answer_choices", F.lit(""))), F.lit(FIELD_REGEX), 1)
    return templates.select("dataset", "subset", "name", F.explode(refs).alias("ref")).withColumn(
        "field",
        F.when(F.regexp_extract("ref", CHOICE_REF_REGEX, 1) != "", F.regexp_extract("ref", CHOICE_REF_REGEX, 1)).otherwise(
            F.col("ref")
        ),
    )


def template_rejects(templates: DataFrame, schema_fields: list[str]) -> DataFrame:
    """Templates that cannot be rendered: an unknown field or expression, a ``{% %}`` block, or not
    exactly one ``|||``. They become rows of a rejects table; ``usable_templates`` removes them.
    """
    known = F.array(*[F.lit(f) for f in schema_fields])
    unknown = template_fields(templates).where(~F.array_contains(known, F.col("field")))
    bad_field = unknown.groupBy("dataset", "subset", "name").agg(
        F.concat(F.lit("unknown field: "), F.array_join(F.array_sort(F.collect_set("field")), ",")).alias("reason")
    )
    bad_split = templates.where(F.size(F.split("jinja", SEP_REGEX, -1)) != 2).select(
        "dataset", "subset", "name", F.lit("separator count").alias("reason")
    )
    bad_block = templates.where(F.col("jinja").contains("{%") | F.coalesce(F.col("answer_choices").contains("{%"), F.lit(False))).select(
        "dataset", "subset", "name", F.lit("unsupported block").alias("reason")
    )
    return bad_field.unionByName(bad_split).unionByName(bad_block)


def usable_templates(templates: DataFrame, schema_fields: list[str]) -> DataFrame:
    """``templates`` without the rejected ones (null-safe in the subset)."""
    bad = template_rejects(templates, schema_fields).select(*[F.col(c).alias(f"bad_{c}") for c in ("dataset", "subset", "name")]).distinct()
    same = (F.col("dataset") == F.col("bad_dataset")) & F.col("subset").eqNullSafe(F.col("bad_subset")) & (F.col("name") == F.col("bad_name"))
    return templates.join(bad, same, "left_anti")


def attach_templates(data: DataFrame, templates: DataFrame, join_cols=("dataset", "subset")) -> DataFrame:
    """J1 fan-out: every template of a dataset joined to every row of it (equi join).

    The templates side is a config table (bounded by the number of templates, not by the
    data). Pass it through ``broadcast_checked`` to keep the data side from being shuffled for the
    fan-out; without that the join strategy is left to the optimizer. Adds
    ``template``, ``task``, ``jinja``, ``tpl_choices`` and every other template column.
    """
    join_cols = list(join_cols)
    t = templates.withColumnRenamed("name", "template").withColumnRenamed("answer_choices", "tpl_choices")
    t = t.withColumn("task", task_name(join_cols[0], join_cols[1] if len(join_cols) > 1 else F.lit(None), "template"))
    drop = [c for c in ("id",) if c in t.columns and c in data.columns]
    if drop:
        t = t.withColumnRenamed("id", "template_id")
    return data.join(t, join_cols)


def render_templates(df: DataFrame, fields: list[str], python_index: bool = False, keep=()) -> DataFrame:
    """Render ``jinja``/``tpl_choices`` of each row against the row's ``fields``."""
    fields = [f for f in fields if f in df.columns]
    r = render_field_template(F.col("jinja"), F.col("tpl_choices"), field_map(df, fields), python_index)
    return df.select(*keep, r.alias("__r")).select(*keep, "__r.*")


def input_lengths(data: DataFrame, templates: DataFrame, fields: list[str], keep=()) -> DataFrame:
    """Bytes of each rendered input before stripping, without rendering: the template's own text plus
    the lengths of the fields it names (answer choices and unknown fields count 0). Texts are
    measured in the scan; only numbers are joined to the templates."""
    part = F.element_at(F.split("jinja", SEP_REGEX, -1), 1)
    own = F.octet_length(F.regexp_replace(part, FIELD_SPLIT_REGEX, ""))
    parsed = templates.withColumn("__own", own).withColumn("__refs", F.regexp_extract_all(part, F.lit(FIELD_REGEX), 1))
    sizes = F.create_map(*[x for f in fields for x in (F.lit(f), F.coalesce(F.octet_length(F.col(f).cast("string")), F.lit(0)))])
    measured = data.select("dataset", "subset", sizes.alias("__sizes"))
    j = attach_templates(measured, parsed)
    total = F.aggregate("__refs", F.col("__own"), lambda acc, r: acc + F.coalesce(F.element_at("__sizes", r), F.lit(0)))
    return j.select(*keep, total.alias("length"))


def fanout_templates(
    data: DataFrame,
    templates: DataFrame,
    fields: list[str],
    join_cols=("dataset", "subset"),
    keep=("dataset", "subset", "template", "task", "id"),
    python_index: bool = False,
) -> DataFrame:
    """Fan out and render in one step (no cap in between)."""
    return render_templates(attach_templates(data, templates, join_cols), fields, python_index, keep)


# ---------------------------------------------------------------------------------------------
# format templates


@dataclass
class FormatTemplate:
    """A prompt in two parts: the input as ``str.format`` text, the target as a verbaliser list indexed
    by ``label_col``, as ``str.format`` text (``targets``), or as any column (``targets``)."""

    name: str
    inputs: str
    choices: list[str] = field(default_factory=list)
    label_col: str = "label"
    python_index: bool = False
    targets: str | Column | None = None

    def fields(self) -> list[str]:
        return [f for _, f, _, _ in string.Formatter().parse(self.inputs) if f]

    def inputs_col(self) -> Column:
        return format_col(self.inputs)

    def targets_col(self) -> Column:
        if isinstance(self.targets, Column):
            return self.targets
        if self.targets is not None:
            return format_col(self.targets)
        return verbalise(F.col(self.label_col), self.choices, self.python_index)

    def apply(self, df: DataFrame, keep=()) -> DataFrame:
        tgt = self.targets_col()
        return df.select(
            *keep,
            F.lit(self.name).alias("template"),
            self.inputs_col().alias("inputs"),
            F.when(tgt == "", F.lit(NO_LABEL)).otherwise(tgt).alias("targets"),
        )


def format_col(text: str) -> Column:
    """``str.format`` text as a concat of literals and columns; null fields are empty."""
    parts: list[Column] = []
    for lit, fld, _, _ in string.Formatter().parse(text):
        if lit:
            parts.append(F.lit(lit))
        if fld:
            parts.append(F.coalesce(F.col(fld).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def apply_formats(df: DataFrame, formats: list[FormatTemplate], keep=()) -> DataFrame:
    """Every row rendered with every format template: one scan, the pairs exploded from an array."""
    pair = lambda t: F.struct(F.lit(t.name).alias("template"), t.inputs_col().alias("inputs"), t.targets_col().alias("t"))
    rows = df.select(*keep, F.explode(F.array(*[pair(t) for t in formats])).alias("p"))
    return rows.select(*keep, "p.template", "p.inputs", F.when(F.col("p.t") == "", F.lit(NO_LABEL)).otherwise(F.col("p.t")).alias("targets"))


def run_chain(rows: DataFrame, steps) -> DataFrame:
    """An ordered chain of table functions (each takes and returns a DataFrame): a task's preprocessors."""
    for step in steps:
        rows = step(rows)
    return rows


def verbalise(label: Column, choices: list[str], python_index: bool = False) -> Column:
    """Label index -> answer text. Default: out-of-range or -1 gives "" (later ``<NO LABEL>``);
    with ``python_index`` a negative index counts from the end as Python lists do."""
    arr = F.array(*[F.lit(c) for c in choices])
    idx = label.cast("int")
    if python_index:
        pos = F.when(idx < 0, idx + F.lit(len(choices)) + 1).otherwise(idx + 1)
    else:
        pos = idx + 1
    ok = (pos >= 1) & (pos <= len(choices))
    return F.coalesce(F.when(ok, F.element_at(arr, pos)), F.lit(""))
