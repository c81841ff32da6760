"""Template rendering rules, verbaliser, renaming, rejects."""

from pyspark.sql import functions as F

from promptlake.functions.text import strip, task_clean, task_name
from promptlake.operators.templates import (
    NO_LABEL,
    FormatTemplate,
    field_map,
    nonempty_pairs,
    render_field_template,
    rename_hyphens,
    template_filter,
    template_rejects,
    verbalise,
)


def _render(spark, rows, jinja, choices=None, python_index=False):
    df = spark.createDataFrame(rows, "id long, text string, label long")
    r = render_field_template(F.lit(jinja), F.lit(choices).cast("string"), field_map(df, ["id", "text", "label"]), python_index)
    return [tuple(x) for x in df.select("id", r.alias("r")).select("id", "r.*").orderBy("id").collect()]


def test_two_parts_strip_and_choices(spark):
    out = _render(spark, [(1, "  hello  ", 1), (2, "x", 0)], "{{ text }} ? ||| {{ answer_choices[label] }}", "No ||| Yes")
    assert out == [(1, "hello   ?", "Yes", ["No", "Yes"]), (2, "x ?", "No", ["No", "Yes"])]


def test_empty_target_is_no_label_and_minus_one(spark):
    out = _render(spark, [(1, "a", -1), (2, "b", None)], "{{text}}|||{{ answer_choices[label] }}", "A ||| B")
    assert [o[2] for o in out] == [NO_LABEL, NO_LABEL]
    py = _render(spark, [(1, "a", -1)], "{{text}}|||{{ answer_choices[label] }}", "A ||| B", python_index=True)
    assert py[0][2] == "B"


def test_malformed_parts_render_empty_and_are_dropped(spark):
    one = _render(spark, [(1, "a", 0)], "{{ text }} only")
    three = _render(spark, [(1, "a", 0)], "{{ text }} ||| x ||| y")
    assert one[0][1:3] == ("", "") and three[0][1:3] == ("", "")
    df = spark.createDataFrame([("", "x"), ("a", ""), ("a", "b")], "inputs string, targets string")
    assert nonempty_pairs(df).count() == 1


def test_values_are_not_reparsed(spark):
    out = _render(spark, [(1, "{{ label }} and ||| inside", 1)], "{{ text }} ||| {{ label }}")
    assert out[0][1] == "{{ label }} and ||| inside" and out[0][2] == "1"


def test_unicode_and_choices_absent(spark):
    out = _render(spark, [(1, "中文 é", 0)], "Q: {{ text }} ||| ok")
    assert out[0][1:] == ("Q: 中文 é", "ok", None)


def test_format_template_and_verbaliser(spark):
    df = spark.createDataFrame([("p", 'h"q', 0), ("", "h", 2), ("p", "h", -1)], "premise string, hypothesis string, label long")
    t = FormatTemplate("t", '{premise} -> "{hypothesis}"?', ["Yes", "Maybe", "No"])
    rows = [tuple(r) for r in t.apply(df).collect()]
    assert rows[0] == ("t", 'p -> "h"q"?', "Yes")
    assert rows[1][2] == "No" and rows[2][2] == NO_LABEL
    v = df.select(verbalise(F.col("label"), ["A", "B", "C"], python_index=True).alias("v")).collect()
    assert [r.v for r in v] == ["A", "C", "C"]


def test_rename_hyphens_later_wins(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a-b` int, a_b int, c int")
    out = rename_hyphens(df)
    assert out.columns == ["a_b", "c"] and out.collect()[0].a_b == 2
    df2 = spark.createDataFrame([(1, 2)], "a_b int, `a-b` int")
    assert rename_hyphens(df2).collect()[0].a_b == 2


def test_task_names_and_strip(spark):
    df = spark.createDataFrame([("ds", None, "x y"), ("d-s", "sub é", "t/中")], "d string, s string, t string")
    names = [r.n for r in df.select(task_name("d", "s", "t").alias("n")).collect()]
    assert names == ["ds_x_y", "d_s_sub_é_t_中"]
    s = spark.createDataFrame([(" \t a b \n",)], "x string").select(strip("x").alias("y"), task_clean(F.lit("a..b  c")).alias("z"))
    assert tuple(s.collect()[0]) == ("a b", "a..b_c")


def test_template_filter_and_rejects(spark):
    t = spark.createDataFrame(
        [("d", None, "a", "{{ text }} ||| x", None, True, "1"), ("d", None, "a-translate-de", "{{ text }} ||| x", None, False, "2"),
         ("d", None, "bad", "{{ nope }} ||| x", None, True, "3"), ("d", None, "sep", "{{ text }}", None, True, "4")],
        "dataset string, subset string, name string, jinja string, answer_choices string, original_task boolean, id string",
    )
    assert sorted(r.name for r in template_filter(t).collect()) == ["a", "bad", "sep"]
    assert sorted(r.name for r in template_filter(t, include_translated=True, original_only=True).collect()) == ["a", "bad", "sep"]
    rej = {(r.name, r.reason) for r in template_rejects(t, ["text"]).collect()}
    assert rej == {("bad", "unknown field: nope"), ("sep", "separator count")}


def test_choice_of_a_field_that_is_no_number(spark):
    from pyspark.sql import functions as F

    from promptlake.operators.templates import render_field_template

    df = spark.createDataFrame([("abc",)], "label string")
    r = df.select(render_field_template(F.lit("Q ||| {{ answer_choices[label] }}"), F.lit("No ||| Yes"), F.create_map(F.lit("label"), "label")).alias("r")).first().r
    assert (r.inputs, r.targets) == ("Q", "<NO LABEL>")


def test_rejected_templates_are_left_out(spark):
    from promptlake.operators.templates import template_rejects, usable_templates

    rows = [("d", None, "ok", "{{ text }} ||| {{ label }}", None), ("d", None, "field", "{{ title }} ||| x", None), ("d", "s", "block", "{% if text %}a{% endif %} ||| x", None), ("d", "s", "filter", "{{ text | upper }} ||| x", None), ("d", "s", "parts", "only one", None)]
    t = spark.createDataFrame(rows, "dataset string, subset string, name string, jinja string, answer_choices string")
    assert [r.name for r in usable_templates(t, ["text", "label"]).collect()] == ["ok"]
    assert {r.name for r in template_rejects(t, ["text", "label"]).collect()} == {"field", "block", "filter", "parts"}


def test_input_lengths_without_rendering(spark):
    from promptlake.operators.templates import input_lengths

    data = spark.createDataFrame([("d", "s", "héllo"), ("d", "s", None)], "dataset string, subset string, text string")
    t = spark.createDataFrame([("d", "s", "a", "Say {{ text }} twice {{ text }} ||| x", None)], "dataset string, subset string, name string, jinja string, answer_choices string")
    assert sorted(r.length for r in input_lengths(data, t, ["text"], keep=["task"]).collect()) == [12, 24]
