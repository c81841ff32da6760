"""Templates with blocks, filters and paths: each construct on small rows, rejects with reasons, plan shape."""

import pytest
from pyspark.sql import functions as F

from promptlake.operators import template_blocks as B

SCHEMA = "dataset string, subset string, id long, a int, b double, s string, yes boolean, xs array<string>, m map<string,int>, p struct<q: string, r: struct<t: long>>"
ROWS = [
    ("d", "x", 1, 3, 2.5, " Hello World ", True, ["u", "V", "w"], {"k": 7}, ("deep", (9,))),
    ("d", "x", 2, 0, -1.0, "", False, [], {}, (None, (None,))),
    ("d", "x", 3, None, None, None, None, None, None, None),
    ("d", "x", 4, -2, 4.0, "a ||| b {{ s }}", True, ["one"], {"k": 0}, ("q", (0,))),
]
CASES = [
    ("{{ a }}/{{ b }}/{{ yes }}/{{ s | trim }}", ["3/2.5/True/Hello World", "0/-1.0/False/", "///", "-2/4.0/True/a ||| b {{ s }}"]),
    ("{% if a %}t{% else %}f{% endif %}{% if s %}t{% else %}f{% endif %}{% if xs %}t{% else %}f{% endif %}", ["ttt", "fff", "fff", "ttt"]),
    ("{% if a > 1 %}big{% elif a == 0 %}zero{% elif a is none %}none{% else %}low{% endif %}", ["big", "zero", "none", "low"]),
    ("{{ p.q }}-{{ p.r.t }}-{{ p['q'] | upper }}-{{ m.k }}-{{ m['k'] }}", ["deep-9-DEEP-7-7", "----", "----", "q-0-Q-0-0"]),
    ("{{ xs[0] }}{{ xs[-1] }}{{ xs | last }}{{ xs | length }}", ["uw3", "0", "", "oneone1"]),
    ("{{ xs | join('+') }}={{ xs[1:] | join('') }}", ["u+V+w=Vw", "=", "=", "one="]),
    ("{{ 'V' in xs }} {{ 'World' in s }} {{ a in [1, 3] }} {{ a not in [1, 3] }}", ["True True True False", "False False False True", "False False False True", "False False False True"]),
    ("{{ a + 1 }} {{ a * 2 - 1 }} {{ 7 // 2 }} {{ -7 // 2 }} {{ 7 % 4 }} {{ 1 / 2 }}", ["4 5 3 -4 3 0.5", "1 -1 3 -4 3 0.5", "  3 -4 3 0.5", "-1 -5 3 -4 3 0.5"]),
    ("{{ a ~ ':' ~ s.strip().lower() }}", ["3:hello world", "0:", ":", "-2:a ||| b {{ s }}"]),
    ("{{ 'x' if yes else 'y' }}{{ s or 'empty' }}{{ a | default('none') }}{{ nothing | default('?') }}", ["x Hello World 3?", "yempty0?", "yemptynone?", "xa ||| b {{ s }}-2?"]),
    ("{{ not a }} {{ a and yes }} {{ a == 3 or b == 4 }}", ["False True True", "True False False", "True False False", "False True True"]),
    ("{% set n = a | default(10) %}{% if n > 2 %}{% set n = 99 %}{{ n }}{% endif %}.{{ n }}", ["99.3", ".0", "99.10", ".-2"]),
    ("q  {#- c -#}  x  {%- if true -%}  y  {%- endif -%}  z", ["qxyz"] * 4),
    ("{{ s is defined }}{{ nothing is defined }}{{ a is not none }}", ["TrueFalseTrue", "TrueFalseTrue", "FalseFalseFalse", "TrueFalseTrue"]),
    ("{{ 2 * a | abs }}|{{ (2 * a) | abs }}|{{ '12' | int + 1 }}|{{ 'xY' | capitalize }}", ["6|6|13|Xy", "0|0|13|Xy", "||13|Xy", "4|4|13|Xy"]),
    ("{{ s.split(' ')[1] }}{{ s.startswith(' H') }}{{ s[:2] }}", ["HelloTrue H", "False", "", "|||Falsea"]),
    ("{{ 1 < a < 4 }} {{ s != 'x' }} {{ a == 'x' }} {{ b >= 2.5 }}", ["True True False True", "False True False False", "False True False False", "False True False True"]),
]
REJECTS = [
    ("{% for x in xs %}{{ x }}{% endfor %}", "unsupported block: for"), ("{% macro f() %}{% endmacro %}", "unsupported block: macro"),
    ("{{ s | shuffle }}", "unsupported filter: shuffle"), ("{{ f(s) }}", "unsupported call: f"), ("{{ t }}", "unknown field: t"), ("{{ p.z }}", "unknown field: z"),
    ("{% if a %}x", "block without end: if"), ("x{% endif %}", "unsupported block: endif"), ("{{ a + }}", "syntax: a +"), ("{{ p }}", "no text form: struct<q:string,r:struct<t:bigint>>"),
    ("{{ s + 1 }}", "not a text: bigint"), ("{{ a < s }}", "compared types differ"), ("{{ xs['u'] }}", "unknown field: u"), ("{{ s | replace('a') }}", "arguments of replace"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _templates(spark, texts, choices=None):
    made = [("d", "x", f"t{i}", t, choices, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, "dataset string, subset string, name string, jinja string, answer_choices string, original_task boolean")


def test_constructs(spark, rows):
    templates = _templates(spark, ["in " + t + " . ||| {{ id }}" for t, _ in CASES])
    got = {(r.template, r.id): r for r in B.render_blocks(rows, templates).collect()}
    assert len(got) == len(CASES) * len(ROWS)
    for i, (text, want) in enumerate(CASES):
        for (_, _, id_, *_), w in zip(ROWS, want, strict=True):
            r = got[f"t{i}", id_]
            assert " ".join(r.inputs.split()) == " ".join(f"in {w} .".split()) and r.targets == str(id_), (text, id_, r.inputs)


def test_parts_choices_and_empty_pairs(spark, rows):
    templates = _templates(spark, ["{% if a %}{{ s }} ||| {{ answer_choices[a - 1] }}{% endif %}", "one part", "a ||| b ||| c", "x ||| {% if a %}{% endif %}"], "{{ p.q }} ||| {{ xs | first }} ||| third")
    got = {(r.template, r.id): (r.inputs, r.targets) for r in B.render_blocks(rows, templates).collect()}
    assert [got["t0", i] for i in (1, 2, 3, 4)] == [("Hello World", "third"), ("", ""), ("", ""), ("a ||| b {{ s }}", "<NO LABEL>")]
    assert {got["t1", 1], got["t2", 1]} == {("", "")} and got["t3", 1] == ("x", "<NO LABEL>")
    choices = {r.id: r.answer_choices for r in B.render_blocks(rows, templates).where("template = 't0'").collect()}
    assert choices[1] == ["deep", "u", "third"] and choices[3] == ["", "", "third"]


def test_rejects(spark, rows):
    templates = _templates(spark, [t + " ||| y" for t, _ in REJECTS] + ["{{ a }} ||| {{ s }}"])
    got = {r.name: r.reason for r in B.block_rejects(templates, rows.schema).collect()}
    assert got == {f"t{i}": reason for i, (_, reason) in enumerate(REJECTS)}
    assert {r.template for r in B.render_blocks(rows, templates).collect()} == {f"t{len(REJECTS)}"}


def test_more_templates_than_one_projection(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "BRANCHES", 4)
    templates = _templates(spark, [f"{{{{ a }}}} t{i} ||| {{{{ id }}}}" for i in range(10)] + ["{{ a }} t0 ||| {{ id }}"])
    got = B.render_blocks(rows, templates).where("id = 1").collect()
    assert sorted(r.inputs for r in got) == sorted([f"3 t{i}" for i in range(10)] + ["3 t0"])
    assert B.render_blocks(rows, templates.limit(0)).count() == 0


def test_no_text_of_templates_in_the_join_and_no_python(spark, rows):
    plan = B.render_blocks(rows, _templates(spark, ["{{ s | upper }} ||| {{ id }}"]))._jdf.queryExecution().executedPlan().toString()
    assert "jinja" not in plan and "Python" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan
    assert F is not None
