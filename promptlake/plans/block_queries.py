"""Registered queries: templates with blocks, filters and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.template_blocks import block_rejects, render_blocks
from ..operators.templates import nonempty_pairs
from ..sources.tables import labelled_corpus
from .prompts import corpus_templates
from .registry import register
from .sqlparts import LABELLED_SQL, STRIP, TASK

# Templates with blocks, filters and paths: (name, text, answer choices, original_task).
BLOCK_PROMPTS = [
    ("if_label", "{% if quality == 1 %}Good{% else %}Other{% endif %} text: {{ text }} ||| {{ answer_choices[quality] }}", "no ||| yes", True),
    ("elif_size", "{{ text }}\n{% if n_chars > 2000 %}Long{% elif n_chars > 500 %}Medium{% else %}Short{% endif %}? ||| {{ subset | upper }}", None, True),
    ("paths", "Source {{ meta.source }}, language {{ meta['lang'] }}: {{ text | trim }} ||| {{ meta.size.chars }}", None, True),
    ("only_labelled", "{% if toxic is not none %}{{ text }}\nToxic? ||| {{ answer_choices[toxic] }}{% endif %}", "No ||| Yes", True),
    ("inline_if", '{{ text }} ({{ quality | default("unlabelled") }}) ||| {{ "yes" if toxic == 1 else "no" }}', None, True),
    ("membership", '{% if subset in ["en", "de"] and not toxic %}{{ dataset }}: {{ lines | first }} ||| {{ lines | length }}{% endif %}', None, True),
    ("joined", '{{ lines | join(" / ") | replace(".", "!") }} ||| {{ (lines | last).lower() }}', None, True),
    ("spaces", "A\n{%- if n_chars is defined -%}\n  : {{- text[:40] -}}  .\n{%- endif %} ||| {# no output #}{{ split | capitalize }}", None, True),
    ("own_choices", '{{ text }} ||| {{ answer_choices[0 if subset == "en" else 1] }}', "{{ meta.lang }} text ||| foreign", True),
    ("numbers", "{% set half = n_chars // 2 %}{{ 'id ' ~ id }}: {{ half }} {{ 'ok' if n_chars / 2 >= half else 'odd' }} ||| {{ (n_chars + 1) % 7 * 2 }}", None, True),
    ("loop", "{% for x in lines %}{{ x }}{% endfor %} ||| {{ subset }}", None, True),
    ("macro", "{{ text }} ||| {{ render(subset) }}", None, True),
    ("no_filter", "{{ text | shuffle }} ||| {{ subset }}", None, True),
    ("no_field", "{{ meta.page }} ||| {{ subset }}", None, True),
]

_PAIRS = {
    "if_label": ("(CASE WHEN quality = 1 THEN 'Good' ELSE 'Other' END) || ' text: ' || text", "coalesce(['no', 'yes'][quality + 1], '')"),
    "elif_size": ("text || chr(10) || (CASE WHEN n_chars > 2000 THEN 'Long' WHEN n_chars > 500 THEN 'Medium' ELSE 'Short' END) || '?'", "upper(subset)"),
    "paths": (f"'Source ' || dataset || ', language ' || subset || ': ' || {STRIP('text')}", "CAST(n_chars AS VARCHAR)"),
    "only_labelled": ("CASE WHEN toxic IS NOT NULL THEN text || chr(10) || 'Toxic?' ELSE '' END", "CASE WHEN toxic IS NOT NULL THEN ['No', 'Yes'][toxic + 1] END"),
    "inline_if": ("text || ' (' || coalesce(CAST(quality AS VARCHAR), 'unlabelled') || ')'", "CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END"),
    "membership": (
        "CASE WHEN subset IN ('en', 'de') AND coalesce(toxic, 0) = 0 THEN dataset || ': ' || string_split(text, chr(10))[1] ELSE '' END",
        "CAST(len(string_split(text, chr(10))) AS VARCHAR)",
    ),
    "joined": ("replace(replace(text, chr(10), ' / '), '.', '!')", "lower(string_split(text, chr(10))[-1])"),
    "spaces": ("'A:' || substr(text, 1, 40) || '.'", "upper(substr(split, 1, 1)) || substr(split, 2)"),
    "own_choices": ("text", "CASE WHEN subset = 'en' THEN 'en text' ELSE 'foreign' END"),
    "numbers": ("'id ' || id || ': ' || (n_chars // 2) || ' ok'", "CAST(((n_chars + 1) % 7) * 2 AS VARCHAR)"),
}


def _block_sql() -> str:
    each = []
    for name, (inputs, targets) in _PAIRS.items():
        i, t = STRIP(f"({inputs})"), STRIP(f"coalesce({targets}, '')")
        each.append(f"SELECT {TASK('dataset', 'subset', repr(name))} AS task, id, {i} AS inputs, CASE WHEN {t} = '' THEN '<NO LABEL>' ELSE {t} END AS targets FROM c WHERE length({i}) > 0")
    return f"WITH c AS ({LABELLED_SQL}) " + " UNION ALL ".join(each)


def with_paths(rows):
    """Rows with a struct and a list, as nested datasets have them."""
    size = F.struct(F.col("n_chars").alias("chars"))
    return rows.withColumn("meta", F.struct(F.col("dataset").alias("source"), F.col("subset").alias("lang"), size.alias("size"))).withColumn("lines", F.split("text", "\n"))


@register("render_blocks", _block_sql())
def q_render_blocks(spark, sf_dir):
    """Ten templates with blocks, filters and paths over all labelled documents."""
    data = with_paths(labelled_corpus(spark, sf_dir))
    out = render_blocks(data, corpus_templates(data, BLOCK_PROMPTS), keep=("task", "id"))
    return nonempty_pairs(out).select("task", "id", "inputs", "targets")


@register(
    "block_rejects",
    """SELECT dataset, subset, name, reason FROM (SELECT DISTINCT source AS dataset, lang AS subset FROM documents)
       CROSS JOIN (VALUES ('loop', 'unsupported block: for'), ('macro', 'unsupported call: render'), ('no_filter', 'unsupported filter: shuffle'), ('no_field', 'unknown field: page')) v(name, reason)""",
)
def q_block_rejects(spark, sf_dir):
    """Templates that cannot be compiled, with their reasons."""
    data = with_paths(labelled_corpus(spark, sf_dir))
    return block_rejects(corpus_templates(data, BLOCK_PROMPTS), data.schema)
