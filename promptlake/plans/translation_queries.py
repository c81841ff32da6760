"""Registered queries: template translation round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import translation as X
from ..operators.templates import template_filter
from ..session import scratch_path
from ..sources.tables import corpus, read
from .prompts import corpus_templates
from .registry import register

# The templates of the round trip (one has >= 10 entities so {e1} and {e10}
# coexist, one has a name with " - " and a trailing space, one already has a German version),
# and the target languages of the translated table.
TRANSLATION_PROMPTS = [
    ("quality", "{{ text }}\nIs this text well written? ||| {{ answer_choices[quality] }}", "No ||| Yes", True),
    ("percent", "What % of {{ text }} is noise?\n{% if quality == 1 %}Clean{% endif %} ||| {{ subset }}", None, True),
    ("many", "{{a}} {{b}} {c} {{d}} {{e}} {{f}} {{g}} {{h}} {{i}} {{j}} {{k}} ||| {{ l }}", None, False),
    ("Generate - Title ", "Title - for {{ text }}:\n| keep | ||| {{ dataset }}", None, True),
    ("quality-translate-de", "{{ text }}\nGut? ||| {{ answer_choices[quality] }}", "Nein ||| Ja", False),
]
TARGET_LANGS = ["de", "es", "fr"]
# CSV exchange format: header, quoted multi-line fields, whitespace kept as is.
CSV_OPTS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _templates(spark, sf_dir):
    """The prompt list on every (dataset, subset), and one template per benchmark item with its text."""
    items = read(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("dataset"),
        F.lit("items").alias("subset"),
        F.lit(0).alias("ordinal"),
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("name"),
        F.concat("text", F.lit(" {{ text }} ||| {{ answer_choices[quality] }}")).alias("jinja"),
        F.lit("No ||| Yes").alias("answer_choices"),
        F.lit(True).alias("original_task"),
    )
    return corpus_templates(corpus(spark, sf_dir), TRANSLATION_PROMPTS, materialise=False).unionByName(items)


def _masked(spark, sf_dir):
    return X.mask_templates(template_filter(_templates(spark, sf_dir), include_translated=False))


def translated_fixture(masked):
    """Stand-in for the external translation step: per language, the masked text with the
    kind of damage machine translation does (entity ids upper-cased and spaced, spaced
    separators, Arabic percent sign), keyed by the name with trailing spaces dropped."""
    damage = {
        "de": lambda c: F.regexp_replace(c, "\\{e([0-9]+)\\}", "{E $1}"),
        "es": lambda c: F.replace(c, F.lit("|||"), F.lit("| | |")),
        "fr": lambda c: F.replace(c, F.lit("%"), F.lit("٪")),
    }
    cols = [F.concat(F.lit(f"[{lang}] "), damage[lang](F.col("masked"))).alias(lang) for lang in TARGET_LANGS]
    return masked.select(F.rtrim("key").alias("template_name"), F.col("masked").alias("template_string"), *cols)


def _translated_long(spark, sf_dir):
    """Write the wide translated table as CSV (as the reference exchanges it), read it back,
    unpivot the language columns."""
    wide = translated_fixture(_masked(spark, sf_dir))
    path = scratch_path(spark, "template_translated")
    opts = CSV_OPTS
    wide.write.options(**opts).mode("overwrite").csv(path)
    back = spark.read.options(**opts).schema(wide.schema).csv(path)
    return X.unpivot_languages(back)


# --- DuckDB fragments ------------------------------------------------------------------------

_PROMPTS_SQL = ", ".join(
    "(" + ", ".join("NULL" if v is None else ("'" + str(v).replace("'", "''").replace("\n", "' || chr(10) || '") + "'") for v in (i, n, j, c)) + ")"
    for i, (n, j, c, _) in enumerate(TRANSLATION_PROMPTS)
)
_TPL_SQL = f"""k AS (SELECT DISTINCT source AS dataset, lang AS subset FROM documents),
  p AS (SELECT * FROM (VALUES {_PROMPTS_SQL}) v(ordinal, name, jinja, answer_choices)),
  tpl AS (SELECT k.dataset, k.subset, p.name, p.jinja, p.answer_choices FROM k CROSS JOIN p
          UNION ALL SELECT 'benchmark', 'items', 'item-' || item_id, text || ' {{{{ text }}}} ||| {{{{ answer_choices[quality] }}}}', 'No ||| Yes' FROM benchmark),
  src AS (SELECT *, dataset || ' - ' || subset || ' - ' || name AS key,
                 regexp_extract_all(jinja, '(?s)\\{{\\{{.*?\\}}\\}}|\\{{.*?\\}}') AS ents,
                 regexp_split_to_array(jinja, '(?s)\\{{\\{{.*?\\}}\\}}|\\{{.*?\\}}') AS parts
          FROM tpl WHERE name NOT LIKE '%-translate-%'),
  masked AS (SELECT key, dataset, subset, name, answer_choices, ents,
                    parts[1] || array_to_string(list_transform(range(1, len(parts)), lambda i: '{{e' || i || '}}' || parts[i + 1]), '') AS masked
             FROM src)"""

_TRANS_SQL = f"""{_TPL_SQL},
  wide AS (SELECT rtrim(key) AS template_name, masked AS template_string,
                  '[de] ' || regexp_replace(masked, '\\{{e([0-9]+)\\}}', '{{E \\1}}', 'g') AS de,
                  '[es] ' || replace(masked, '|||', '| | |') AS es,
                  '[fr] ' || replace(masked, '%', '٪') AS fr FROM masked),
  tr AS (SELECT template_name, 'de' AS lang, de AS translated FROM wide
         UNION ALL SELECT template_name, 'es', es FROM wide UNION ALL SELECT template_name, 'fr', fr FROM wide),
  r1 AS (SELECT template_name, lang, regexp_replace(replace(translated, '٪', '%'), '\\|.*\\|', '|||', 'g') AS t FROM tr),
  r2 AS (SELECT template_name, lang, t, regexp_split_to_array(t, '(?s)\\{{.*?\\}}') AS lits, regexp_extract_all(t, '(?s)\\{{.*?\\}}') AS br FROM r1),
  rep AS (SELECT template_name, lang,
                 lits[1] || array_to_string(list_transform(range(1, len(lits)), lambda i:
                   (CASE WHEN regexp_matches(lower(br[i]), '\\{{e.*?[0-9]\\}}') THEN replace(lower(br[i]), ' ', '') ELSE lower(br[i]) END) || lits[i + 1]), '') AS repaired
          FROM r2),
  look AS (SELECT rep.*, COALESCE(m1.key, m2.key) AS key, COALESCE(m1.ents, m2.ents) AS ents,
                  CASE WHEN m1.key IS NOT NULL THEN m1.answer_choices ELSE m2.answer_choices END AS answer_choices
           FROM rep LEFT JOIN masked m1 ON m1.key = rep.template_name
                    LEFT JOIN masked m2 ON m2.key = rep.template_name || ' ' AND m1.key IS NULL),
  ph AS (SELECT *, regexp_split_to_array(repaired, '\\{{e[0-9]+\\}}') AS pl, regexp_extract_all(repaired, '\\{{e([0-9]+)\\}}', 1) AS pi FROM look),
  restored AS (SELECT key, lang, answer_choices,
                      'Answser in English, ' || chr(10) ||
                      pl[1] || array_to_string(list_transform(range(1, len(pl)), lambda i:
                        COALESCE(CASE WHEN CAST(pi[i] AS INTEGER) BETWEEN 1 AND len(ents) THEN ents[CAST(pi[i] AS INTEGER)] END, '{{e' || pi[i] || '}}') || pl[i + 1]), '') AS jinja
               FROM ph)"""


@register(
    "tmpl_entities",
    f"WITH {_TPL_SQL} SELECT key, CAST(i AS INTEGER) AS pos, ents[i] AS entity FROM (SELECT key, ents, unnest(range(1, len(ents) + 1)) AS i FROM masked)",
)
def q_tmpl_entities(spark, sf_dir):
    m = _masked(spark, sf_dir)
    return m.select("key", F.posexplode("entities").alias("pos", "entity")).select("key", (F.col("pos") + 1).alias("pos"), "entity")


@register("tmpl_mask", f"WITH {_TPL_SQL} SELECT key, masked, CAST(len(ents) AS INTEGER) AS n_entities FROM masked")
def q_tmpl_mask(spark, sf_dir):
    return _masked(spark, sf_dir).select("key", "masked", F.size("entities").alias("n_entities"))


@register(
    "tmpl_sinks",
    f"WITH {_TPL_SQL} SELECT key, masked, CAST(len(ents) AS INTEGER) AS n_entities, answer_choices FROM masked",
)
def q_tmpl_sinks(spark, sf_dir):
    """Masked templates to CSV and the entity maps to JSON lines, both read back and joined."""
    m = _masked(spark, sf_dir)
    csv_path, json_path = scratch_path(spark, "template_df"), scratch_path(spark, "entities")
    opts = CSV_OPTS
    m.select(F.col("key").alias("template_name"), F.col("masked").alias("template_string")).write.options(**opts).csv(csv_path)
    m.select(F.to_json(F.create_map("key", F.to_json(X.entity_map("entities", "answer_choices")))).alias("value")).write.text(json_path)
    csv = spark.read.options(**opts).schema("template_name string, template_string string").csv(csv_path)
    js = spark.read.text(json_path).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "ents"))
    js = js.select("key", F.from_json("ents", "map<string,string>").alias("m"))
    js = js.select(
        "key",
        F.col("m")["answer_choices"].alias("answer_choices"),
        F.size(F.map_filter("m", lambda k, v: k.startswith("{e"))).alias("n_entities"),
    )
    return csv.join(js, csv.template_name == js.key).select("key", F.col("template_string").alias("masked"), "n_entities", "answer_choices")


@register(
    "tmpl_parse_name",
    f"""WITH {_TPL_SQL}
        SELECT key, split_part(key, ' - ', 1) AS dataset, NULLIF(split_part(key, ' - ', 2), 'None') AS subset,
               array_to_string(string_split(key, ' - ')[3:], ' - ') AS name FROM masked""",
)
def q_tmpl_parse_name(spark, sf_dir):
    m = _masked(spark, sf_dir)
    d, s, n = X.parse_key("key")
    return m.select("key", d.alias("dataset"), s.alias("subset"), n.alias("name"))


@register("tmpl_unpivot", f"WITH {_TRANS_SQL} SELECT template_name, lang, translated FROM tr")
def q_tmpl_unpivot(spark, sf_dir):
    return _translated_long(spark, sf_dir)


@register("tmpl_repair", f"WITH {_TRANS_SQL} SELECT template_name, lang, repaired FROM rep")
def q_tmpl_repair(spark, sf_dir):
    t = _translated_long(spark, sf_dir)
    return t.select("template_name", "lang", X.repair("translated").alias("repaired"))


@register("tmpl_restore", f"WITH {_TRANS_SQL} SELECT key, lang, jinja, answer_choices FROM restored")
def q_tmpl_restore(spark, sf_dir):
    return X.restore_translations(_translated_long(spark, sf_dir), _masked(spark, sf_dir))


@register(
    "tmpl_add_new",
    f"""WITH {_TRANS_SQL},
        parsed AS (SELECT split_part(key, ' - ', 1) AS dataset, NULLIF(split_part(key, ' - ', 2), 'None') AS subset,
                          array_to_string(string_split(key, ' - ')[3:], ' - ') AS base, lang, jinja, answer_choices FROM restored),
        new AS (SELECT dataset, subset, base || '-translate-' || lang AS name, jinja, answer_choices,
                       'Translated version of ' || base || ' in ' || lang AS reference FROM parsed),
        fresh AS (SELECT * FROM new n WHERE NOT EXISTS (
                    SELECT 1 FROM tpl t WHERE t.dataset = n.dataset AND t.subset IS NOT DISTINCT FROM n.subset AND t.name = n.name))
        SELECT dataset, subset, name, jinja, answer_choices, reference,
               '00000000-0000-0000-0000-' || lpad(CAST(row_number() OVER (PARTITION BY dataset, subset ORDER BY name) - 1 AS VARCHAR), 12, '0') AS id
        FROM fresh""",
)
def q_tmpl_add_new(spark, sf_dir):
    existing = _templates(spark, sf_dir)
    restored = X.restore_translations(_translated_long(spark, sf_dir), _masked(spark, sf_dir))
    return X.add_translated(existing, restored).select("dataset", "subset", "name", "jinja", "answer_choices", "reference", "id")
