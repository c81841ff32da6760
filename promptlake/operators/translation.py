"""Prompt-template translation round trip: mask template syntax, repair and restore translations,
add the translated templates.

All steps are column expressions over template tables (one row per template, or per template
and language), so they run as one plan over any number of templates:

* ``mask``: every ``{...}``, ``{{...}}`` or ``{%...%}`` entity becomes ``{e1}``, ``{e2}``...
  (ordered, non-greedy, across lines); the entities are kept in an ordered array.
* ``repair``: undo typical damage of translated text (Arabic percent sign, separators with
  spaces, upper case or spaces inside ``{e n}``).
* ``restore``: put the entities back (placeholders resolved by index in one pass, literal
  text, never re-interpreted as a pattern), then prefix the fixed instruction.
* ``add_translated``: one new template per (template, language) unless the name exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hof import let
from .ranking import broadcast_checked

# Entity pattern, placeholder format, key separator, instruction prefix (as the
# reference spells it), id prefix and the reference text of added templates.
ENTITY_REGEX = "(?s)(?:\\{|\\{\\{).*?(?:\\}\\}|\\})"
BRACE_REGEX = "(?s)\\{.*?\\}"
PLACEHOLDER_REGEX = "\\{e([0-9]+)\\}"
ENTITY_ID_REGEX = "\\{e.*?[0-9]\\}"
KEY_SEP = " - "
PREFIX = "Answser in English, \n"
ID_PREFIX = "00000000-0000-0000-0000-"
TRANSLATE_MARK = "-translate-"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def template_key(dataset, subset, name) -> Column:
    """``dataset - subset - name`` with a missing subset written as ``None``."""
    return F.concat_ws(KEY_SEP, _c(dataset), F.coalesce(_c(subset), F.lit("None")), _c(name))


def parse_key(key) -> tuple[Column, Column, Column]:
    """Inverse of ``template_key``; the name may itself contain `` - ``; ``None`` -> null."""
    parts = F.split(_c(key), KEY_SEP, 3)
    subset = F.element_at(parts, 2)
    return F.element_at(parts, 1), F.when(subset == "None", F.lit(None)).otherwise(subset), F.element_at(parts, 3)


def entities(jinja) -> Column:
    return F.regexp_extract_all(_c(jinja), F.lit(ENTITY_REGEX), 0)


def mask(jinja) -> Column:
    """Replace the i-th entity by ``{ei}`` (1-based)."""
    parts = F.split(_c(jinja), ENTITY_REGEX, -1)
    tail = F.transform(F.slice(parts, 2, 1 << 30), lambda p, i: F.concat(F.lit("{e"), (i + 1).cast("string"), F.lit("}"), p))
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def entity_map(ents, choices) -> Column:
    """``{"answer_choices": ..., "{e1}": ..., ...}`` as a map (the JSON sink format)."""
    keys = F.concat(F.array(F.lit("answer_choices")), F.transform(_c(ents), lambda e, i: F.concat(F.lit("{e"), (i + 1).cast("string"), F.lit("}"))))
    vals = F.concat(F.array(_c(choices)), _c(ents))
    return F.map_from_arrays(keys, vals)


def repair(text) -> Column:
    """``٪`` -> ``%``; from the first to the last ``|`` of a line -> ``|||``; inside every
    ``{...}`` lower case, and no spaces when it is an entity placeholder."""
    t = F.translate(_c(text), "٪", "%")
    t = F.regexp_replace(t, "\\|.*\\|", "|||")
    lits = F.split(t, BRACE_REGEX, -1)
    braces = F.regexp_extract_all(t, F.lit(BRACE_REGEX), 0)
    fixed = F.transform(
        braces,
        lambda b: F.when(F.lower(b).rlike(ENTITY_ID_REGEX), F.regexp_replace(F.lower(b), " ", "")).otherwise(F.lower(b)),
    )
    tail = F.zip_with(fixed, F.slice(lits, 2, 1 << 30), lambda b, lit: F.concat(b, lit))
    return F.concat(F.element_at(lits, 1), F.array_join(tail, ""))


def restore(text, ents) -> Column:
    """Placeholders ``{ei}`` -> i-th entity (unknown placeholders stay as they are)."""
    return let(_c(ents), lambda e: _restore(text, e))


def _restore(text, ents) -> Column:
    lits = F.split(_c(text), "\\{e[0-9]+\\}", -1)
    idx = F.regexp_extract_all(_c(text), F.lit(PLACEHOLDER_REGEX), 1)
    vals = F.transform(
        idx,
        lambda i: F.coalesce(
            F.when(i.try_cast("int").between(1, F.size(_c(ents))), F.element_at(_c(ents), i.try_cast("int"))),
            F.concat(F.lit("{e"), i, F.lit("}")),
        ),
    )
    tail = F.zip_with(vals, F.slice(lits, 2, 1 << 30), lambda v, lit: F.concat(v, lit))
    return F.concat(F.element_at(lits, 1), F.array_join(tail, ""))


def mask_templates(templates: DataFrame) -> DataFrame:
    """(key, masked, entities, answer_choices) per template."""
    return templates.select(
        template_key("dataset", "subset", "name").alias("key"),
        mask("jinja").alias("masked"),
        entities("jinja").alias("entities"),
        "answer_choices",
    )


def unpivot_languages(wide: DataFrame, id_cols=("template_name", "template_string")) -> DataFrame:
    """Wide table with one column per language -> (template_name, lang, translated).

    The language set is the column-set difference with the id columns (schema only)."""
    langs = [c for c in wide.columns if c not in id_cols]
    return wide.unpivot(list(id_cols), langs, "lang", "translated").select("template_name", "lang", "translated")


def lookup_entities(translated: DataFrame, masked: DataFrame) -> DataFrame:
    """Attach the entity list by key; a key that misses is retried with a trailing space."""
    m = masked.select("key", "entities", "answer_choices")
    exact = m.select(F.col("key").alias("template_name"), F.col("entities").alias("e1"), F.col("answer_choices").alias("c1"), F.lit(True).alias("hit1"))
    spaced = m.select(
        F.expr("substring(key, 1, length(key) - 1)").alias("template_name"),
        F.col("entities").alias("e2"),
        F.col("answer_choices").alias("c2"),
        F.col("key").alias("key2"),
    ).where(F.col("key").endswith(" "))
    j = translated.join(exact, "template_name", "left").join(spaced, "template_name", "left")
    return j.select(
        "*",
        F.when(F.col("hit1"), F.col("template_name")).otherwise(F.col("key2")).alias("key"),
        F.when(F.col("hit1"), F.col("e1")).otherwise(F.col("e2")).alias("entities"),
        F.when(F.col("hit1"), F.col("c1")).otherwise(F.col("c2")).alias("answer_choices"),
    ).drop("e1", "c1", "hit1", "e2", "c2", "key2")


def restore_translations(translated: DataFrame, masked: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(key, lang, jinja, answer_choices): repaired, entities restored, instruction prefixed."""
    j = lookup_entities(translated, masked)
    return j.select(
        "key",
        "lang",
        F.concat(F.lit(prefix), restore(repair("translated"), "entities")).alias("jinja"),
        "answer_choices",
    )


def add_translated(existing: DataFrame, restored: DataFrame) -> DataFrame:
    """New templates ``{name}-translate-{lang}`` not present yet, numbered per (dataset, subset)."""
    d, s, n = parse_key("key")
    new = restored.select(
        d.alias("dataset"),
        s.alias("subset"),
        n.alias("base"),
        F.concat(n, F.lit(TRANSLATE_MARK), "lang").alias("name"),
        "jinja",
        "answer_choices",
        F.concat(F.lit("Translated version of "), n, F.lit(" in "), "lang").alias("reference"),
    )
    ex = broadcast_checked(existing.select("dataset", "subset", "name"), "existing_templates")
    # null-safe anti join on (dataset, subset, name): a missing subset is a value of its own
    cond = (new.dataset == ex.dataset) & new.subset.eqNullSafe(ex.subset) & (new.name == ex.name)
    fresh = new.join(ex, cond, "left_anti")
    w = Window.partitionBy("dataset", "subset").orderBy("name")
    return fresh.withColumn("id", F.concat(F.lit(ID_PREFIX), F.lpad((F.row_number().over(w) - 1).cast("string"), 12, "0"))).drop("base")
