"""Registered queries: scans, splits, templates, fan-out, caps and seeded order (S1-S4, P*, J1, L*, W5, W6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip, task_name
from ..operators.catalog import MAX_EXAMPLES, cap_rule_a, cap_rule_b, dataset_stats
from ..operators.ranking import batch_ids, seeded_cap, take_skip
from ..operators.templates import (
    FormatTemplate,
    apply_formats,
    attach_templates,
    nonempty_pairs,
    render_templates,
    rename_hyphens,
    run_chain,
    template_filter,
    verbalise,
)
from ..sources.tables import corpus, labelled_corpus, read
from .prompts import CORPUS_PROMPTS, CORPUS_PROMPTS_WIDE, FIELDS, build_prompts, corpus_templates, flagship
from .registry import register
from .sqlparts import CLEAN, CORPUS_SQL, LABELLED_SQL, STRIP, TASK, U

# ------------------------------------------------------------------------------------------
# flagship


def _flag_sql(cap: str) -> str:
    return f"""
WITH c AS ({LABELLED_SQL}),
tr AS (SELECT * FROM c WHERE split = 'train'),
n AS (SELECT dataset, subset, count(*) AS n FROM tr GROUP BY dataset, subset),
p AS (SELECT * FROM (VALUES (0, 'quality'), (1, 'toxic')) v(ordinal, template)),
f AS (
  SELECT tr.*, p.template, p.ordinal,
         {cap} AS cap,
         {U("CAST(42 + p.ordinal AS VARCHAR)", "tr.id")} AS u
  FROM tr JOIN n USING (dataset, subset) CROSS JOIN p),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, subset, template ORDER BY u, id) AS rn FROM f)
SELECT {TASK('dataset', 'subset', 'template')} AS task, id AS doc_id,
       {STRIP("text || chr(10) || CASE template WHEN 'quality' THEN 'Is this text well written?' ELSE 'Is this text toxic?' END")} AS inputs,
       COALESCE(CASE WHEN template = 'quality' THEN (CASE quality WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END)
                     ELSE (CASE toxic WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END) END, '<NO LABEL>') AS targets
FROM r WHERE rn <= cap
"""


_FLAG_SQL = _flag_sql(f"CASE WHEN n.n * 2 > {MAX_EXAMPLES} THEN {MAX_EXAMPLES} // 2 ELSE n.n END")


@register("prompt_mixture_capped", _FLAG_SQL)
def q_prompt_mixture_capped(spark, sf_dir):
    return flagship(spark, sf_dir)


CAP_SHARE = 0.25  # of each task's rows


@register("prompt_mixture_share", _flag_sql(f"CAST(ceil(n.n * CAST({CAP_SHARE} AS DOUBLE)) AS BIGINT)"))
def q_prompt_mixture_share(spark, sf_dir):
    """The flagship with caps that bind in every task: a share of its rows."""
    out = build_prompts(spark, sf_dir, CORPUS_PROMPTS, "share", CAP_SHARE)
    return out.select("task", F.col("id").alias("doc_id"), "inputs", "targets")


# ------------------------------------------------------------------------------------------
# scans and splits


@register(
    "scan_subset",
    f"SELECT id, split, text FROM ({CORPUS_SQL}) c WHERE dataset = 'src1' AND subset = 'en'",
)
def q_scan_subset(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.where((F.col("dataset") == "src1") & (F.col("subset") == "en")).select("id", "split", "text")


# The logical -> physical split map used by the remap query.
SPLIT_MAP = [("train", "train"), ("dev", "validation"), ("eval", "test")]


@register(
    "split_remap",
    f"""SELECT m.logical AS split, c.dataset, c.subset, c.id
        FROM ({CORPUS_SQL}) c JOIN (VALUES ('train','train'), ('dev','validation'), ('eval','test')) m(logical, physical)
        ON c.split = m.physical""",
)
def q_split_remap(spark, sf_dir):
    m = spark.createDataFrame(SPLIT_MAP, "logical string, physical string")
    c = corpus(spark, sf_dir)
    return c.join(m, c.split == m.physical).select(F.col("logical").alias("split"), "dataset", "subset", "id")


@register(
    "multi_subset_scan",
    f"SELECT subset, dataset, id, text FROM ({CORPUS_SQL}) c WHERE split = 'validation' AND subset IN ('de', 'es', 'fr')",
)
def q_multi_subset_scan(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.where((F.col("split") == "validation") & F.col("subset").isin("de", "es", "fr")).select(
        "subset", "dataset", "id", "text"
    )


@register(
    "dataset_stats",
    f"SELECT dataset, subset, split, count(*) AS num_examples FROM ({CORPUS_SQL}) c GROUP BY dataset, subset, split",
)
def q_dataset_stats(spark, sf_dir):
    return dataset_stats(corpus(spark, sf_dir))


# ------------------------------------------------------------------------------------------
# projections


@register(
    "rename_hyphen",
    "SELECT doc_id, source AS sub_set, n_chars FROM documents",
)
def q_rename_hyphen(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    wide = d.select("doc_id", F.col("lang").alias("sub-set"), F.col("source").alias("sub_set"), F.col("n_chars").alias("n-chars"))
    return rename_hyphens(wide)


def _wide_sql(templates: list[str]) -> str:
    rows = []
    if "quality" in templates:
        rows.append(
            f"SELECT 'quality' AS template, id, dataset, subset, {STRIP('text || chr(10) || ' + repr('Is this text well written?'))} AS inputs, "
            "COALESCE(CASE quality WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END, '<NO LABEL>') AS targets, 'No|Yes' AS choices FROM c"
        )
    if "toxic" in templates:
        rows.append(
            f"SELECT 'toxic', id, dataset, subset, {STRIP('text || chr(10) || ' + repr('Is this text toxic?'))}, "
            "COALESCE(CASE toxic WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END, '<NO LABEL>'), 'No|Yes' FROM c"
        )
    if "language" in templates:
        rows.append(
            f"SELECT 'language', id, dataset, subset, {STRIP(repr('Which language is this text written in?') + ' || chr(10) || text')}, "
            f"COALESCE(NULLIF({STRIP('subset')}, ''), '<NO LABEL>'), NULL FROM c"
        )
    if "source" in templates:
        rows.append(
            f"SELECT 'source', id, dataset, subset, {STRIP('text || chr(10) || ' + repr('Where does this text come from?'))}, "
            f"COALESCE(NULLIF({STRIP('dataset')}, ''), '<NO LABEL>'), NULL FROM c"
        )
    if "quality-translate-de" in templates:
        rows.append(
            f"SELECT 'quality-translate-de', id, dataset, subset, {STRIP('text || chr(10) || ' + repr('Ist dieser Text gut geschrieben?'))}, "
            "COALESCE(CASE quality WHEN 0 THEN 'Nein' WHEN 1 THEN 'Ja' END, '<NO LABEL>'), 'Nein|Ja' FROM c"
        )
    return " UNION ALL ".join(rows)


def _render_all(spark, sf_dir, prompts, include_translated=True):
    data = labelled_corpus(spark, sf_dir)
    tpl = corpus_templates(data, prompts)
    tpl = template_filter(tpl, include_translated=include_translated)
    fanned = attach_templates(data, tpl)
    r = render_templates(fanned, FIELDS, keep=["template", "task", "id"])
    r = nonempty_pairs(r)
    return r.select("task", "id", "inputs", "targets", F.array_join("answer_choices", "|").alias("choices"))


@register(
    "render_template",
    f"""WITH c AS ({LABELLED_SQL}), r AS ({_wide_sql(['quality', 'toxic', 'language', 'source'])})
        SELECT {TASK('dataset', 'subset', 'template')} AS task, id, inputs, targets, choices FROM r""",
)
def q_render_template(spark, sf_dir):
    return _render_all(spark, sf_dir, CORPUS_PROMPTS_WIDE, include_translated=False)


@register(
    "fanout_templates",
    f"""WITH c AS ({LABELLED_SQL}), r AS ({_wide_sql(['quality', 'toxic', 'language', 'source', 'quality-translate-de'])})
        SELECT {TASK('dataset', 'subset', 'template')} AS task, id, inputs, targets, choices FROM r""",
)
def q_fanout_templates(spark, sf_dir):
    return _render_all(spark, sf_dir, CORPUS_PROMPTS_WIDE, include_translated=True)


@register(
    "template_filter",
    """WITH k AS (SELECT DISTINCT source AS dataset, lang AS subset FROM documents)
       SELECT dataset, subset, t.name FROM k CROSS JOIN (VALUES ('quality'), ('toxic')) t(name)""",
)
def q_template_filter(spark, sf_dir):
    data = corpus(spark, sf_dir)
    tpl = corpus_templates(data, CORPUS_PROMPTS_WIDE, materialise=False)
    return template_filter(tpl, include_translated=False, original_only=True).select("dataset", "subset", "name")


# Template names with characters the task-name cleaner must replace.
ODD_TEMPLATE_NAMES = ["Generate Question (é 中)", "yes/no - answer", "plain_name.v2", "trailing "]


@register(
    "task_names",
    f"""WITH k AS (SELECT DISTINCT source AS dataset, lang AS subset FROM documents),
            t AS (SELECT * FROM (VALUES {', '.join("('" + n + "')" for n in ODD_TEMPLATE_NAMES)}) v(template))
       SELECT dataset, subset, template, {TASK('dataset', 'subset', 'template')} AS task,
              {CLEAN("dataset || '_' || template")} AS task_no_subset
       FROM k CROSS JOIN t""",
)
def q_task_names(spark, sf_dir):
    k = corpus(spark, sf_dir).select("dataset", "subset").distinct()
    arr = F.array(*[F.lit(n) for n in ODD_TEMPLATE_NAMES])
    t = k.select("dataset", "subset", F.explode(arr).alias("template"))
    return t.select(
        "dataset",
        "subset",
        "template",
        task_name("dataset", "subset", "template").alias("task"),
        task_name("dataset", F.lit(None).cast("string"), "template").alias("task_no_subset"),
    )


@register(
    "strip_text",
    f"SELECT conv_id, turn, {STRIP(chr(39) + '  ' + chr(39) + ' || text || chr(10) || chr(9)')} AS stripped FROM conversations",
)
def q_strip_text(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", strip(F.concat(F.lit("  "), "text", F.lit("\n\t"))).alias("stripped"))


# ------------------------------------------------------------------------------------------
# format templates over benchmark pairs (NLI / COPA shaped)

# The reference's custom prompts (English NLI evaluation prompt, the two
# target-language NLI prompts, and the choice-of-alternatives prompt) with their verbalisers.
NLI_TEMPLATES = [
    FormatTemplate(
        "based_on_previous_passage_en",
        '{premise} Based on the previous passage, is it true that "{hypothesis}"? Yes, no, or maybe?',
        ["Yes", "Maybe", "No"],
    ),
    FormatTemplate(
        "based_on_previous_passage_id",
        '{premise} Berdasarkan kalimat sebelumnya, apakah benar bahwa "{hypothesis}"? Ya, tidak, atau mungkin?',
        ["Ya", "Mungkin", "Tidak"],
    ),
    FormatTemplate(
        "based_on_previous_passage_zh",
        '{premise} 根据上一句, 是真的吗 "{hypothesis}"? Ya, tidak, atau mungkin?',
        ["Ya", "Mungkin", "Tidak"],
    ),
]
COPA_TEMPLATE = FormatTemplate(
    "given_the_premise_which_is_most_likely_en",
    'Given the premise "{premise}" which is the most likely {question}? A: "{choice1}" or B: "{choice2}"',
    ["A", "B"],
)


def nli_pairs(spark, sf_dir):
    """benchmark item i as premise, item i+1 as hypothesis, label = pmod(i, 4) - 1 (so -1 occurs)."""
    b = read(spark, sf_dir, "benchmark")
    h = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis"))
    return b.join(h, "item_id").select(
        "item_id", F.col("text").alias("premise"), "hypothesis", (F.pmod("item_id", F.lit(4)) - 1).alias("label")
    )


def copa_rows(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    c1 = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("choice1"))
    c2 = b.select((F.col("item_id") - 2).alias("item_id"), F.col("text").alias("choice2"))
    return (
        b.join(c1, "item_id")
        .join(c2, "item_id")
        .select(
            "item_id",
            F.col("text").alias("premise"),
            F.when(F.pmod("item_id", F.lit(2)) == 0, F.lit("cause")).otherwise(F.lit("effect")).alias("question"),
            "choice1",
            "choice2",
            (F.pmod("item_id", F.lit(3)) - 1).alias("label"),
        )
    )


_NLI_PAIRS_SQL = """SELECT b.item_id, b.text AS premise, h.text AS hypothesis, (b.item_id % 4) - 1 AS label
                    FROM benchmark b JOIN benchmark h ON h.item_id = b.item_id + 1"""


def _nli_sql():
    parts = []
    for t in NLI_TEMPLATES:
        name, ch = t.name, t.choices
        mid, tail = t.inputs.replace("{premise}", "").split("{hypothesis}")
        parts.append(
            f"""SELECT item_id, '{name}' AS template, premise || '{mid}' || hypothesis || '{tail}' AS inputs,
                COALESCE(CASE label WHEN 0 THEN '{ch[0]}' WHEN 1 THEN '{ch[1]}' WHEN 2 THEN '{ch[2]}' END, '<NO LABEL>') AS targets
                FROM p"""
        )
    return f"WITH p AS ({_NLI_PAIRS_SQL}) " + " UNION ALL ".join(parts)


@register("render_nli", _nli_sql())
def q_render_nli(spark, sf_dir):
    p = nli_pairs(spark, sf_dir)
    return nonempty_pairs(apply_formats(p, NLI_TEMPLATES, keep=["item_id"]))


# Fixed value: a two-part prompt whose target is built from the row.
CONTINUE = FormatTemplate("continue_premise", "Continue: {premise}", targets="{hypothesis} ({item_id})")


@register(
    "format_targets",
    f"""WITH p AS ({_NLI_PAIRS_SQL}) SELECT item_id, 'continue_premise' AS template, 'Continue: ' || premise AS inputs,
        hypothesis || ' (' || CAST(item_id AS VARCHAR) || ')' AS targets FROM p""",
)
def q_format_targets(spark, sf_dir):
    return CONTINUE.apply(nli_pairs(spark, sf_dir), keep=["item_id"])


@register(
    "preprocess_chain",
    f"""SELECT id, 'Summary (' || upper(subset) || '): ' || {STRIP("text")} AS inputs, CAST(n_chars AS VARCHAR) AS targets
        FROM ({CORPUS_SQL}) c WHERE split = 'train' AND length({STRIP("text")}) > 100""",
)
def q_preprocess_chain(spark, sf_dir):
    """A task's ordered table functions: split filter, strip, length filter, row map, prompt."""
    steps = [
        lambda d: d.where(F.col("split") == "train"),
        lambda d: d.withColumn("text", strip("text")),
        lambda d: d.where(F.length("text") > 100),
        lambda d: d.withColumn("language", F.upper("subset")),
        lambda d: FormatTemplate("summary", "Summary ({language}): {text}", targets="{n_chars}").apply(d, keep=["id"]),
    ]
    return run_chain(corpus(spark, sf_dir), steps).select("id", "inputs", "targets")


# Templates that must be left out of a build.
BAD_PROMPTS = [("unknown", "{{ title }} ||| {{ subset }}", None, True), ("block", "{% if text %}{{ text }}{% endif %} ||| {{ subset }}", None, True)]


@register("build_without_rejects", _flag_sql(f"CASE WHEN n.n * 4 > {MAX_EXAMPLES} THEN {MAX_EXAMPLES} // 4 ELSE n.n END") + " AND subset <> 'es'")
def q_build_without_rejects(spark, sf_dir):
    """A build whose prompt list holds templates that cannot be rendered, with a row filter before it."""
    out = build_prompts(spark, sf_dir, CORPUS_PROMPTS + BAD_PROMPTS, "b", map_fn=lambda d: d.where(F.col("subset") != "es"))
    return out.select("task", F.col("id").alias("doc_id"), "inputs", "targets")


@register(
    "render_copa",
    """WITH p AS (SELECT b.item_id, b.text AS premise, CASE WHEN b.item_id % 2 = 0 THEN 'cause' ELSE 'effect' END AS question,
                         c1.text AS choice1, c2.text AS choice2, (b.item_id % 3) - 1 AS label
                  FROM benchmark b JOIN benchmark c1 ON c1.item_id = b.item_id + 1 JOIN benchmark c2 ON c2.item_id = b.item_id + 2)
       SELECT item_id, 'given_the_premise_which_is_most_likely_en' AS template,
              'Given the premise "' || premise || '" which is the most likely ' || question || '? A: "' || choice1 || '" or B: "' || choice2 || '"' AS inputs,
              COALESCE(CASE label WHEN 0 THEN 'A' WHEN 1 THEN 'B' END, '<NO LABEL>') AS targets
       FROM p""",
)
def q_render_copa(spark, sf_dir):
    return nonempty_pairs(COPA_TEMPLATE.apply(copa_rows(spark, sf_dir), keep=["item_id"]))


@register(
    "verbalise_label",
    """SELECT doc_id, quality + toxic - 1 AS label,
              COALESCE(CASE quality + toxic - 1 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Maybe' WHEN 2 THEN 'No' END, '') AS target,
              CASE quality + toxic - 1 WHEN -1 THEN 'No' WHEN 0 THEN 'Yes' WHEN 1 THEN 'Maybe' WHEN 2 THEN 'No' END AS target_py
       FROM labels""",
)
def q_verbalise_label(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").withColumn("label", F.col("quality") + F.col("toxic") - 1)
    ch = ["Yes", "Maybe", "No"]
    return lab.select(
        "doc_id", "label", verbalise(F.col("label"), ch).alias("target"), verbalise(F.col("label"), ch, True).alias("target_py")
    )


@register(
    "no_label_fill",
    f"""SELECT id AS doc_id, COALESCE(CASE quality WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END, '<NO LABEL>') AS targets
        FROM ({LABELLED_SQL}) c""",
)
def q_no_label_fill(spark, sf_dir):
    c = labelled_corpus(spark, sf_dir)
    t = FormatTemplate("q", "{text}", ["No", "Yes"], label_col="quality")
    return t.apply(c, keep=[F.col("id").alias("doc_id")]).select("doc_id", "targets")


# One well-formed and two malformed templates (no separator / two separators).
MALFORMED_PROMPTS = [
    ("ok", "{{ text }} ||| {{ subset }}", None, True),
    ("one_part", "{{ text }} and {{ subset }}", None, True),
    ("three_parts", "{{ text }} ||| {{ subset }} ||| {{ dataset }}", None, True),
]


@register(
    "malformed_drop",
    f"""SELECT {TASK('dataset', 'subset', "'ok'")} AS task, id, {STRIP('text')} AS inputs,
               COALESCE(NULLIF({STRIP('subset')}, ''), '<NO LABEL>') AS targets
        FROM ({CORPUS_SQL}) c WHERE length({STRIP('text')}) > 0""",
)
def q_malformed_drop(spark, sf_dir):
    data = corpus(spark, sf_dir)
    tpl = corpus_templates(data, MALFORMED_PROMPTS)
    r = render_templates(attach_templates(data, tpl), FIELDS, keep=["task", "id"])
    return nonempty_pairs(r).select("task", "id", "inputs", "targets")


@register(
    "nonempty_pairs",
    f"""SELECT u.conv_id, u.turn, u.text AS inputs, a.text AS targets
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 0 AND length(a.text) > 0""",
)
def q_nonempty_pairs(spark, sf_dir):
    from ..operators.dialogue import dialogue_pairs

    return nonempty_pairs(dialogue_pairs(read(spark, sf_dir, "conversations")))


# A template whose answer choices reference row fields.
CHOICE_PROMPTS = [
    ("pick", "Is this text from {{ dataset }} or {{ subset }}? ||| {{ answer_choices[quality] }}", "{{ dataset }} ||| {{ subset }}", True),
]


@register(
    "answer_choices",
    f"""SELECT {TASK('dataset', 'subset', "'pick'")} AS task, id,
               'Is this text from ' || dataset || ' or ' || subset || '?' AS inputs,
               COALESCE(CASE quality WHEN 0 THEN dataset WHEN 1 THEN subset END, '<NO LABEL>') AS targets,
               dataset || '|' || subset AS choices
        FROM ({LABELLED_SQL}) c""",
)
def q_answer_choices(spark, sf_dir):
    return _render_all(spark, sf_dir, CHOICE_PROMPTS)


@register("lm_text", "SELECT doc_id, lang, text FROM documents WHERE length(text) > 0")
def q_lm_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.where(F.length("text") > 0).select("doc_id", "lang", "text")


@register(
    "rekey_lm",
    "SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS inputs, text AS targets FROM documents WHERE length(text) > 0",
)
def q_rekey_lm(spark, sf_dir):
    from ..operators.lm import rekey_lm

    return rekey_lm(read(spark, sf_dir, "documents").where(F.length("text") > 0), keep=["doc_id", "lang"])


@register(
    "source_prefix",
    """SELECT u.conv_id, u.turn, 'answer: ' || u.text AS inputs, a.text AS targets
       FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 0 AND length(a.text) > 0""",
)
def q_source_prefix(spark, sf_dir):
    from ..operators.dialogue import dialogue_pairs

    p = nonempty_pairs(dialogue_pairs(read(spark, sf_dir, "conversations")))
    return p.withColumn("inputs", F.concat(F.lit("answer: "), "inputs"))


# Three rounds, each with its own physical split names.
ROUND_SEED = "round"


@register(
    "rounds_as_subsets",
    f"""WITH c AS (SELECT *, 'r' || CAST(1 + floor({U("'round'", 'id')} * 3) AS BIGINT) AS rnd FROM ({CORPUS_SQL}) x),
             p AS (SELECT *, CASE split WHEN 'train' THEN 'train' WHEN 'validation' THEN 'dev' ELSE 'test' END || '_' || rnd AS physical FROM c)
        SELECT {CLEAN("dataset || '_' || 'quality'")} || '_' || rnd AS task,
               CASE WHEN starts_with(physical, 'train_') THEN 'train' WHEN starts_with(physical, 'dev_') THEN 'validation' ELSE 'test' END AS split,
               physical, id
        FROM p""",
)
def q_rounds_as_subsets(spark, sf_dir):
    from ..operators.rounds import round_split_tasks

    c = corpus(spark, sf_dir)
    return round_split_tasks(c, "quality", rounds=3)


# ------------------------------------------------------------------------------------------
# caps and seeded order


def _caps_sql(rule: str, max_examples: int) -> str:
    if rule == "a":
        cap = f"CASE WHEN n.n IS NULL THEN {max_examples} WHEN n.n > {max_examples} THEN {max_examples} // t.num_templates ELSE n.n END"
    else:
        cap = f"CASE WHEN COALESCE(n.n, 0) * t.num_templates > {max_examples} THEN {max_examples} // t.num_templates ELSE COALESCE(n.n, 0) END"
    return f"""WITH c AS ({CORPUS_SQL}),
      k AS (SELECT DISTINCT dataset, subset FROM c),
      t AS (SELECT dataset, subset, 5 AS num_templates FROM k),
      n AS (SELECT dataset, subset, count(*) AS n FROM c WHERE split = 'train' GROUP BY dataset, subset)
    SELECT t.dataset, t.subset, CAST(t.num_templates AS BIGINT) AS num_templates, CAST(COALESCE(n.n, 0) AS BIGINT) AS n,
           CAST({cap} AS BIGINT) AS cap
    FROM t LEFT JOIN n USING (dataset, subset)"""


def _caps(spark, sf_dir, rule, max_examples):
    from .prompts import task_caps

    data = corpus(spark, sf_dir)
    tpl = corpus_templates(data, CORPUS_PROMPTS_WIDE)
    return task_caps(data, tpl, rule, max_examples)


@register("cap_rule_a", _caps_sql("a", MAX_EXAMPLES))
def q_cap_rule_a(spark, sf_dir):
    return _caps(spark, sf_dir, "a", MAX_EXAMPLES)


@register("cap_rule_b", _caps_sql("b", MAX_EXAMPLES))
def q_cap_rule_b(spark, sf_dir):
    return _caps(spark, sf_dir, "b", MAX_EXAMPLES)


# lineitem as a large row source: 4 groups, one of them about half of all rows.
def _lineitem_keyed(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("grp"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        "l_quantity",
    )


@register(
    "shuffle_cap",
    f"""WITH l AS (SELECT l_returnflag || l_linestatus AS grp, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, l_quantity FROM lineitem),
             r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {U("'42'", 'id')}, id) AS rn FROM l)
        SELECT grp, id, l_quantity, CAST(rn AS BIGINT) AS rn FROM r WHERE rn <= {MAX_EXAMPLES}""",
)
def q_shuffle_cap(spark, sf_dir):
    li = _lineitem_keyed(spark, sf_dir).withColumn("cap", F.lit(MAX_EXAMPLES))
    return seeded_cap(li, "grp", 42, "id", "cap", keep_rank=True).select("grp", "id", "l_quantity", "rn")


# Fixed value: rows of the evaluation hold-out.
HOLD_OUT = 1000


@register(
    "take_n",
    f"""WITH c AS (SELECT * FROM ({CORPUS_SQL}) x WHERE split = 'train'),
             r AS (SELECT id, row_number() OVER (ORDER BY {U("'42'", 'id')}, id) AS rn FROM c)
        SELECT id, CAST(rn AS BIGINT) AS rn FROM r WHERE rn <= {HOLD_OUT}""",
)
def q_take_n(spark, sf_dir):
    c = corpus(spark, sf_dir).where(F.col("split") == "train").withColumn("one", F.lit(1)).withColumn("cap", F.lit(HOLD_OUT))
    return seeded_cap(c, "one", 42, "id", "cap", keep_rank=True).select("id", "rn")


_HOLD_SQL = f"""WITH r AS (SELECT id, row_number() OVER (ORDER BY {U("'42'", 'id')}, id) AS rn FROM ({CORPUS_SQL}) c)"""


@register("holdout_take", _HOLD_SQL + f" SELECT id FROM r WHERE rn <= {HOLD_OUT}")
def q_holdout_take(spark, sf_dir):
    return take_skip(corpus(spark, sf_dir).select("id"), 42, "id", HOLD_OUT, "take").select("id")


@register("holdout_skip", _HOLD_SQL + f" SELECT id FROM r WHERE rn > {HOLD_OUT}")
def q_holdout_skip(spark, sf_dir):
    return take_skip(corpus(spark, sf_dir).select("id"), 42, "id", HOLD_OUT, "skip").select("id")


@register(
    "batch_ids",
    f"""WITH r AS (SELECT id, row_number() OVER (ORDER BY {U("'7'", 'id')}, id) AS rn FROM ({CORPUS_SQL}) c)
        SELECT id, CAST(rn AS BIGINT) AS rn, CAST((rn - 1) // 32 AS BIGINT) AS batch FROM r""",
)
def q_batch_ids(spark, sf_dir):
    return batch_ids(corpus(spark, sf_dir).select("id"), 7, "id", 32).select("id", "rn", "batch")
