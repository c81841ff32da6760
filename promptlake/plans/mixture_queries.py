"""Registered queries: tasks, mixtures, rates, blacklist, interleave and translation corpora (M*, J2-J4, U*, W1, A2-A4, A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_u52_sql
from ..functions.text import task_name
from ..operators.catalog import cap_merge, exclusive_cumsum, weighted_train_size
from ..operators.interleave import WEIGHT_SCALE, draw_from_mixture, index_sources, interleave, round_robin, source_sizes
from ..operators.mixtures import (
    cap_rates,
    define_mixtures,
    overlong_tasks,
    power_rates,
    remove_blacklisted,
    select_members,
    temperature_rates,
)
from ..operators.parallel import id_pairs, mt_bidirectional, mt_prompt, mt_unpack, split_pair, zip_pairs
from ..operators.ranking import broadcast_checked
from ..operators.templates import attach_templates, input_lengths, nonempty_pairs
from ..session import cut_lineage
from ..sources.tables import corpus, read
from .prompts import CORPUS_PROMPTS_WIDE, corpus_templates, task_caps
from .registry import register
from .sqlparts import CORPUS_SQL, STRIP, TASK, U

# The corpus prompts' kinds and languages, which make the categories (template, subset,
# category), and the mixtures as unions of categories (mixture, category).
LANGUAGES = ["en", "de", "fr", "es"]
KINDS = ["quality_estimation", "toxicity", "language_identification"]
TEMPLATE_KINDS = [("quality", KINDS[0]), ("toxic", KINDS[1]), ("language", KINDS[2]), ("quality-translate-de", KINDS[0])]
CATEGORIES = [(t, lang, f"{kind}_{lang}") for t, kind in TEMPLATE_KINDS for lang in LANGUAGES]
CATEGORIES += [("source", lang, "source_attribution") for lang in LANGUAGES]


def _of(kinds, langs=LANGUAGES) -> list[str]:
    return [f"{k}_{lang}" for k in kinds for lang in langs]


MIXTURE_CATEGORIES = {
    "stage1_train": _of(KINDS[:2]),
    "stage2_train": _of(KINDS[2:]),
    "stage3_train": ["source_attribution"],
    "stage12_train": _of(KINDS),
    "stage123_train": [*_of(KINDS), "source_attribution"],
    "quality_train": _of(KINDS[:1]),
    "toxicity_train": _of(KINDS[1:2]),
    "multilingual_train": _of(KINDS, LANGUAGES[1:]),
    **{f"{lang}_train": _of(KINDS, [lang]) for lang in LANGUAGES},
    **{f"en_plus_{lang}_train": _of(KINDS, ["en", lang]) for lang in LANGUAGES[1:]},
}
MIXTURES = [(m, c) for m, cs in MIXTURE_CATEGORIES.items() for c in cs]
TASK_MAX = 500_000  # rows per dataset in the cap rule
OVERLONG_TOKENS = 2048
OVERLONG_SHARE = 0.5

# the text of each prompt's input around the document text, for the length audit
_INPUT_EXTRA = {
    "quality": "\nIs this text well written? ",
    "toxic": "\nIs this text toxic? ",
    "language": "Which language is this text written in?\n ",
    "source": "\nWhere does this text come from? ",
    "quality-translate-de": "\nIst dieser Text gut geschrieben? ",
}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def task_table(spark, sf_dir):
    data = corpus(spark, sf_dir)
    tpl = corpus_templates(data, CORPUS_PROMPTS_WIDE)
    caps = task_caps(data, tpl, "a", TASK_MAX)
    cat = spark.createDataFrame(CATEGORIES, "template string, subset string, category string")
    t = tpl.join(caps, ["dataset", "subset"]).select(
        task_name("dataset", "subset", "name").alias("task"),
        F.col("name").alias("template"),
        "dataset",
        "subset",
        "n",
        "cap",
    )
    return cut_lineage(t.join(cat, ["template", "subset"]).select("task", "template", "dataset", "subset", "n", "cap", "category"), "task_table")


_TASKS_SQL = f"""
  c AS ({CORPUS_SQL}),
  k AS (SELECT DISTINCT dataset, subset FROM c),
  nn AS (SELECT dataset, subset, count(*) AS n FROM c WHERE split = 'train' GROUP BY dataset, subset),
  p AS (SELECT * FROM (VALUES {_values(CATEGORIES)}) v(template, subset, category)),
  tasks AS (
    SELECT {TASK('k.dataset', 'k.subset', 'p.template')} AS task, p.template, k.dataset, k.subset,
           CAST(COALESCE(nn.n, 0) AS BIGINT) AS n,
           CAST(CASE WHEN nn.n IS NULL THEN {TASK_MAX} WHEN nn.n > {TASK_MAX} THEN {TASK_MAX} // 5 ELSE nn.n END AS BIGINT) AS cap,
           p.category
    FROM k JOIN p ON p.subset = k.subset LEFT JOIN nn ON nn.dataset = k.dataset AND nn.subset = k.subset),
  defs AS (SELECT * FROM (VALUES {_values(MIXTURES)}) v(mixture, category)),
  extra AS (SELECT * FROM (VALUES {_values([(t, len(x.encode())) for t, x in _INPUT_EXTRA.items()])}) v(template, bytes)),
  rendered AS (SELECT {TASK('dataset', 'subset', 'template')} AS task, strlen(text) + bytes AS length FROM c CROSS JOIN extra),
  overlong AS (
    SELECT task, avg(CASE WHEN length > {OVERLONG_TOKENS} THEN 1.0 ELSE 0.0 END) AS overlong_share, count(*) AS rows
    FROM rendered GROUP BY task HAVING avg(CASE WHEN length > {OVERLONG_TOKENS} THEN 1.0 ELSE 0.0 END) > {OVERLONG_SHARE}),
  members AS (
    SELECT DISTINCT d.mixture, t.task FROM tasks t JOIN defs d ON d.category = t.category
    WHERE t.task NOT IN (SELECT task FROM overlong))
"""


def _blacklist(spark, sf_dir):
    """Overlong tasks from lengths alone: no text is rendered or carried."""
    data = corpus(spark, sf_dir)
    tpl = corpus_templates(data, CORPUS_PROMPTS_WIDE)
    lengths = input_lengths(data, tpl, ["text", "dataset", "subset"], keep=["task"])
    return cut_lineage(overlong_tasks(lengths, F.col("length"), OVERLONG_TOKENS, OVERLONG_SHARE), "blacklist")


def _members(spark, sf_dir):
    tasks = task_table(spark, sf_dir)
    defs = spark.createDataFrame(MIXTURES, "mixture string, category string")
    members = define_mixtures(tasks.select("task", "category"), defs)
    return cut_lineage(remove_blacklisted(members, _blacklist(spark, sf_dir)), "members"), tasks


@register(
    "overlong_tasks",
    f"WITH {_TASKS_SQL} SELECT task, round(overlong_share, 6) AS overlong_share, rows FROM overlong",
)
def q_overlong_tasks(spark, sf_dir):
    return _blacklist(spark, sf_dir).select("task", F.round("overlong_share", 6).alias("overlong_share"), "rows")


@register("blacklist_anti", f"WITH {_TASKS_SQL} SELECT task, category FROM tasks WHERE task NOT IN (SELECT task FROM overlong)")
def q_blacklist_anti(spark, sf_dir):
    tasks = task_table(spark, sf_dir)
    return remove_blacklisted(tasks, _blacklist(spark, sf_dir)).select("task", "category")


@register("mixture_members", f"WITH {_TASKS_SQL} SELECT mixture, task FROM members")
def q_mixture_members(spark, sf_dir):
    members, _ = _members(spark, sf_dir)
    return members


@register(
    "mixture_rates",
    f"""WITH {_TASKS_SQL}
        SELECT m.mixture, m.task, t.cap, round(CAST(t.cap AS DOUBLE) / sum(t.cap) OVER (PARTITION BY m.mixture), 9) AS rate
        FROM members m JOIN tasks t ON t.task = m.task""",
)
def q_mixture_rates(spark, sf_dir):
    members, tasks = _members(spark, sf_dir)
    r = cap_rates(members, tasks)
    return r.select("mixture", "task", "cap", F.round("rate", 9).alias("rate"))


@register(
    "mixture_select",
    f"""WITH {_TASKS_SQL}
        SELECT task, template, n FROM tasks WHERE task IN (SELECT task FROM members WHERE mixture = 'stage12_train')""",
)
def q_mixture_select(spark, sf_dir):
    members, tasks = _members(spark, sf_dir)
    return select_members(tasks, members, "stage12_train").select("task", "template", "n")


@register(
    "temperature_rates",
    f"""WITH {_TASKS_SQL}
        SELECT m.task, t.n, round(pow(t.n, 0.3) / sum(pow(t.n, 0.3)) OVER (), 9) AS rate
        FROM members m JOIN tasks t ON t.task = m.task WHERE m.mixture = 'stage123_train'""",
)
def q_temperature_rates(spark, sf_dir):
    members, tasks = _members(spark, sf_dir)
    m = select_members(tasks, members, "stage123_train")
    return temperature_rates(m, "n").select("task", "n", F.round("rate", 9).alias("rate"))


@register(
    "temperature_rates_power",
    f"""WITH {_TASKS_SQL}
        SELECT m.task, t.cap, round(pow(t.cap, 1.0 / 0.3) / sum(pow(t.cap, 1.0 / 0.3)) OVER (), 9) AS rate
        FROM members m JOIN tasks t ON t.task = m.task WHERE m.mixture = 'stage123_train'""",
)
def q_temperature_rates_power(spark, sf_dir):
    members, tasks = _members(spark, sf_dir)
    m = select_members(tasks, members, "stage123_train")
    return power_rates(m, "cap").select("task", "cap", F.round("rate", 9).alias("rate"))


@register(
    "cap_merge",
    f"""WITH {_TASKS_SQL},
        regs AS (SELECT task, cap, 0 AS seq FROM tasks
                 UNION ALL SELECT task, n * 2 AS cap, 1 AS seq FROM tasks WHERE template = 'quality')
        SELECT task, CAST(arg_max(cap, seq) AS BIGINT) AS cap, max(seq) AS seq FROM regs GROUP BY task""",
)
def q_cap_merge(spark, sf_dir):
    tasks = task_table(spark, sf_dir)
    regs = tasks.select("task", "cap", F.lit(0).alias("seq")).unionByName(
        tasks.where(F.col("template") == "quality").select("task", (F.col("n") * 2).alias("cap"), F.lit(1).alias("seq"))
    )
    return cap_merge(regs)


# ------------------------------------------------------------------------------------------
# languages and LM suites


_LANG_SQL = """SELECT lang, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY lang"""


def _lang_sizes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register(
    "language_rates",
    f"""WITH s AS ({_LANG_SQL})
        SELECT lang, n, round(pow(n, 0.3) / sum(pow(n, 0.3)) OVER (), 9) AS rate, CAST(1.0 AS DOUBLE) AS total FROM s""",
)
def q_language_rates(spark, sf_dir):
    from pyspark.sql import Window

    r = temperature_rates(_lang_sizes(spark, sf_dir), "n")
    return r.select(
        "lang", "n", F.round("rate", 9).alias("rate"), F.round(F.sum("rate").over(Window.partitionBy()), 6).alias("total")
    )


@register(
    "lm_suite",
    f"""WITH s AS ({_LANG_SQL})
        SELECT 'mc4_' || lang AS task, lang, n, round(pow(n, 0.3) / sum(pow(n, 0.3)) OVER (), 9) AS rate FROM s""",
)
def q_lm_suite(spark, sf_dir):
    r = temperature_rates(_lang_sizes(spark, sf_dir), "n")
    return r.select(F.concat(F.lit("mc4_"), "lang").alias("task"), "lang", "n", F.round("rate", 9).alias("rate"))


@register(
    "lm_no_english",
    f"""WITH s AS ({_LANG_SQL} HAVING lang <> 'en')
        SELECT 'mc4_' || lang AS task, lang, n, round(pow(n, 0.3) / sum(pow(n, 0.3)) OVER (), 9) AS rate FROM s""",
)
def q_lm_no_english(spark, sf_dir):
    s = _lang_sizes(spark, sf_dir).where(F.col("lang") != "en")
    r = temperature_rates(s, "n")
    return r.select(F.concat(F.lit("mc4_"), "lang").alias("task"), "lang", "n", F.round("rate", 9).alias("rate"))


@register(
    "token_budget",
    """SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS tokens, count(*) AS docs,
              CAST(100000 AS BIGINT) * 2048 * 512 AS budget FROM documents GROUP BY lang""",
)
def q_token_budget(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        F.sum(F.octet_length("text") + 1).cast("long").alias("tokens"),
        F.count(F.lit(1)).alias("docs"),
        (F.lit(100000).cast("long") * 2048 * 512).alias("budget"),
    )


# ------------------------------------------------------------------------------------------
# interleave over the per-language document sources

_SRC_SQL = """src AS (SELECT lang AS source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents),
  ns AS (SELECT source, count(*) AS n FROM src GROUP BY source)"""


def _indexed_docs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("source"), "doc_id")
    return index_sources(d, "source", "doc_id")


@register(
    "source_offsets",
    f"""WITH {_SRC_SQL}
        SELECT source, n, CAST(COALESCE(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
        FROM ns""",
)
def q_source_offsets(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    ns = d.groupBy(F.col("lang").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return exclusive_cumsum(ns, "n", ["source"])


@register(
    "interleave_round_robin",
    f"""WITH {_SRC_SQL}, m AS (SELECT min(n) AS m, count(*) AS s FROM ns),
        o AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS ord FROM ns)
        SELECT src.source, src.doc_id, src.idx, CAST(src.idx * m.s + o.ord AS BIGINT) AS pos
        FROM src JOIN o USING (source) CROSS JOIN m WHERE src.idx < m.m""",
)
def q_interleave_round_robin(spark, sf_dir):
    return round_robin(_indexed_docs(spark, sf_dir), "source").select("source", "doc_id", "idx", "pos")


def _draw_sql(rate: str, n_draws: str, sizes: str = "ns") -> str:
    """CTEs c2 (source, n, lo, hi) and drawn (pos, source, n, k) of ``n_draws`` draws by ``rate`` over (source, n) rows."""
    return f"""rt AS (SELECT source, n, CAST({rate} AS DOUBLE) AS rate FROM {sizes}),
      w AS (SELECT source, n, greatest(CAST(floor(rate / (SELECT sum(rate) FROM rt) * {WEIGHT_SCALE}.0) AS BIGINT), 1) AS w FROM rt),
      cw AS (SELECT source, n, CAST(sum(w) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi, w FROM w),
      c2 AS (SELECT source, n, hi - w AS lo, hi FROM cw),
      tot AS (SELECT CAST(sum(w) AS DOUBLE) AS W, sum(n) AS rows FROM w),
      d AS (SELECT range AS pos, floor({hash_u52_sql("'42'", 'range')} * (SELECT W FROM tot)) AS r FROM range(0, CAST({n_draws} AS BIGINT))),
      hit AS (SELECT d.pos, c2.source, c2.n FROM d JOIN c2 ON d.r >= c2.lo AND d.r < c2.hi),
      drawn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS k FROM hit)"""


# draws that surely reach the stopping point, from the sizes and weights
_ENOUGH = "(SELECT max(2 * (n + 1) * tot.W / w.w + 1000) FROM w, tot)"


def _interleave_sql(stop: str) -> str:
    agg = "min" if stop == "first_exhausted" else "max"
    return f"""WITH {_SRC_SQL},
      {_draw_sql('pow(n, 0.3)', _ENOUGH)},
      cut AS (SELECT {agg}(e) AS cut FROM (SELECT source, min(pos) AS e FROM drawn WHERE k = n + 1 GROUP BY source))
    SELECT k.pos, k.source, src.doc_id, src.idx
    FROM drawn k JOIN src ON src.source = k.source AND src.idx = (k.k - 1) % k.n
    WHERE k.pos < (SELECT cut FROM cut)"""


def _power_rates_of(sizes):
    return sizes.select("source", F.pow(F.col("n").cast("double"), F.lit(0.3)).alias("rate"))


def _interleave(spark, sf_dir, stop):
    ids = read(spark, sf_dir, "documents").select(F.col("lang").alias("source"), "doc_id")
    sizes = source_sizes(ids, "source")
    return interleave(index_sources(ids, "source", "doc_id"), "source", _power_rates_of(sizes), 42, stop, sizes=sizes).select("pos", "source", "doc_id", "idx")


@register("interleave_first_exhausted", _interleave_sql("first_exhausted"))
def q_interleave_first_exhausted(spark, sf_dir):
    return _interleave(spark, sf_dir, "first_exhausted")


@register("interleave_all_exhausted", _interleave_sql("all_exhausted"))
def q_interleave_all_exhausted(spark, sf_dir):
    return _interleave(spark, sf_dir, "all_exhausted")


# ------------------------------------------------------------------------------------------
# translation pairs

# Language pairs built from the corpus (k-th document of a with k-th of b).
PAIRS = [("de-en", "de", "en"), ("en-es", "en", "es"), ("en-fr", "en", "fr")]

_PAIRS_SQL = f"""ix AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents),
  pr AS (SELECT * FROM (VALUES {_values(PAIRS)}) v(pair, a, b)),
  tp AS (SELECT pr.pair, x.idx, pr.a, pr.b, x.text AS text_a, y.text AS text_b
         FROM pr JOIN ix x ON x.lang = pr.a JOIN ix y ON y.lang = pr.b AND y.idx = x.idx)"""


def _pairs(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    pairs = spark.createDataFrame(PAIRS, "pair string, a string, b string")
    return zip_pairs(d, pairs)


@register("mt_unpack", f"WITH {_PAIRS_SQL} SELECT pair, idx, a AS src, b AS tgt, text_a AS input, text_b AS target FROM tp")
def q_mt_unpack(spark, sf_dir):
    return mt_unpack(_pairs(spark, sf_dir)).select("pair", "idx", "src", "tgt", "input", "target")


@register(
    "mt_prompt",
    f"""WITH {_PAIRS_SQL} SELECT pair, idx, 'Translate from ' || a || ' to ' || b || ': ' || text_a AS inputs, text_b AS targets
        FROM tp WHERE length('Translate from ' || a || ' to ' || b || ': ' || text_a) > 0 AND length(text_b) > 0""",
)
def q_mt_prompt(spark, sf_dir):
    return nonempty_pairs(mt_prompt(mt_unpack(_pairs(spark, sf_dir)))).select("pair", "idx", "inputs", "targets")


@register(
    "mt_bidirectional",
    f"""WITH {_PAIRS_SQL},
        d AS (SELECT pair, idx, a AS src, b AS tgt, text_a AS s_text, text_b AS t_text FROM tp
              UNION ALL SELECT pair, idx, b, a, text_b, text_a FROM tp)
        SELECT 'flores_' || src || '_' || tgt || '_mt' AS task, idx, 'Translate to ' || tgt || ': ' || s_text AS inputs, t_text AS targets
        FROM d WHERE length(t_text) > 0""",
)
def q_mt_bidirectional(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    a, b = split_pair("pair")
    return nonempty_pairs(mt_bidirectional(p, a, b)).select("task", "idx", "inputs", "targets")


@register(
    "weighted_train_size",
    f"""WITH {_PAIRS_SQL}, n AS (SELECT pair, count(*) AS n FROM tp GROUP BY pair),
        r AS (SELECT pair, n, pow(n, 0.3) / sum(pow(n, 0.3)) OVER () AS rate FROM n)
        SELECT CAST(sum(floor(n * rate)) AS BIGINT) AS train_size FROM r""",
)
def q_weighted_train_size(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    sizes = p.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    rates = temperature_rates(sizes, "n").select("pair", "rate")
    return weighted_train_size(sizes, rates)


def _mt_corpus_sql() -> str:
    return f"""WITH {_PAIRS_SQL},
      ns AS (SELECT pair AS source, count(*) AS n FROM tp GROUP BY pair),
      {_draw_sql('pow(n, 0.3)', _ENOUGH)},
      cut AS (SELECT max(e) AS cut FROM (SELECT source, min(pos) AS e FROM drawn WHERE k = n + 1 GROUP BY source))
    SELECT k.pos, tp.pair, 'Translate from ' || tp.a || ' to ' || tp.b || ': ' || tp.text_a AS inputs, tp.text_b AS targets
    FROM drawn k JOIN tp ON tp.pair = k.source AND tp.idx = (k.k - 1) % k.n
    WHERE k.pos < (SELECT cut FROM cut) AND length(tp.text_b) > 0"""


@register("mt_corpus", _mt_corpus_sql())
def q_mt_corpus(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    pairs = spark.createDataFrame(PAIRS, "pair string, a string, b string")
    ids = cut_lineage(id_pairs(docs, pairs).withColumnRenamed("pair", "source"), "pair_ids")
    sizes = source_sizes(ids, "source")
    mixed = interleave(ids, "source", _power_rates_of(sizes), 42, "all_exhausted", sizes=sizes)
    texts = docs.select("doc_id", "text")
    mixed = mixed.join(texts.select(F.col("doc_id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
    mixed = mixed.join(texts.select(F.col("doc_id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    mixed = mixed.withColumn("translation", F.create_map("a", "text_a", "b", "text_b"))
    out = nonempty_pairs(mt_prompt(mt_unpack(mixed)))
    return out.select("pos", F.col("source").alias("pair"), "inputs", "targets")


@register(
    "mixture_sample",
    f"""WITH {_TASKS_SQL},
      mr AS (SELECT m.task AS source, t.cap FROM members m JOIN tasks t ON t.task = m.task WHERE m.mixture = 'stage1_train'),
      rows_ AS (SELECT {TASK('dataset', 'subset', "'quality'")} AS source, id FROM c WHERE split = 'train'
                UNION ALL SELECT {TASK('dataset', 'subset', "'toxic'")}, id FROM c WHERE split = 'train'),
      src AS (SELECT r.source, r.id, row_number() OVER (PARTITION BY r.source ORDER BY r.id) - 1 AS idx
              FROM rows_ r WHERE r.source IN (SELECT source FROM mr)),
      ns AS (SELECT s.source, s.n, mr.cap FROM (SELECT source, count(*) AS n FROM src GROUP BY source) s JOIN mr USING (source)),
      {_draw_sql('cap', '(SELECT rows FROM tot)')}
    SELECT k.pos, k.source AS task, src.id FROM drawn k JOIN src ON src.source = k.source AND src.idx = (k.k - 1) % k.n""",
)
def q_mixture_sample(spark, sf_dir):
    """One draw per row of the mixture's tasks, by the tasks' caps."""
    members, tasks = _members(spark, sf_dir)
    mr = cut_lineage(select_members(tasks, members, "stage1_train").select(F.col("task").alias("source"), F.col("cap").cast("double").alias("rate")), "mixture_rates")
    data = corpus(spark, sf_dir).where(F.col("split") == "train").select("dataset", "subset", "id")
    tpl = corpus_templates(data, CORPUS_PROMPTS_WIDE[:2])
    rows = attach_templates(data, tpl).select(F.col("task").alias("source"), "id").join(broadcast_checked(mr.select("source"), "sources"), "source", "left_semi")
    sizes = source_sizes(rows, "source")
    n_rows = sizes.agg(F.sum("n")).first()[0] or 0
    rates = mr.join(sizes.select("source"), "source", "left_semi")
    return draw_from_mixture(index_sources(rows, "source", "id"), "source", rates, n_rows, 42, sizes=sizes).select("pos", F.col("source").alias("task"), "id")
