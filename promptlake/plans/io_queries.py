"""Registered queries: file sources and sinks, caches, catalog, auxiliary table jobs
(S5-S7, S9, S10, S13-S16, S18, S19, A5, A9, F10, F11, U1, M7, M15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_u
from ..functions.text import task_name
from ..operators.interleave import index_sources
from ..operators.mixtures import equal_rates
from ..operators.templates import nonempty_pairs, template_rejects
from ..session import cut_lineage, scratch_path
from ..sources import cache as C
from ..sources import files as FS
from ..sources.tables import corpus, read
from .metric_queries import _PRED_SQL, dialogue_predictions
from .prompt_queries import _FLAG_SQL, COPA_TEMPLATE, MALFORMED_PROMPTS, NLI_TEMPLATES, _wide_sql
from .prompts import CORPUS_PROMPTS_WIDE, corpus_templates, flagship, flagship_tasks
from .registry import register
from .sqlparts import CORPUS_SQL, LABELLED_SQL, STRIP, TASK, U

# ------------------------------------------------------------------------------------------
# crawl JSON lines


def _crawl_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(
        "text",
        F.concat(F.lit("2024-01-"), F.lpad((F.pmod("doc_id", F.lit(28)) + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("timestamp"),
        F.concat(F.lit("https://example.com/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
    )


@register(
    "crawl_json_scan",
    """SELECT text, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS timestamp,
              'https://example.com/' || source || '/' || CAST(doc_id AS VARCHAR) AS url,
              '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS day FROM documents""",
)
def q_crawl_json_scan(spark, sf_dir):
    path = scratch_path(spark, "crawl")
    FS.write_crawl_json(_crawl_rows(spark, sf_dir), path)
    return FS.read_crawl_json(spark, path).select("text", "timestamp", "url", F.date_format("ts", "yyyy-MM-dd").alias("day"))


# ------------------------------------------------------------------------------------------
# shard manifest and fractional plan (shard counts derived from the corpus: 8 docs per shard)

DOCS_PER_SHARD = 8


def _shards(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.groupBy(F.col("subset").alias("lang")).agg(
        F.ceil(F.sum(F.when(F.col("split") == "train", 1).otherwise(0)) / DOCS_PER_SHARD).cast("long").alias("train"),
        F.ceil(F.sum(F.when(F.col("split") == "validation", 1).otherwise(0)) / DOCS_PER_SHARD).cast("long").alias("validation"),
    )


_SHARDS_SQL = f"""sh AS (SELECT subset AS lang,
        CAST(ceil(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) / {DOCS_PER_SHARD}.0) AS BIGINT) AS train,
        CAST(ceil(sum(CASE WHEN split = 'validation' THEN 1 ELSE 0 END) / {DOCS_PER_SHARD}.0) AS BIGINT) AS validation
      FROM ({CORPUS_SQL}) c GROUP BY subset),
  lg AS (SELECT lang, 'train' AS split, train AS n FROM sh UNION ALL SELECT lang, 'validation', validation FROM sh),
  man AS (SELECT lang, split, n, CAST(unnest(range(n)) AS BIGINT) AS idx FROM lg WHERE n > 0)"""


@register(
    "shard_manifest",
    f"""WITH {_SHARDS_SQL}
        SELECT lang, split, n, idx, printf('c4-%s%s.tfrecord-%05d-of-%05d.json.gz', lang, CASE WHEN split = 'validation' THEN '-validation' ELSE '' END, idx, n) AS file
        FROM man""",
)
def q_shard_manifest(spark, sf_dir):
    return FS.shard_manifest(_shards(spark, sf_dir)).select("lang", "split", "n", "idx", "file")


@register(
    "fractional_shards",
    f"""WITH {_SHARDS_SQL},
        fr AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b})" for a, b in FS.DOWNLOAD_FRACTION)}) v(lang, fraction)),
        k AS (SELECT m.*, CASE WHEN fr.fraction IS NULL THEN m.n ELSE least(m.n, CAST(floor(m.n * fr.fraction) AS BIGINT) + 1) END AS k
              FROM man m LEFT JOIN fr USING (lang) WHERE m.split = 'train')
        SELECT lang, n, idx, k FROM k WHERE idx < k""",
)
def q_fractional_shards(spark, sf_dir):
    fr = spark.createDataFrame(FS.DOWNLOAD_FRACTION, "lang string, fraction double")
    return FS.fractional_plan(FS.shard_manifest(_shards(spark, sf_dir)), fr).select("lang", "n", "idx", "k")


@register(
    "fractional_read",
    f"""WITH {_SHARDS_SQL},
        fr AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b})" for a, b in FS.DOWNLOAD_FRACTION)}) v(lang, fraction)),
        k AS (SELECT m.lang, m.n, m.idx, CASE WHEN fr.fraction IS NULL THEN m.n ELSE least(m.n, CAST(floor(m.n * fr.fraction) AS BIGINT) + 1) END AS k
              FROM man m LEFT JOIN fr USING (lang) WHERE m.split = 'train'),
        d AS (SELECT subset AS lang, id, CAST(floor({U("'shard'", 'id')} * sh.train) AS BIGINT) AS idx
              FROM ({CORPUS_SQL}) c JOIN sh ON sh.lang = c.subset WHERE split = 'train')
        SELECT 'https://example.com/' || d.lang || '/' || CAST(id AS VARCHAR) AS url FROM d JOIN k ON k.lang = d.lang AND k.idx = d.idx WHERE k.idx < k.k""",
)
def q_fractional_read(spark, sf_dir):
    """Shards written as files named by the manifest; the reader opens only the planned ones."""
    shards = cut_lineage(_shards(spark, sf_dir), "shard_counts")
    manifest = cut_lineage(FS.shard_manifest(shards), "manifest")
    docs = corpus(spark, sf_dir).where(F.col("split") == "train").withColumnRenamed("subset", "lang")
    idx = F.floor(hash_u("shard", "id") * F.col("train")).cast("long")
    rows = docs.join(shards, "lang").select("lang", idx.alias("idx"), "text", F.concat(F.lit("https://example.com/"), "lang", F.lit("/"), F.col("id").cast("string")).alias("url"))
    named = rows.join(manifest.where(F.col("split") == "train"), ["lang", "idx"]).select("file", "text", F.lit("2024-01-01T00:00:00Z").alias("timestamp"), "url")
    folder = scratch_path(spark, "shards")
    written = FS.write_shards(named, folder)
    fr = spark.createDataFrame(FS.DOWNLOAD_FRACTION, "lang string, fraction double")
    plan = FS.fractional_plan(manifest, fr).join(written, "file", "left_semi")
    return FS.read_planned(spark, folder, plan).select("url")


# ------------------------------------------------------------------------------------------
# dataset catalog CSV


def _catalog_rows(spark, sf_dir):
    c = corpus(spark, sf_dir)
    g = c.groupBy("dataset", "subset").agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).cast("long").alias("n_train"),
        F.sum(F.when(F.col("split") == "validation", 1).otherwise(0)).cast("long").alias("n_val"),
    )
    return g.select(
        F.col("dataset").alias("HF_name"),
        F.when(F.col("subset") == "en", F.lit(None)).otherwise(F.col("subset")).alias("subset"),
        F.when(hash_u("cat", "dataset") < 0.5, F.lit("classification")).otherwise(F.lit("generation")).alias("task_by_convention"),
        F.when(F.col("n_train") >= 20, F.lit("yes")).alias("do_train"),
        F.when(F.col("n_val") > 0, F.lit("yes")).alias("do_eval"),
        F.when(F.col("n_train") > 0, F.col("n_train")).alias("train_size"),
    )


_CATALOG_SQL = f"""g AS (SELECT dataset, subset, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS n_train,
                         sum(CASE WHEN split = 'validation' THEN 1 ELSE 0 END) AS n_val
                  FROM ({CORPUS_SQL}) c GROUP BY dataset, subset),
  cat AS (SELECT dataset AS HF_name, CASE WHEN subset = 'en' THEN NULL ELSE subset END AS subset,
                 CASE WHEN {U("'cat'", 'dataset')} < 0.5 THEN 'classification' ELSE 'generation' END AS task_by_convention,
                 CASE WHEN n_train >= 20 THEN 'yes' END AS do_train,
                 CASE WHEN n_val > 0 THEN 'yes' END AS do_eval,
                 CAST(CASE WHEN n_train > 0 THEN n_train END AS BIGINT) AS train_size FROM g)"""


def _catalog(spark, sf_dir):
    path = scratch_path(spark, "datasets_csv")
    _catalog_rows(spark, sf_dir).write.option("header", "true").csv(path)
    return FS.read_catalog(spark, path)


@register(
    "catalog_train",
    f"WITH {_CATALOG_SQL} SELECT HF_name, subset, task_by_convention, train_size FROM cat WHERE do_train IS NOT NULL",
)
def q_catalog_train(spark, sf_dir):
    return _catalog(spark, sf_dir).where(F.col("do_train").isNotNull()).select("HF_name", "subset", "task_by_convention", "train_size")


@register(
    "catalog_rollup",
    f"""WITH {_CATALOG_SQL}
        SELECT task_by_convention, do_train IS NOT NULL AS train_flag, count(*) AS datasets, CAST(sum(train_size) AS BIGINT) AS rows
        FROM cat GROUP BY ROLLUP (task_by_convention, do_train IS NOT NULL)""",
)
def q_catalog_rollup(spark, sf_dir):
    from ..operators.catalog import catalog_rollup

    return catalog_rollup(_catalog(spark, sf_dir))


# ------------------------------------------------------------------------------------------
# prompt lines, prediction lines, metric table


@register("prompt_lines", "SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def q_prompt_lines(spark, sf_dir):
    path = scratch_path(spark, "prompts_txt")
    read(spark, sf_dir, "documents").select(F.col("text").alias("value")).write.text(path)
    return FS.read_prompt_lines(spark, path)


@register("prediction_lines", f"WITH {_PRED_SQL} SELECT unnest(string_split({STRIP('prediction')}, chr(10))) AS value FROM pred")
def q_prediction_lines(spark, sf_dir):
    path = scratch_path(spark, "predictions_txt")
    FS.write_prediction_lines(dialogue_predictions(spark, sf_dir), path)
    return spark.read.text(path)


@register(
    "metrics_table",
    f"""WITH {_PRED_SQL}
        SELECT 'eval' AS split, 'eval_accuracy_' || task AS name,
               round(avg(CASE WHEN {STRIP('prediction')} = {STRIP('target')} THEN 1.0 ELSE 0.0 END) * 100, 6) AS value
        FROM pred GROUP BY task
        UNION ALL
        SELECT 'predict', 'predict_rows_' || task, CAST(count(*) AS DOUBLE) FROM pred GROUP BY task""",
)
def q_metrics_table(spark, sf_dir):
    from ..operators import metrics as M

    p = dialogue_predictions(spark, sf_dir)
    path = scratch_path(spark, "metrics")
    acc = M.accuracy(p).select(F.lit("eval").alias("split"), F.concat(F.lit("eval_accuracy_"), "task").alias("name"), F.round("accuracy", 6).alias("value"))
    FS.append_metrics(acc, path)
    rows = p.groupBy("task").agg(F.count(F.lit(1)).cast("double").alias("value"))
    FS.append_metrics(rows.select(F.lit("predict").alias("split"), F.concat(F.lit("predict_rows_"), "task").alias("name"), "value"), path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------------------------------
# caches


@register("cache_roundtrip", _FLAG_SQL)
def q_cache_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "task_cache")
    C.write_cache(flagship(spark, sf_dir, keep=("task", "template")), path, dynamic=False)
    mix_path = scratch_path(spark, "mixture_cache")
    C.read_cache(spark, path).write.mode("overwrite").parquet(mix_path)
    return spark.read.parquet(mix_path).select("task", "doc_id", "inputs", "targets")


@register("incremental_cache", _FLAG_SQL)
def q_incremental_cache(spark, sf_dir):
    path = scratch_path(spark, "task_cache_inc")
    tasks = flagship_tasks(spark, sf_dir)
    build = lambda missing: flagship(spark, sf_dir, only_tasks=missing, keep=("task", "template"))
    C.build_incremental(spark, tasks.where(F.col("template") == "quality").select("task"), build, path)
    out = C.build_incremental(spark, tasks.select("task"), build, path)
    return out.select("task", "doc_id", "inputs", "targets")


# The task list of the offline-caching query.
SELECTED_TASKS = ["src1_de_quality", "src1_en_quality", "src1_es_toxic", "src1_fr_toxic", "src2_en_quality_"]


@register("cache_selected", f"SELECT * FROM ({_FLAG_SQL}) f WHERE task IN ({', '.join(repr(t) for t in SELECTED_TASKS)})")
def q_cache_selected(spark, sf_dir):
    path = scratch_path(spark, "task_cache_sel")
    build = lambda names: flagship(spark, sf_dir, only_tasks=names, keep=("task", "template"))
    return C.cache_selected(build, spark, SELECTED_TASKS, path).select("task", "doc_id", "inputs", "targets")


# ------------------------------------------------------------------------------------------
# auxiliary table jobs


@register(
    "feature_lengths",
    f"""WITH c AS ({LABELLED_SQL}), r AS ({_wide_sql(['quality', 'toxic', 'language', 'source', 'quality-translate-de'])})
        SELECT {TASK('dataset', 'subset', 'template')} AS task, CAST(max(strlen(inputs)) AS INTEGER) AS max_inputs, CAST(max(strlen(targets)) + 1 AS INTEGER) AS max_targets
        FROM r GROUP BY ALL""",
)
def q_feature_lengths(spark, sf_dir):
    from ..operators.templates import attach_templates, render_templates
    from ..sources.tables import labelled_corpus
    from .prompts import FIELDS

    data = labelled_corpus(spark, sf_dir)
    r = render_templates(attach_templates(data, corpus_templates(data, CORPUS_PROMPTS_WIDE)), FIELDS, keep=["task"])
    return r.groupBy("task").agg(
        F.max(F.octet_length("inputs")).alias("max_inputs"), (F.max(F.octet_length("targets")) + 1).alias("max_targets")
    )


@register(
    "json_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_array_length(json_keys(props)) AS INTEGER) AS n_keys, CAST(to_json(map(['k'], [CAST(json_extract(props, '$.k') AS INTEGER)])) AS VARCHAR) AS props_json FROM events",
)
def q_json_props(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    return e.select("event_id", F.col("m")["k"].alias("k"), F.size("m").alias("n_keys"), F.to_json("m").alias("props_json"))


# A template with a field the rows do not have.
REJECT_PROMPTS = MALFORMED_PROMPTS + [("unknown", "{{ title }} ||| {{ subset }}", None, True)]


@register(
    "template_rejects",
    """WITH k AS (SELECT DISTINCT source AS dataset, lang AS subset FROM documents)
       SELECT dataset, subset, name, reason FROM k CROSS JOIN (VALUES ('one_part', 'separator count'), ('three_parts', 'separator count'),
                                                                    ('unknown', 'unknown field: title')) v(name, reason)""",
)
def q_template_rejects(spark, sf_dir):
    c = corpus(spark, sf_dir)
    tpl = corpus_templates(c, REJECT_PROMPTS, materialise=False)
    return template_rejects(tpl, c.columns)


@register(
    "concat_tasks",
    f"""WITH c AS ({LABELLED_SQL}), r AS ({_wide_sql(['quality'])})
        SELECT {TASK('dataset', 'subset', 'template')} AS task, id, inputs, targets, choices FROM r
        UNION ALL SELECT 'mc4_' || lang, doc_id, NULL, text, NULL FROM documents WHERE length(text) > 0""",
)
def q_concat_tasks(spark, sf_dir):
    from ..operators.templates import attach_templates, render_templates
    from ..sources.tables import labelled_corpus
    from .prompts import FIELDS

    data = labelled_corpus(spark, sf_dir)
    tpl = corpus_templates(data, CORPUS_PROMPTS_WIDE[:1])
    prompts = nonempty_pairs(render_templates(attach_templates(data, tpl), FIELDS, keep=["task", "id"]))
    prompts = prompts.select("task", "id", "inputs", "targets", F.array_join("answer_choices", "|").alias("choices"))
    lm = read(spark, sf_dir, "documents").where(F.length("text") > 0).select(
        F.concat(F.lit("mc4_"), "lang").alias("task"), F.col("doc_id").alias("id"), F.col("text").alias("targets")
    )
    return prompts.unionByName(lm, allowMissingColumns=True)


# ------------------------------------------------------------------------------------------
# per-language evaluation suites (NLI- and COPA-shaped prompts over consecutive documents of a language)


def _eval_rows(spark, sf_dir):
    """Documents of a language with the next two: ids are indexed and joined first, texts last."""
    d = read(spark, sf_dir, "documents")
    ix = cut_lineage(index_sources(d.select("lang", "doc_id"), "lang", "doc_id"), "language_index")
    nth = lambda k, c: ix.select("lang", (F.col("idx") - k).alias("idx"), F.col("doc_id").alias(c))
    ids = ix.join(nth(1, "id1"), ["lang", "idx"]).join(nth(2, "id2"), ["lang", "idx"], "left")
    text = lambda c, t: d.select(F.col("doc_id").alias(c), F.col("text").alias(t))
    lab = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic") - 1).alias("label"))
    rows = ids.join(lab, "doc_id", "left").join(text("doc_id", "premise"), "doc_id").join(text("id1", "hypothesis"), "id1").join(text("id2", "second"), "id2", "left")
    return rows.select("lang", "doc_id", "premise", "hypothesis", "second", "label")


def _suite(rows, template, name, mixture):
    r = template.apply(rows, keep=["lang", "doc_id"]).withColumn("task", task_name(F.lit(name), "lang", F.lit(template.name)))
    rates = equal_rates(rows.select(task_name(F.lit(name), "lang", F.lit(template.name)).alias("task")).distinct().withColumn("mixture", F.lit(mixture)))
    out = nonempty_pairs(r).join(rates.select("task", "rate"), "task")
    return out.select("task", "doc_id", "inputs", "targets", F.round("rate", 6).alias("rate"))


_EVAL_SQL = """ix AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents),
        r AS (SELECT a.lang, a.doc_id, a.text AS premise, b.text AS hypothesis, c.text AS second, l.quality + l.toxic - 1 AS label
              FROM ix a JOIN ix b ON b.lang = a.lang AND b.idx = a.idx + 1 LEFT JOIN ix c ON c.lang = a.lang AND c.idx = a.idx + 2
              LEFT JOIN labels l ON l.doc_id = a.doc_id)"""


@register(
    "eval_suite",
    f"""WITH {_EVAL_SQL}, t AS (SELECT DISTINCT lang FROM r)
        SELECT {TASK("'xnli'", 'r.lang', f"'{NLI_TEMPLATES[0].name}'")} AS task, r.doc_id,
               premise || ' Based on the previous passage, is it true that "' || hypothesis || '"? Yes, no, or maybe?' AS inputs,
               COALESCE(CASE label WHEN 0 THEN 'Yes' WHEN 1 THEN 'Maybe' WHEN 2 THEN 'No' END, '<NO LABEL>') AS targets,
               round(1.0 / (SELECT count(*) FROM t), 6) AS rate
        FROM r""",
)
def q_eval_suite(spark, sf_dir):
    return _suite(_eval_rows(spark, sf_dir), NLI_TEMPLATES[0], "xnli", "xnli_eval")


@register(
    "copa_suite",
    f"""WITH {_EVAL_SQL}, q AS (SELECT * FROM r WHERE second IS NOT NULL), t AS (SELECT DISTINCT lang FROM q)
        SELECT {TASK("'xcopa'", 'q.lang', f"'{COPA_TEMPLATE.name}'")} AS task, q.doc_id,
               'Given the premise "' || premise || '" which is the most likely ' || CASE WHEN doc_id % 2 = 0 THEN 'cause' ELSE 'effect' END
                 || '? A: "' || hypothesis || '" or B: "' || second || '"' AS inputs,
               COALESCE(CASE label WHEN 0 THEN 'A' WHEN 1 THEN 'B' END, '<NO LABEL>') AS targets,
               round(1.0 / (SELECT count(*) FROM t), 6) AS rate
        FROM q""",
)
def q_copa_suite(spark, sf_dir):
    rows = _eval_rows(spark, sf_dir).where("second is not null")
    question = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("cause")).otherwise(F.lit("effect"))
    rows = rows.select("lang", "doc_id", "premise", question.alias("question"), F.col("hypothesis").alias("choice1"), F.col("second").alias("choice2"), "label")
    return _suite(rows, COPA_TEMPLATE, "xcopa", "xcopa_eval")


@register(
    "equal_rates",
    f"""WITH t AS (SELECT DISTINCT {TASK("'xnli'", 'lang', "'based_on_previous_passage_en'")} AS task FROM documents)
        SELECT 'xnli_eval' AS mixture, task, round(1.0 / count(*) OVER (), 6) AS rate FROM t""",
)
def q_equal_rates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang").distinct()
    t = d.select(F.lit("xnli_eval").alias("mixture"), task_name(F.lit("xnli"), "lang", F.lit(NLI_TEMPLATES[0].name)).alias("task"))
    return equal_rates(t).select("mixture", "task", F.round("rate", 6).alias("rate"))
