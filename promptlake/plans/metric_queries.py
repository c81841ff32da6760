"""Registered queries: evaluation metrics over prediction tables derived from the inputs.

Prediction tables: dialogue pairs (user turn -> assistant turn) where the assistant text is
the target and a third of the rows (by hash) predict the user text instead; label tables
from ``labels`` with a third of the predictions flipped.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_u
from ..operators import metrics as M
from ..operators.dialogue import dialogue_pairs
from ..operators.templates import nonempty_pairs
from ..operators.tokens import append_eos, byte_tokens
from ..sources.tables import read
from .registry import ORACLES, register
from .sqlparts import STRIP, U

CORRUPT = 1.0 / 3.0
NTASKS = 4


def _sqlq(s: str) -> str:
    return s.replace("'", "''")


def dialogue_predictions(spark, sf_dir):
    p = nonempty_pairs(dialogue_pairs(read(spark, sf_dir, "conversations")))
    p = p.withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    p = p.withColumn("task", F.concat(F.lit("chat"), F.floor(hash_u("task", "conv_id") * NTASKS).cast("long").cast("string")))
    bad = hash_u("pred", "id") < CORRUPT
    return p.select(
        "task",
        "id",
        F.when(bad, F.col("inputs")).otherwise(F.concat(F.lit(" "), "targets", F.lit("\n"))).alias("prediction"),
        F.col("targets").alias("target"),
        F.array("targets", F.regexp_extract("targets", "^[^.]*", 0)).alias("references"),
    )


_ID = "(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR))"
_PRED_SQL = f"""pairs AS (
    SELECT u.conv_id, u.turn, u.text AS inputs, a.text AS targets
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 0 AND length(a.text) > 0),
  pred AS (
    SELECT 'chat' || CAST(CAST(floor({U("'task'", 'conv_id')} * {NTASKS}) AS BIGINT) AS VARCHAR) AS task,
           {_ID} AS id,
           CASE WHEN {U("'pred'", _ID)} < {CORRUPT!r} THEN inputs ELSE ' ' || targets || chr(10) END AS prediction,
           targets AS target, regexp_extract(targets, '^[^.]*') AS ref2
    FROM pairs)"""


def SQ_TOKS(x: str, trivia: bool = False) -> str:
    if trivia:
        t = f"regexp_replace(lower({x}), '{_sqlq(M.TRIVIA_PUNCT_CLASS)}', ' ', 'g')"
    else:
        t = f"regexp_replace(lower({x}), '{_sqlq(M.PUNCT_CLASS)}', '', 'g')"
    ws = "[ \\t\\n\\r\\f\\x0B]"
    return (
        f"list_filter(string_split_regex({STRIP(t)}, '{ws}+'), lambda w: w <> '' AND NOT list_contains(['a', 'an', 'the'], w))"
    )


def _overlap_sql(src: str, keys: str, pt: str, rt: str) -> str:
    """CTE fragment: per key row match/np/nr from token lists ``pt``/``rt`` of CTE ``src``."""
    return f"""pc AS (SELECT {keys}, tok, count(*) AS cp FROM (SELECT {keys}, unnest({pt}) AS tok FROM {src}) GROUP BY ALL),
  rc AS (SELECT {keys}, tok, count(*) AS cr FROM (SELECT {keys}, unnest({rt}) AS tok FROM {src}) GROUP BY ALL),
  mm AS (SELECT {keys}, sum(least(cp, cr)) AS match FROM pc JOIN rc USING ({keys}, tok) GROUP BY ALL),
  ov AS (SELECT s.*, COALESCE(mm.match, 0) AS match, len({pt}) AS np, len({rt}) AS nr FROM {src} s LEFT JOIN mm USING ({keys}))"""


F1_SQL = "CASE WHEN match = 0 OR np = 0 OR nr = 0 THEN 0.0 ELSE 2 * (match / np) * (match / nr) / ((match / np) + (match / nr)) END"


def _squad_sql(refs: list[str], trivia: bool = False, with_em: bool = True, base: str = "pred") -> str:
    rows = " UNION ALL ".join(
        f"SELECT task, id, {i} AS ref_i, {SQ_TOKS('prediction', trivia)} AS pt, {SQ_TOKS(r, trivia)} AS rt FROM {base}" for i, r in enumerate(refs)
    )
    em_col = "round(avg(em) * 100, 6) AS em, " if with_em else ""
    return f""", toks AS ({rows}),
  {_overlap_sql('toks', 'task, id, ref_i', 'pt', 'rt')},
  per AS (SELECT task, id, {F1_SQL} AS f1,
                 CASE WHEN array_to_string(pt, ' ') = array_to_string(rt, ' ') THEN 1.0 ELSE 0.0 END AS em FROM ov),
  best AS (SELECT task, id, max(em) AS em, max(f1) AS f1 FROM per GROUP BY task, id)
  SELECT task, {em_col}round(avg(f1) * 100, 6) AS f1 FROM best GROUP BY task"""


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register(
    "metric_accuracy",
    f"""WITH {_PRED_SQL}
        SELECT task, round(avg(CASE WHEN {STRIP('prediction')} = {STRIP('target')} THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy
        FROM pred GROUP BY task""",
)
def q_metric_accuracy(spark, sf_dir):
    return _r6(M.accuracy(dialogue_predictions(spark, sf_dir)), ["accuracy"])


@register(
    "metric_seq_accuracy",
    f"""WITH {_PRED_SQL}
        SELECT task, round(avg(CASE WHEN {STRIP('prediction')} = {STRIP('target')} THEN 1.0 ELSE 0.0 END) * 100, 6) AS sequence_accuracy
        FROM pred GROUP BY task""",
)
def q_metric_seq_accuracy(spark, sf_dir):
    p = dialogue_predictions(spark, sf_dir)
    p = p.withColumn("pt", byte_tokens(M.strip("prediction"))).withColumn("tt", byte_tokens(M.strip("target")))
    return _r6(M.sequence_accuracy(p, "pt", "tt"), ["sequence_accuracy"])


@register("metric_squad", f"WITH {_PRED_SQL}" + _squad_sql(["target", "ref2"]))
def q_metric_squad(spark, sf_dir):
    return _r6(M.squad(dialogue_predictions(spark, sf_dir)), ["em", "f1"])


@register("metric_coqa", f"WITH {_PRED_SQL}" + _squad_sql(["target", "ref2"], with_em=False))
def q_metric_coqa(spark, sf_dir):
    return _r6(M.squad(dialogue_predictions(spark, sf_dir), with_em=False), ["f1"])


@register(
    "metric_trivia",
    f"WITH {_PRED_SQL}" + _squad_sql(["target", "upper(target)", "ref2"], trivia=True),
)
def q_metric_trivia(spark, sf_dir):
    p = dialogue_predictions(spark, sf_dir)
    p = p.withColumn("references", F.array("target", F.upper("target"), F.element_at("references", 2)))
    return _r6(M.squad(p, trivia=True), ["em", "f1"])


_SPAN_SQL = f""", sp AS (
    SELECT task, id, target AS ctx, len(string_split(target, ' ')) AS nw,
           CAST(floor({U("'span'", 'id')} * len(string_split(target, ' '))) AS BIGINT) AS s0,
           {U("'pred'", 'id')} < {CORRUPT!r} AS bad FROM pred),
  sp2 AS (SELECT *, least(s0 + 2, nw - 1) AS e0, least(s0 + CASE WHEN bad THEN 1 ELSE 0 END, nw - 1) AS s1,
                 least(s0 + 2 + CASE WHEN bad THEN 1 ELSE 0 END, nw - 1) AS e1 FROM sp),
  spans AS (SELECT task, id, array_to_string(string_split(ctx, ' ')[s1 + 1 : e1 + 1], ' ') AS prediction,
                   array_to_string(string_split(ctx, ' ')[s0 + 1 : e0 + 1], ' ') AS target FROM sp2)"""


@register("metric_span_squad", f"WITH {_PRED_SQL}{_SPAN_SQL}" + _squad_sql(["target"], base="spans"))
def q_metric_span_squad(spark, sf_dir):
    p = dialogue_predictions(spark, sf_dir).select("task", "id", F.col("target").alias("ctx"))
    nw = F.size(F.split("ctx", " ", -1))
    bad = hash_u("pred", "id") < CORRUPT
    s0 = F.floor(hash_u("span", "id") * nw)
    e0 = F.least(s0 + 2, nw - 1)
    shift = F.when(bad, 1).otherwise(0)
    s1 = F.least(s0 + shift, nw - 1)
    e1 = F.least(s0 + 2 + shift, nw - 1)
    spans = p.select(
        "task", "id", M.span_text("ctx", s1, e1).alias("prediction"), M.span_text("ctx", s0, e0).alias("target")
    ).withColumn("references", F.array("target"))
    return _r6(M.squad(spans), ["em", "f1"])


def _ngram_sql(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) < {n} THEN []::VARCHAR[] ELSE list_transform(range(0, len({x}) - {n} + 1), lambda i: array_to_string({x}[i + 1 : i + {n}], ' ')) END"


def _bleu_sql() -> str:
    ws = "\\s+"
    parts = " UNION ALL ".join(
        f"SELECT task, id, {n} AS n, {_ngram_sql('p', n)} AS pg, {_ngram_sql('r', n)} AS rg FROM bt" for n in range(1, 5)
    )
    return f"""WITH {_PRED_SQL},
      bt AS (SELECT task, id, list_filter(string_split_regex({STRIP('prediction')}, '{ws}'), lambda w: w <> '') AS p,
                    list_filter(string_split_regex({STRIP('target')}, '{ws}'), lambda w: w <> '') AS r FROM pred),
      ng AS ({parts}),
      {_overlap_sql('ng', 'task, id, n', 'pg', 'rg')},
      prec AS (SELECT task, n, sum(match) AS m, sum(np) AS t FROM ov GROUP BY task, n),
      lens AS (SELECT task, sum(len(p)) AS c, sum(len(r)) AS rl FROM bt GROUP BY task),
      lp AS (SELECT task, sum(CASE WHEN m > 0 THEN ln(m / t) END) AS slog, min(m) AS minm FROM prec GROUP BY task)
    SELECT lp.task, round(CASE WHEN minm = 0 OR c = 0 THEN 0.0
                   ELSE (CASE WHEN c >= rl THEN 1.0 ELSE exp(1 - rl / c) END) * exp(slog / 4) END * 100, 6) AS bleu
    FROM lp JOIN lens USING (task)"""


@register("metric_bleu", _bleu_sql())
def q_metric_bleu(spark, sf_dir):
    return _r6(M.bleu(dialogue_predictions(spark, sf_dir)), ["bleu"])


def _rouge_sql(n: int) -> str:
    tok = lambda x: f"list_filter(string_split({STRIP(f'regexp_replace(lower({x}), {chr(39)}[^a-z0-9]+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, ' '), lambda w: w <> '')"
    return f"""WITH {_PRED_SQL},
      rt AS (SELECT task, id, {tok('prediction')} AS p, {tok('target')} AS r FROM pred),
      ng AS (SELECT task, id, {_ngram_sql('p', n)} AS pg, {_ngram_sql('r', n)} AS rg FROM rt),
      {_overlap_sql('ng', 'task, id', 'pg', 'rg')}
    SELECT task, round(avg({F1_SQL}) * 100, 6) AS rouge{n} FROM ov GROUP BY task"""


@register("metric_rouge12", f"""WITH a AS ({_rouge_sql(1)}), b AS ({_rouge_sql(2)}) SELECT a.task, a.rouge1, b.rouge2 FROM a JOIN b USING (task)""")
def q_metric_rouge12(spark, sf_dir):
    p = dialogue_predictions(spark, sf_dir)
    return _r6(M.rouge_ns(p, (1, 2)), ["rouge1", "rouge2"])


# Dynamic programs as nested reductions: the outer one goes over the rows of the table (words of the
# prediction), the inner one builds a row from the one before.
_ROUGE_TOK = lambda x: f"list_filter(string_split({STRIP(f'regexp_replace(lower({x}), {chr(39)}[^a-z0-9]+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, ' '), lambda w: w <> '')"


def _dp_sql(cell: str, carry: str, first: str, start: str) -> str:
    return f"""list_reduce(list_transform(range(1, len(p) + 1), lambda i: [i]), lambda acc, w:
        list_reduce(list_transform(range(1, len(r) + 1), lambda j: [{cell}]), lambda c, x: list_append(c, {carry}), [{first}]),
        {start})[-1]"""


_LCS_SQL = _dp_sql("greatest(acc[j + 1], acc[j] + CAST(p[w[1]] = r[j] AS BIGINT))", "greatest(c[-1], x[1])", "0", "list_transform(range(0, len(r) + 1), lambda j: 0::BIGINT)")
_EDIT_SQL = _dp_sql("least(acc[j + 1] + 1, acc[j] + CAST(p[w[1]] <> r[j] AS BIGINT))", "least(c[-1] + 1, x[1])", "w[1]", "range(0, len(r) + 1)")


@register(
    "metric_rouge_l",
    f"""WITH {_PRED_SQL},
      rt AS (SELECT task, id, {_ROUGE_TOK('prediction')} AS p, {_ROUGE_TOK('target')} AS r FROM pred),
      ov AS (SELECT task, id, {_LCS_SQL} AS match, len(p) AS np, len(r) AS nr FROM rt)
    SELECT task, round(avg({F1_SQL}) * 100, 6) AS "rougeL" FROM ov GROUP BY task""",
)
def q_metric_rouge_l(spark, sf_dir):
    return _r6(M.rouge_l(dialogue_predictions(spark, sf_dir)), ["rougeL"])


_TABLE_SQL = """list_reduce(list_transform(range(1, len(r) + 1), lambda i: [[i]]), lambda acc, w:
        list_append(acc, list_reduce(list_transform(range(1, len(p) + 1), lambda j: [greatest(acc[-1][j + 1], acc[-1][j] + CAST(r[w[1][1]] = p[j] AS BIGINT))]),
                                     lambda c, x: list_append(c, greatest(c[-1], x[1])), [0::BIGINT])),
        [list_transform(range(0, len(p) + 1), lambda j: 0::BIGINT)])"""
# The walk back through the table: [words of r left, words of p left, positions taken ...].
_WALK_SQL = """list_reduce(list_transform(range(0, len(r) + len(p)), lambda k: [k]), lambda acc, k:
        CASE WHEN acc[1] = 0 OR acc[2] = 0 THEN acc
             WHEN r[acc[1]] = p[acc[2]] THEN list_concat([acc[1] - 1, acc[2] - 1], acc[3:], [acc[1]])
             WHEN t[acc[1] + 1][acc[2]] > t[acc[1]][acc[2] + 1] THEN list_concat([acc[1], acc[2] - 1], acc[3:])
             ELSE list_concat([acc[1] - 1, acc[2]], acc[3:]) END,
        [CAST(len(r) AS BIGINT), CAST(len(p) AS BIGINT)])[3:]"""


def _sentence_sql(x: str) -> str:
    cut = f"regexp_replace({x}, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(10), 'g')"
    return f"SELECT task, id, s, {_ROUGE_TOK('line')} AS w FROM (SELECT task, id, unnest(string_split({cut}, chr(10))) AS line, unnest(range(len(string_split({cut}, chr(10))))) AS s FROM pred)"


@register(
    "metric_rouge_lsum",
    f"""WITH {_PRED_SQL},
      ps AS ({_sentence_sql('prediction')}), rs AS ({_sentence_sql('target')}),
      pairs_of AS (SELECT rs.task, rs.id, rs.s, rs.w AS r, ps.w AS p FROM rs JOIN ps ON ps.task = rs.task AND ps.id = rs.id WHERE len(rs.w) > 0 AND len(ps.w) > 0),
      tables AS (SELECT *, {_TABLE_SQL} AS t FROM pairs_of),
      taken AS (SELECT DISTINCT id, s, r[i] AS word, i FROM (SELECT id, s, r, unnest({_WALK_SQL}) AS i FROM tables)),
      united AS (SELECT id, word, count(*) AS n FROM taken GROUP BY id, word),
      have AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(w) AS word FROM ps) GROUP BY id, word),
      hits AS (SELECT id, sum(least(united.n, have.n)) AS match FROM united JOIN have USING (id, word) GROUP BY id),
      np AS (SELECT id, sum(len(w)) AS np FROM ps GROUP BY id), nr AS (SELECT id, sum(len(w)) AS nr FROM rs GROUP BY id),
      ov AS (SELECT pred.task, pred.id, CAST(coalesce(match, 0) AS BIGINT) AS match, np, nr FROM pred JOIN np USING (id) JOIN nr USING (id) LEFT JOIN hits USING (id))
    SELECT task, round(avg({F1_SQL}) * 100, 6) AS "rougeLsum" FROM ov GROUP BY task""",
)
def q_metric_rouge_lsum(spark, sf_dir):
    return _r6(M.rouge_lsum(dialogue_predictions(spark, sf_dir), sentences=M.marked_sentences), ["rougeLsum"])


_DIST_SQL = """SELECT task, CAST(min(d) AS BIGINT) AS min_distance, CAST(max(d) AS BIGINT) AS max_distance, round(avg(d), 6) AS mean_distance,
      round(quantile_cont(d, 0.5), 6) AS median_distance, CAST(sum(d) AS BIGINT) AS total_distance FROM dist GROUP BY task"""

# DuckDB's levenshtein counts bytes: the characters of a pair are numbered and written as one byte
# each (up to 127 different characters in a pair; more make chr() two bytes long)
_BYTE_PER_CHAR = "array_to_string(list_transform(string_split({0}, ''), lambda x: chr(CAST(list_position(v, x) AS INTEGER))), '')"


@register(
    "metric_edit_char",
    f"""WITH {_PRED_SQL},
      s AS (SELECT task, {STRIP('prediction')} AS p, {STRIP('target')} AS r FROM pred),
      c AS (SELECT *, list_distinct(list_concat(string_split(p, ''), string_split(r, ''))) AS v FROM s),
      dist AS (SELECT task, levenshtein({_BYTE_PER_CHAR.format('p')}, {_BYTE_PER_CHAR.format('r')}) AS d FROM c)
    {_DIST_SQL}""",
)
def q_metric_edit_char(spark, sf_dir):
    return _r6(M.edit_distance_chars(dialogue_predictions(spark, sf_dir)), ["mean_distance", "median_distance"])


@register(
    "metric_edit",
    f"""WITH {_PRED_SQL},
      s AS (SELECT task, string_split_regex({STRIP('prediction')}, '\\s+') AS p, string_split_regex({STRIP('target')}, '\\s+') AS r FROM pred),
      dist AS (SELECT task, {_EDIT_SQL} AS d FROM s)
    {_DIST_SQL}""",
)
def q_metric_edit(spark, sf_dir):
    return _r6(M.edit_distance_words(dialogue_predictions(spark, sf_dir)), ["mean_distance", "median_distance"])


# ------------------------------------------------------------------------------------------
# numeric metrics on events, label metrics on labels

_EV_SQL = """ev AS (SELECT e.event_type AS task, e.value AS x, n.value AS y FROM events e JOIN events n ON n.event_id = e.event_id + 1)"""


def _events_xy(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    n = e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("y"))
    return e.join(n, "event_id").select(F.col("event_type").alias("task"), F.col("value").alias("x"), "y")


@register("metric_pearson", f"WITH {_EV_SQL} SELECT task, round(corr(x, y) * 100, 4) AS pearson FROM ev GROUP BY task")
def q_metric_pearson(spark, sf_dir):
    r = M.pearson(_events_xy(spark, sf_dir), "x", "y")
    return r.select("task", F.round("pearson", 4).alias("pearson"))


@register(
    "metric_spearman",
    f"""WITH {_EV_SQL},
        r AS (SELECT task, rank() OVER (PARTITION BY task ORDER BY x) + (count(*) OVER (PARTITION BY task, x) - 1) / 2.0 AS rx,
                     rank() OVER (PARTITION BY task ORDER BY y) + (count(*) OVER (PARTITION BY task, y) - 1) / 2.0 AS ry FROM ev)
        SELECT task, round(corr(rx, ry) * 100, 4) AS spearman FROM r GROUP BY task""",
)
def q_metric_spearman(spark, sf_dir):
    r = M.spearman(_events_xy(spark, sf_dir), "x", "y")
    return r.select("task", F.round("spearman", 4).alias("spearman"))


_LAB_SQL = f"""lab AS (
    SELECT l.doc_id, d.source AS question, 'multirc' AS task, CAST(l.quality AS VARCHAR) AS target,
           floor({U("'score'", 'l.doc_id')} * 50) + 10 * l.quality AS score, l.quality AS label,
           CASE WHEN {U("'invalid'", 'l.doc_id')} < 0.05 THEN 'maybe'
                WHEN {U("'pred'", 'l.doc_id')} < {CORRUPT!r} THEN CAST(1 - l.quality AS VARCHAR)
                ELSE CAST(l.quality AS VARCHAR) END AS prediction
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _labels(spark, sf_dir):
    lab = read(spark, sf_dir, "labels")
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("question"))
    j = lab.join(d, "doc_id")
    q = F.col("quality")
    pred = (
        F.when(hash_u("invalid", "doc_id") < 0.05, F.lit("maybe"))
        .when(hash_u("pred", "doc_id") < CORRUPT, (1 - q).cast("string"))
        .otherwise(q.cast("string"))
    )
    return j.select(
        "doc_id",
        "question",
        F.lit("multirc").alias("task"),
        q.cast("string").alias("target"),
        (F.floor(hash_u("score", "doc_id") * 50) + 10 * q).cast("double").alias("score"),
        q.alias("label"),
        pred.alias("prediction"),
    )


@register(
    "metric_auc",
    f"""WITH {_LAB_SQL},
        r AS (SELECT task, label, rank() OVER (PARTITION BY task ORDER BY score) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS r FROM lab),
        s AS (SELECT task, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS rs, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS P,
                     sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS N FROM r GROUP BY task)
        SELECT task, round((rs - P * (P + 1) / 2.0) / (P * N) * 100, 6) AS auc FROM s""",
)
def q_metric_auc(spark, sf_dir):
    return _r6(M.auc(_labels(spark, sf_dir), "label", "score"), ["auc"])


@register(
    "metric_multirc",
    f"""WITH {_LAB_SQL},
        r AS (SELECT task, question, prediction IN ('0', '1') AND prediction = '1' AS p1, target = '1' AS t1,
                     prediction IN ('0', '1') AND prediction = target AS ok FROM lab),
        f AS (SELECT task, sum(CASE WHEN p1 AND t1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p1 AND NOT t1 THEN 1 ELSE 0 END) AS fp,
                     sum(CASE WHEN NOT p1 AND t1 THEN 1 ELSE 0 END) AS fn FROM r GROUP BY task),
        q AS (SELECT task, question, min(CAST(ok AS INTEGER)) AS q_ok FROM r GROUP BY task, question),
        e AS (SELECT task, avg(q_ok) * 100 AS em FROM q GROUP BY task)
        SELECT f.task, round(CASE WHEN tp = 0 THEN 0.0 ELSE 200.0 * tp / (2 * tp + fp + fn) END, 6) AS f1a, round(em, 6) AS em
        FROM f JOIN e USING (task)""",
)
def q_metric_multirc(spark, sf_dir):
    return _r6(M.multirc(_labels(spark, sf_dir)), ["f1a", "em"])


@register(
    "metric_gen_len",
    f"""WITH {_PRED_SQL}
        SELECT task, round(avg(strlen(prediction) + 1), 4) AS gen_len
        FROM pred GROUP BY task""",
)
def q_metric_gen_len(spark, sf_dir):
    p = dialogue_predictions(spark, sf_dir).withColumn("ids", append_eos(byte_tokens("prediction")))
    return M.gen_len(p, "ids")


# ------------------------------------------------------------------------------------------
# metric dispatch per task

# Metric sets over the corpus' datasets (source, language or all languages, metric);
# datasets without one have accuracy.
CORPUS_METRIC_SETS = [
    ("src0", None, "F1"),
    ("src0", None, "Accuracy"),
    ("src0", "de", "Matthews Correlation"),
    ("src1", None, "Mean Class F1"),
    ("src2", None, "Matthews Correlation"),
    ("src3", None, "Pearson Correlation"),
    ("src4", None, "AUC"),
    ("src5", None, "Squad"),
    ("src6", None, "Edit Distance"),
    ("src7", None, "Spearman Correlation"),
    ("src8", "en", "Sequence Accuracy"),
    ("src9", None, "MultiRC"),
]


def _label_predictions(spark, sf_dir):
    """Quality predictions of the labelled documents; a task is a (source, language)."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"), F.col("lang").alias("subset"))
    rows = read(spark, sf_dir, "labels").join(d, "doc_id")
    y = F.col("quality")
    pred = F.when(hash_u("quality", "doc_id") < CORRUPT, 1 - y).otherwise(y)
    return rows.select(
        F.concat_ws("_", "dataset", "subset").alias("task"), "dataset", "subset", F.col("doc_id").alias("id"), pred.cast("string").alias("prediction"), y.cast("string").alias("target")
    )


def _metric_plan(spark, preds):
    from ..operators.metrics_dispatch import metric_plan

    sets = spark.createDataFrame(CORPUS_METRIC_SETS, "dataset string, subset string, metric string")
    return metric_plan(preds.select("task", "dataset", "subset").distinct(), sets)


_SETS_VALUES = ", ".join(f"('{d}', {repr(s) if s else 'NULL'}, '{m}')" for d, s, m in CORPUS_METRIC_SETS)
_PLAN_SQL = f"""p AS (
    SELECT d.source || '_' || d.lang AS task, d.source AS dataset, d.lang AS subset, l.doc_id AS id, CAST(l.quality AS VARCHAR) AS target,
           CAST(CASE WHEN {U("'quality'", 'l.doc_id')} < {CORRUPT!r} THEN 1 - l.quality ELSE l.quality END AS VARCHAR) AS prediction
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
  sets AS (SELECT * FROM (VALUES {_SETS_VALUES}) v(dataset, subset, metric)),
  t AS (SELECT DISTINCT task, dataset, subset FROM p),
  own AS (SELECT task, metric FROM t JOIN sets ON sets.dataset = t.dataset AND sets.subset = t.subset),
  plan AS (
    SELECT * FROM own UNION ALL
    SELECT t.task, coalesce(sets.metric, 'Accuracy') FROM t LEFT JOIN sets ON sets.dataset = t.dataset AND sets.subset IS NULL
    WHERE t.task NOT IN (SELECT task FROM own))"""


@register("metric_lookup", f"WITH {_PLAN_SQL} SELECT DISTINCT task, metric FROM plan")
def q_metric_lookup(spark, sf_dir):
    return _metric_plan(spark, _label_predictions(spark, sf_dir))


@register(
    "metric_by_task",
    f"""WITH {_PLAN_SQL},
      hit AS (SELECT *, CASE WHEN prediction = target THEN 1.0 ELSE 0.0 END AS ok, CAST(prediction AS DOUBLE) AS x, CAST(target AS DOUBLE) AS y FROM p),
      ranked AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY x) + (count(*) OVER (PARTITION BY task, x) - 1) / 2.0 AS rx,
                        rank() OVER (PARTITION BY task ORDER BY y) + (count(*) OVER (PARTITION BY task, y) - 1) / 2.0 AS ry FROM hit),
      agg AS (
        SELECT task, avg(ok) * 100 AS acc, count(*) AS n, sum(x) AS px, sum(y) AS py, sum(x * y) AS tp, sum((1 - x) * (1 - y)) AS tn,
               corr(x, y) * 100 AS pearson, corr(rx, ry) * 100 AS spearman, sum(rx * y) AS rs, min(ok) AS min_ok, sum(1 - ok) AS wrong, median(1 - ok) AS med FROM ranked GROUP BY task),
      v AS (
        SELECT task, 'Accuracy' AS name, 'accuracy' AS metric, acc AS value FROM agg
        UNION ALL SELECT task, 'Sequence Accuracy', 'sequence_accuracy', acc FROM agg
        UNION ALL SELECT task, 'Squad', unnest(['em', 'f1']), acc FROM agg
        UNION ALL SELECT task, 'F1', 'f1', CASE WHEN tp = 0 THEN 0 ELSE 200 * tp / (px + py) END FROM agg
        UNION ALL SELECT task, 'Mean Class F1', 'mean_class_f1',
               CASE WHEN py = 0 THEN 200 * tn / (2 * n - px - py) WHEN py = n THEN 200 * tp / (px + py)
                    ELSE 100 * (tp / (px + py) + tn / (2 * n - px - py)) END FROM agg
        UNION ALL SELECT task, 'Matthews Correlation', 'matthews',
               CASE WHEN px = 0 OR px = n OR py = 0 OR py = n THEN 0
                    ELSE 100 * ((tp + tn) * n - px * py - (n - px) * (n - py)) / sqrt((n * n - px * px - (n - px) * (n - px)) * (n * n - py * py - (n - py) * (n - py))) END FROM agg
        UNION ALL SELECT task, 'Pearson Correlation', 'pearson', pearson FROM agg
        UNION ALL SELECT task, 'Spearman Correlation', 'spearman', spearman FROM agg
        UNION ALL SELECT task, 'AUC', 'auc', CASE WHEN py > 0 AND py < n THEN (rs - py * (py + 1) / 2) / (py * (n - py)) * 100 END FROM agg
        UNION ALL SELECT task, 'MultiRC', 'f1a', CASE WHEN tp = 0 THEN 0 ELSE 200 * tp / (px + py) END FROM agg
        UNION ALL SELECT task, 'MultiRC', 'em', acc FROM agg
        UNION ALL SELECT task, 'Edit Distance', 'min_distance', CASE WHEN acc = 0 THEN 1 ELSE 0 END FROM agg
        UNION ALL SELECT task, 'Edit Distance', 'max_distance', 1 - min_ok FROM agg
        UNION ALL SELECT task, 'Edit Distance', 'mean_distance', wrong / n FROM agg
        UNION ALL SELECT task, 'Edit Distance', 'median_distance', med FROM agg
        UNION ALL SELECT task, 'Edit Distance', 'total_distance', wrong FROM agg)
    SELECT v.task, v.metric, CASE WHEN isnan(value) THEN NULL ELSE round(value, 4) END AS value FROM v JOIN plan ON plan.task = v.task AND plan.metric = v.name""",
)
def q_metric_by_task(spark, sf_dir):
    from ..operators.metrics_dispatch import metrics_by_task

    preds = _label_predictions(spark, sf_dir)
    r = metrics_by_task(preds, _metric_plan(spark, preds))
    return r.select("task", "metric", F.round(F.nanvl("value", F.lit(None).cast("double")), 4).alias("value"))


# The collection and subset that each dialogue task stands for, and metric sets beside the public ones.
TEXT_TASKS = [("chat0", "super_glue", "record"), ("chat1", "chat", "qa"), ("chat2", "chat", "summary"), ("chat3", "chat", "reply")]
TEXT_SETS = [("chat", "qa", "COQA F1"), ("chat", "summary", "ROUGE"), ("chat", None, "BLEU")]


def _text_metric_sql(task: str, query: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT task, '{c}' AS metric, CAST("{c}" AS DOUBLE) AS value FROM ({ORACLES[query]}) WHERE task = '{task}'""" for c in columns)


@register(
    "metric_text_by_task",
    " UNION ALL ".join(
        [
            _text_metric_sql("chat0", "metric_squad", ["em", "f1"]),
            _text_metric_sql("chat1", "metric_coqa", ["f1"]),
            _text_metric_sql("chat2", "metric_rouge12", ["rouge1", "rouge2"]),
            _text_metric_sql("chat2", "metric_rouge_l", ["rougeL"]),
            _text_metric_sql("chat3", "metric_bleu", ["bleu"]),
        ]
    ),
)
def q_metric_text_by_task(spark, sf_dir):
    """Free-text answers scored by the metric set of the collection that a task belongs to."""
    from ..operators.metrics_dispatch import METRIC_SETS, metric_plan, metrics_by_task

    tasks = spark.createDataFrame(TEXT_TASKS, "task string, dataset string, subset string")
    sets = spark.createDataFrame(METRIC_SETS + TEXT_SETS, "dataset string, subset string, metric string")
    r = metrics_by_task(dialogue_predictions(spark, sf_dir), metric_plan(tasks, sets))
    return r.select("task", "metric", F.round("value", 6).alias("value"))
