"""Metrics against small pure-Python references."""

import math
import re
import string
from collections import Counter

import pytest

from promptlake.operators import metrics as M

PREDS = [
    ("t", 1, " The cat sat on the mat. ", "the cat sat on a mat", ["the cat sat on a mat", "a cat"]),
    ("t", 2, "dog", "A dog!", ["A dog!", "the dog barks"]),
    ("t", 3, "", "something else here", ["something else here", "else"]),
    ("u", 4, "one two three four five", "one two three four five six", ["one two three four five six", "x"]),
]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(PREDS, "task string, id long, prediction string, target string, references array<string>")


def _norm(s):
    s = s.lower()
    s = "".join(ch for ch in s if ch not in set(string.punctuation))
    return [w for w in s.split() if w not in ("a", "an", "the")]


def _f1(p, r):
    common = sum((Counter(p) & Counter(r)).values())
    if common == 0:
        return 0.0
    pr, rc = common / len(p), common / len(r)
    return 2 * pr * rc / (pr + rc)


def test_squad(spark, preds):
    got = {r.task: (r.em, r.f1) for r in M.squad(preds).collect()}
    for task in ("t", "u"):
        rows = [x for x in PREDS if x[0] == task]
        em = sum(max(float(_norm(p) == _norm(ref)) for ref in refs) for _, _, p, _, refs in rows) / len(rows) * 100
        f1 = sum(max(_f1(_norm(p), _norm(ref)) for ref in refs) for _, _, p, _, refs in rows) / len(rows) * 100
        assert got[task][0] == pytest.approx(em) and got[task][1] == pytest.approx(f1)


def _ngrams(t, n):
    return [" ".join(t[i : i + n]) for i in range(len(t) - n + 1)]


def test_bleu_and_rouge(spark, preds):
    rows = [x for x in PREDS if x[0] == "u"]
    p, r = rows[0][2].split(), rows[0][3].split()
    prec = [sum((Counter(_ngrams(p, n)) & Counter(_ngrams(r, n))).values()) / len(_ngrams(p, n)) for n in range(1, 5)]
    bp = math.exp(1 - len(r) / len(p))
    want = bp * math.exp(sum(math.log(x) for x in prec) / 4) * 100
    got = {x.task: x.bleu for x in M.bleu(preds).collect()}
    assert got["u"] == pytest.approx(want)
    toks = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).split()
    r1 = {x.task: x.rouge1 for x in M.rouge_n(preds, 1).collect()}
    want_t = sum(_f1(toks(pp), toks(tt)) for task, _i, pp, tt, _r in PREDS if task == "t") / 3 * 100
    assert r1["t"] == pytest.approx(want_t)


def _lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_rouge_l(spark, preds):
    toks = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).split()
    got = {x.task: x.rougeL for x in M.rouge_l(preds).collect()}
    for task in ("t", "u"):
        rows = [x for x in PREDS if x[0] == task]
        vals = []
        for _, _, p, t, _ in rows:
            a, b = toks(p), toks(t)
            lcs = _lcs(a, b)
            vals.append(0.0 if lcs == 0 else 2 * (lcs / len(a)) * (lcs / len(b)) / ((lcs / len(a)) + (lcs / len(b))))
        assert got[task] == pytest.approx(sum(vals) / len(vals) * 100)


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_edit_distances(spark, preds):
    chars = {x.task: x for x in M.edit_distance_chars(preds).collect()}
    words = {x.task: x for x in M.edit_distance_words(preds).collect()}
    for task in ("t", "u"):
        rows = [x for x in PREDS if x[0] == task]
        dc = [_lev(p.strip(), t.strip()) for _, _, p, t, _ in rows]
        dw = [_lev(re.split(r"\s+", p.strip()), re.split(r"\s+", t.strip())) for _, _, p, t, _ in rows]
        assert chars[task].total_distance == sum(dc) and chars[task].max_distance == max(dc)
        assert words[task].total_distance == sum(dw) and words[task].min_distance == min(dw)


def test_rank_metrics(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0, 5.0, 0.5]
    ys = [2.0, 1.0, 4.0, 3.0, 6.0, 6.0, 1.0, 0.0]
    df = spark.createDataFrame([("t", x, y) for x, y in zip(xs, ys)], "task string, x double, y double")

    def avg_ranks(v):
        order = sorted(range(len(v)), key=lambda i: v[i])
        r = [0.0] * len(v)
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and v[order[j + 1]] == v[order[i]]:
                j += 1
            for k in range(i, j + 1):
                r[order[k]] = (i + j) / 2 + 1
            i = j + 1
        return r

    rx, ry = avg_ranks(xs), avg_ranks(ys)
    mx, my = sum(rx) / len(rx), sum(ry) / len(ry)
    cov = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    want = cov / math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) * 100
    assert M.spearman(df, "x", "y").first().spearman == pytest.approx(want)
    labels = [0, 1, 1, 0, 1, 1, 0, 0]
    lab = spark.createDataFrame([("t", lb, x) for lb, x in zip(labels, xs)], "task string, label int, score double")
    pos = [x for x, lb in zip(xs, labels) if lb == 1]
    neg = [x for x, lb in zip(xs, labels) if lb == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) * 100
    assert M.auc(lab, "label", "score").first().auc == pytest.approx(auc)


def test_multirc(spark):
    rows = [("m", "q1", "1", "1"), ("m", "q1", "0", "1"), ("m", "q2", "maybe", "0"), ("m", "q3", "0", "0")]
    df = spark.createDataFrame(rows, "task string, question string, prediction string, target string")
    r = M.multirc(df).first()
    assert r.f1a == pytest.approx(200 * 1 / (2 * 1 + 0 + 1)) and r.em == pytest.approx(100 / 3)


def test_rouge_one_pass_equals_per_order(spark, preds):
    both = {r.task: (r.rouge1, r.rouge2) for r in M.rouge_ns(preds, (1, 2)).collect()}
    r1 = {r.task: r.rouge1 for r in M.rouge_n(preds, 1).collect()}
    r2 = {r.task: r.rouge2 for r in M.rouge_n(preds, 2).collect()}
    for t in ("t", "u"):
        assert both[t][0] == pytest.approx(r1[t]) and both[t][1] == pytest.approx(r2[t])


def test_rows_without_references_score_zero(spark):
    rows = [("t", "1", "a b", ["a b"]), ("t", "2", "a b", None), ("t", "3", "a b", [])]
    df = spark.createDataFrame(rows, "task string, id string, prediction string, references array<string>")
    r = M.squad(df).first()
    assert abs(r.em - 100 / 3) < 1e-9 and abs(r.f1 - 100 / 3) < 1e-9


def test_dialogue_ids_do_not_collide(spark, tmp_path):
    from promptlake.plans.metric_queries import dialogue_predictions

    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}.") for c, ts in ((1, (1000, 1001)), (2, (0, 1))) for t in ts]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.id for r in dialogue_predictions(spark, str(tmp_path)).collect()} == {"1:1000", "2:0"}


def test_edit_distance_of_many_words(spark):
    import random

    r = random.Random(8)
    words = [f"w{i}" for i in range(40_000)]
    a = words[:300]
    b = [w for w in a if r.random() > 0.1] + ["new"]
    rows = [("t", " ".join(words), " ".join(words[:100])), ("t", " ".join(a), " ".join(b)), ("t", "", "x y"), ("t", "x", "x")]
    df = spark.createDataFrame(rows, "task string, prediction string, target string")
    got = M.edit_distance_words(df).first()

    def lev(x, y):
        p = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            n = [i]
            for j, v in enumerate(y, 1):
                n.append(min(p[j] + 1, p[j - 1] + (u != v), n[-1] + 1))
            p = n
        return p[-1]

    want = [39_900, lev(a, b), 2, 0]
    assert (got.min_distance, got.max_distance, got.total_distance) == (0, 39_900, sum(want))


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7), ("b", 1, 0.9), ("b", 0, 0.1)], "task string, label int, score double")
    assert {r.task: r.auc for r in M.auc(df, "label", "score").collect()} == {"a": None, "b": 100.0}


def test_metric_lookup_and_unknown_names(spark):
    import pytest

    from promptlake.operators.metrics_dispatch import METRIC_SETS, metric_plan, metrics_by_task

    tasks = spark.createDataFrame([("m", "glue", "mrpc"), ("s", "glue", "sst2"), ("r", "super_glue", "record"), ("x", "other", None)], "task string, dataset string, subset string")
    sets = spark.createDataFrame(METRIC_SETS + [("other", None, "ROUGE")], "dataset string, subset string, metric string")
    plan = metric_plan(tasks, sets)
    assert {(r.task, r.metric) for r in plan.collect()} == {("m", "F1"), ("m", "Accuracy"), ("s", "Accuracy"), ("r", "Squad"), ("x", "ROUGE")}
    preds = spark.createDataFrame([(t, str(i), p, q) for t in "msrx" for i, (p, q) in enumerate([("1", "1"), ("0", "1"), ("1", "0")])], "task string, id string, prediction string, target string")
    got = {(r.task, r.metric): r.value for r in metrics_by_task(preds, plan).collect()}
    assert got["m", "f1"] == 50.0 and abs(got["r", "em"] - 100 / 3) < 1e-9 and ("x", "rougeL") in got and ("x", "rouge2") in got
    with pytest.raises(ValueError, match="no such metric"):
        metrics_by_task(preds, spark.createDataFrame([("m", "squad2")], "task string, metric string"))


def test_families_equal_the_metrics_alone(spark):
    """Shared sums give what each metric gives on its own, with nulls, blanks, many classes and large numbers."""
    import random

    from promptlake.operators import metrics_dispatch as D

    r = random.Random(3)
    labels = ["1", "0", " 1 ", "2.5", "x", "", None]
    rows = [(t, str(i), r.choice(labels), r.choice(labels)) for t in "abc" for i in range(60)]
    rows += [("big", str(i), str(10**8 + i % 3), str(10**8 + i % 5)) for i in range(40)] + [("words", str(i), "a", "b") for i in range(5)] + [("one", str(i), "1", "1") for i in range(5)]
    preds = spark.createDataFrame(rows, "task string, id string, prediction string, target string")
    names = [*D.LABEL_METRICS, *D.CLASS_METRICS, *D.ANSWER_METRICS]
    for name in names:
        plan = spark.createDataFrame([(t, name) for t in ("a", "b", "big", "words", "one")], "task string, metric string")
        got = {(x.task, x.metric): x.value for x in D.metrics_by_task(preds, plan).collect()}
        want = {(x.task, x.metric): x.value for x in D._tall(D.METRICS[name](preds.where("task <> 'c'"))).collect()}
        assert got.keys() == want.keys(), name
        assert all(a == b or a is not None and b is not None and abs(a - b) < 1e-6 for a, b in ((got[k], want[k]) for k in want)), (name, got, want)
    both = spark.createDataFrame([(t, n) for t in ("a", "b") for n in names] + [("c", "F1")], "task string, metric string")
    shared = D.metrics_by_task(preds, both)
    assert {x.task for x in shared.collect()} == {"a", "b", "c"} and shared.where("task = 'c'").count() == 1


def test_metrics_of_a_plan_read_the_documents_once(spark, monkeypatch):
    from promptlake import session
    from promptlake.plans import QUERIES

    plans, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df, name="stage": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or cut(df, name))
    out = QUERIES["metric_by_task"](spark, "/root/testdata/sf0.001")
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    scans = [p.count("documents.parquet") for _, p in plans]
    assert 0 < sum(scans) <= 3, [(n, s) for (n, _), s in zip(plans, scans, strict=True) if s]


def test_bleu_variants(spark):
    df = spark.createDataFrame([("t", "1", "a b c d e", "a b x d e")], "task string, id string, prediction string, target string")
    assert M.bleu(df).first().bleu == 0.0
    assert abs(M.bleu(df, smooth="exp").first().bleu - 100 * (4 / 5 * 2 / 4 * 1 / 6 * 1 / 8) ** 0.25) < 1e-6
    toks = spark.createDataFrame([("Costs 1,000.5 euros, ok!",)], "s string").select(M.international_tokens("s").alias("t")).first().t
    assert toks == ["Costs", "1,000.5", "euros", ",", "ok", "!"]
