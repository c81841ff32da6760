"""Evaluation metrics as aggregations over a predictions table (scale 0-100).

Input rows: ``task, id, prediction, target`` (+ ``references array<string>`` where a metric
takes several references); ``id`` must be unique in its task. N-gram metrics (BLEU, ROUGE-n) count
the n-grams of both sides of a row where the row is, over Arrow batches. Token F1 (SQuAD/CoQA) explodes the tokens of both sides once, each tagged with its side, counts both
per (row, token) in one aggregation and sums ``least`` of the counts per row: one pass over the
predictions, linear in the text, no self-join and no hot key. Sequence metrics (edit distance,
ROUGE-L) run one dynamic program over a whole Arrow batch of rows. Rank metrics (Spearman, AUC)
use average ranks from a two-phase running count over the distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hof import let
from ..functions.text import strip
from .tokens import steps

# Punctuation removed by the answer normaliser (Python's string.punctuation),
# the extra characters of the trivia variant, and the articles dropped.
PUNCT_CLASS = "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]"
TRIVIA_PUNCT_CLASS = "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~‘’´`]"
ARTICLES = ["a", "an", "the"]
# Fixed value: tokens whose n-grams a task counts at a time.
GRAM_STEP = 1 << 17


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------------------------
# normalisers


def squad_tokens(text, trivia: bool = False) -> Column:
    """lower -> punctuation removed (trivia: replaced by space) -> split on whitespace -> drop articles."""
    t = F.lower(_c(text))
    t = F.regexp_replace(t, TRIVIA_PUNCT_CLASS, " ") if trivia else F.regexp_replace(t, PUNCT_CLASS, "")
    toks = F.split(F.regexp_replace(t, "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$", ""), "[ \\t\\n\\r\\f\\x0B]+", -1)
    arts = F.array(*[F.lit(a) for a in ARTICLES])
    return F.filter(toks, lambda w: (w != "") & ~F.array_contains(arts, w))


def rouge_tokens(text) -> Column:
    """lower, non-alphanumeric -> space, split (the usual ROUGE tokenizer, no stemming)."""
    t = F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", " ")
    return F.filter(F.split(strip(t), " ", -1), lambda w: w != "")


def ngrams(tokens, n: int) -> Column:
    def body(t):
        return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
        )

    return let(_c(tokens), body)


# ---------------------------------------------------------------------------------------------
# overlap counting (explode -> count -> least)


def _sides(pred: Column, ref: Column) -> Column:
    """Tokens of both sides as one array of (tok, is_pred, is_ref)."""
    tag = lambda p, r: lambda t: F.struct(t.alias("tok"), F.lit(p).alias("cp"), F.lit(r).alias("cr"))
    return F.concat(F.transform(pred, tag(1, 0)), F.transform(ref, tag(0, 1)))


def overlap_counts(pairs: DataFrame, keys: list[str], pred_toks, ref_toks) -> DataFrame:
    """Per ``keys`` row: ``match`` = multiset overlap, ``n_pred``, ``n_ref`` sizes (rows without tokens: 0)."""
    each = pairs.select(*keys, F.explode_outer(_sides(_c(pred_toks), _c(ref_toks))).alias("t")).select(*keys, "t.*")
    counts = each.groupBy(*keys, "tok").agg(F.sum("cp").alias("cp"), F.sum("cr").alias("cr"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.groupBy(*keys).agg(total(F.least("cp", "cr")).alias("match"), total("cp").alias("n_pred"), total("cr").alias("n_ref"))


def _f1(match: Column, n_pred: Column, n_ref: Column) -> Column:
    """Token F1; 0 without overlap (so also where a side is empty)."""
    return F.when(match == 0, F.lit(0.0)).otherwise(2 * (match / n_pred) * (match / n_ref) / (match / n_pred + match / n_ref))


def accuracy(df: DataFrame, group=("task",)) -> DataFrame:
    """Exact match after strip."""
    return df.groupBy(*group).agg(
        (F.avg(F.when(strip("prediction") == strip("target"), 1.0).otherwise(0.0)) * 100).alias("accuracy")
    )


def sequence_accuracy(df: DataFrame, pred: str, target: str, group=("task",)) -> DataFrame:
    return df.groupBy(*group).agg((F.avg(F.when(F.col(pred) == F.col(target), 1.0).otherwise(0.0)) * 100).alias("sequence_accuracy"))


def squad(df: DataFrame, group=("task",), trivia: bool = False, with_em: bool = True) -> DataFrame:
    """EM and token F1 against the best of ``references`` (SQuAD / TriviaQA / CoQA style).

    A row with null or empty ``references`` scores 0; two answers that normalise to nothing match."""
    refs = df.select(*group, "id", "prediction", F.posexplode_outer("references").alias("ref_i", "ref"))
    toks = refs.select(*group, "id", "ref_i", F.col("ref").isNotNull().alias("has"), *[squad_tokens(F.coalesce(c, F.lit("")), trivia).alias(n) for c, n in (("prediction", "pt"), ("ref", "rt"))])
    toks = toks.withColumn("em", F.when(F.col("has") & (F.array_join("pt", " ") == F.array_join("rt", " ")), 1.0).otherwise(0.0))
    per = overlap_counts(toks, [*group, "id", "ref_i", "em"], "pt", "rt").withColumn("f1", _f1(F.col("match"), F.col("n_pred"), F.col("n_ref")))
    best = per.groupBy(*group, "id").agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    aggs = [(F.avg("f1") * 100).alias("f1")]
    if with_em:
        aggs = [(F.avg("em") * 100).alias("em")] + aggs
    return best.groupBy(*group).agg(*aggs)


def span_text(context, start, end) -> Column:
    """Words ``start..end`` (inclusive, 0-based) of a space-separated context."""
    return F.array_join(F.slice(F.split(_c(context), " ", -1), _c(start) + 1, _c(end) - _c(start) + 1), " ")


def _gram_counts(p: pa.Array, r: pa.Array, ns: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order of ``ns``: multiset overlap of the n-grams of each row's two lists, and how many each has.

    An n-gram is numbered within its row by its first n - 1 tokens' number and its last token."""
    rows = len(p)
    size = np.concatenate([_sizes(p), _sizes(r)])
    code = _token_codes(p, r).astype(np.int64)
    vocab = int(code.max(initial=0)) + 1
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # tokens from here to the list's end
    row = np.repeat(np.tile(np.arange(rows), 2), size)
    ref = np.repeat(np.repeat([False, True], rows), size)
    at, gram, found = np.arange(len(code)), row, {}
    for n in range(1, max(ns) + 1):
        there = left[at] >= n
        at, gram = at[there], gram[there]
        kinds, where, gram = np.unique(gram * vocab + code[at + n - 1], return_index=True, return_inverse=True)
        sides = [np.bincount(gram[ref[at] == side], minlength=len(kinds)) for side in (False, True)]
        match = np.bincount(row[at][where], weights=np.minimum(*sides), minlength=rows)
        found[n] = (match, np.maximum(size[:rows] - n + 1, 0), np.maximum(size[rows:] - n + 1, 0))
    return [found[n] for n in ns]


def _ngram_overlap(toks: DataFrame, keys: list[str], ns) -> DataFrame:
    """(keys, n, match, n_pred, n_ref) from token arrays ``p`` and ``r``, a row per order, 0 where there is none.

    Both lists lie in one row, so n-grams are counted where they are; nothing is exploded or shuffled."""
    ns = list(ns)
    counts = ("match", "n_pred", "n_ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, r = batch.column("p"), batch.column("r")
            for first, rows in steps(p, r, most=GRAM_STEP):
                held = [batch.column(k).slice(first, rows) for k in keys]
                for n, cols in zip(ns, _gram_counts(p.slice(first, rows), r.slice(first, rows), ns)):
                    numbers = [pa.array(c.astype(np.int64)) for c in cols]
                    yield pa.RecordBatch.from_arrays([*held, pa.array([n] * rows, pa.int32()), *numbers], names=[*keys, "n", *counts])

    rows = toks.select(*keys, "p", "r")
    kept = [rows.schema[k] for k in keys]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("n", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in counts]]))


def _word_tokens(text) -> Column:
    return F.filter(F.split(strip(F.coalesce(_c(text), F.lit(""))), "\\s+", -1), lambda w: w != "")


def international_tokens(text) -> Column:
    """Words with punctuation and symbols split off: a mark between digits stays in its number."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(\P{N})(\p{P})", "$1 $2 ")
    t = F.regexp_replace(F.regexp_replace(t, r"(\p{P})(\P{N})", " $1 $2"), r"(\p{S})", " $1 ")
    return _word_tokens(t)


def bleu(df: DataFrame, group=("task",), max_n: int = 4, tokens=_word_tokens, smooth: str | None = None) -> DataFrame:
    """Corpus BLEU: clipped n-gram precisions summed over the corpus, brevity penalty.

    All orders are counted in one pass over the rows; only their sums are shuffled. ``smooth="exp"`` halves
    the precision of each further order without a match instead of scoring 0."""
    orders = range(1, max_n + 1)
    toks = df.select(*group, "id", tokens("prediction").alias("p"), tokens("target").alias("r"))
    per = _ngram_overlap(toks, [*group, "id"], orders)
    pick = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    sums = per.groupBy(*group).agg(*[pick(c, n).alias(f"{o}{n}") for n in orders for c, o in (("match", "m"), ("n_pred", "t"), ("n_ref", "r"))])
    logs, zeros = [], F.lit(0)
    for n in orders:
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        zeros = zeros + F.when(m == 0, 1).otherwise(0)
        halved = F.log(1 / (F.pow(F.lit(2.0), zeros) * t)) if smooth == "exp" else F.lit(None).cast("double")
        logs.append(F.when(m > 0, F.log(m / t)).when(t > 0, halved))
    bp = F.when(F.col("t1") >= F.col("r1"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r1") / F.col("t1")))
    total = sum(logs[1:], logs[0])  # null if an order has no match (or no n-gram at all)
    score = F.when((F.col("t1") == 0) | (F.col("m1") == 0) | total.isNull(), F.lit(0.0)).otherwise(bp * F.exp(total / max_n))
    return sums.select(*group, (score * 100).alias("bleu"))


def rouge_ns(df: DataFrame, ns=(1, 2), group=("task",)) -> DataFrame:
    """Mean ROUGE-n F-measures for several n in one pass (n-grams tagged with their order);
    one column ``rouge{n}`` per order. A row too short for an order scores 0 there."""
    t = df.select(*group, "id", rouge_tokens("prediction").alias("p"), rouge_tokens("target").alias("r"))
    per = _ngram_overlap(t, [*group, "id"], ns).withColumn("f1", _f1(F.col("match"), F.col("n_pred"), F.col("n_ref")))
    rows = per.groupBy(*group, "id").agg(*[F.coalesce(F.max(F.when(F.col("n") == n, F.col("f1"))), F.lit(0.0)).alias(f"f{n}") for n in ns])
    return rows.groupBy(*group).agg(*[(F.avg(f"f{n}") * 100).alias(f"rouge{n}") for n in ns])


def rouge_n(df: DataFrame, n: int, group=("task",)) -> DataFrame:
    """Mean ROUGE-n F-measure over rows."""
    return rouge_ns(df, (n,), group)


# ---------------------------------------------------------------------------------------------
# sequence metrics: one dynamic program over many rows at once

_DP_CELLS = 1 << 18  # cells of a batch table; rows of like length share a batch


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _token_codes(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Numbers of the tokens of all lists of ``a``, then of ``b``; equal tokens have equal numbers."""
    both = pa.concat_arrays([a.flatten().cast(pa.large_string()), b.flatten().cast(pa.large_string())])
    return both.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _batches(a: pa.Array, b: pa.Array):
    """Rows in batches of like length as (row numbers, ids of a, ids of b, lengths); padding never matches."""
    sizes = [_sizes(a), _sizes(b)]
    codes = _token_codes(a, b)
    starts = [np.cumsum(sizes[0]) - sizes[0], sizes[0].sum() + np.cumsum(sizes[1]) - sizes[1]]
    order = np.lexsort((sizes[0], sizes[1]))
    longest = np.maximum(sizes[0], sizes[1])[order]
    at = 0
    while at < len(order):
        room = np.maximum.accumulate(longest[at : at + 4096] + 1) * np.arange(1, len(longest[at : at + 4096]) + 1)
        width = max(1, int(np.searchsorted(room, _DP_CELLS, side="right")))
        rows = order[at : at + width]
        at += width
        grids = []
        for side, fill in ((0, -1), (1, -2)):
            n = sizes[side][rows]
            cols = np.arange(max(1, int(n.max())))
            there = cols[None, :] < n[:, None]
            grid = np.full(there.shape, fill, dtype=np.int32)
            grid[there] = codes[(starts[side][rows][:, None] + cols[None, :])[there]]
            grids.append(grid)
        yield rows, grids[0], grids[1], sizes[0][rows], sizes[1][rows]


def _in_steps(step):
    """The function over a bounded number of tokens at a time."""

    def over(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([step(a.slice(at, n), b.slice(at, n)) for at, n in steps(a, b)] or [np.empty(0)]).astype(np.int64), pa.int64())

    return over


def _lcs_batch(a: pa.Array, b: pa.Array) -> np.ndarray:
    """cur[j] = max(prev[j], cur[j-1], prev[j-1] + match), a running maximum along the row."""
    out = np.zeros(len(a), dtype=np.int64)
    for rows, x, y, _, _ in _batches(a, b):
        prev = np.zeros((len(rows), y.shape[1] + 1), dtype=np.int32)
        for i in range(x.shape[1]):
            step = np.maximum(prev[:, 1:], prev[:, :-1] + (x[:, i : i + 1] == y))
            prev[:, 1:] = np.maximum.accumulate(step, axis=1)
        out[rows] = prev[:, -1]
    return out


def _edit_batch(a: pa.Array, b: pa.Array) -> np.ndarray:
    """cur[j] = min(prev[j] + 1, prev[j-1] + differ, cur[j-1] + 1), a running minimum of cur[j] - j."""
    out = np.zeros(len(a), dtype=np.int64)
    for rows, x, y, nx, ny in _batches(a, b):
        j = np.arange(y.shape[1] + 1, dtype=np.int32)
        prev = np.tile(j, (len(rows), 1))
        for i in range(int(nx.max(initial=0))):
            cur = np.empty_like(prev)
            cur[:, 0] = i + 1
            cur[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (x[:, i : i + 1] != y))
            cur = np.minimum.accumulate(cur - j, axis=1) + j
            prev = np.where((i < nx)[:, None], cur, prev)
        out[rows] = prev[np.arange(len(rows)), ny]
    return out


def lcs_length(a, b) -> Column:
    """Longest common subsequence length of two token arrays (Arrow-batched, many rows at once)."""
    return F.arrow_udf(_in_steps(_lcs_batch), "long")(_c(a), _c(b))


def edit_length(a, b) -> Column:
    """Levenshtein distance of two token arrays (Arrow-batched, many rows at once, any vocabulary)."""
    return F.arrow_udf(_in_steps(_edit_batch), "long")(_c(a), _c(b))


def rouge_l(df: DataFrame, group=("task",)) -> DataFrame:
    t = df.select(*group, rouge_tokens("prediction").alias("p"), rouge_tokens("target").alias("r"))
    t = t.withColumn("lcs", lcs_length("p", "r"))
    return t.groupBy(*group).agg((F.avg(_f1(F.col("lcs"), F.size("p"), F.size("r"))) * 100).alias("rougeL"))


def line_sentences(text) -> Column:
    """Sentences as summaries give them: lines, with a line break after a full stop that stands alone."""
    return F.split(F.replace(F.coalesce(_c(text), F.lit("")), F.lit(" . "), F.lit(" .\n")), "\n", -1)


def marked_sentences(text) -> Column:
    """Lines, also cut after a full stop, question or exclamation mark that white space follows."""
    return F.split(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "([.!?])[ \t\n\r]+", "$1\n"), "\n", -1)


def _lcs_positions(ref: list[str], cand: list[str]) -> set[int]:
    """Positions of ``ref`` on a longest common subsequence with ``cand``, followed from the ends: equal
    words are taken, else the last word of ``ref`` goes unless the table is larger with it than without.

    A row of the table is one integer whose bit j is 0 where the row grows at word j of ``cand``."""
    n = len(cand)
    full = (1 << n) - 1
    where: dict[str, int] = {}
    for j, w in enumerate(cand):
        where[w] = where.get(w, 0) | 1 << j
    rows = [full]
    for w in ref:
        v = rows[-1]
        hit = v & where.get(w, 0)
        rows.append(((v + hit) | (v - hit)) & full)
    i, j, kept = len(ref), n, set()
    while i and j:
        left_of = (1 << j) - 1
        if ref[i - 1] == cand[j - 1]:
            i, j = i - 1, j - 1
            kept.add(i)
        elif (rows[i] & left_of).bit_count() < (rows[i - 1] & left_of).bit_count():
            j -= 1
        else:
            i -= 1
    return kept


def _union_hits(refs: pd.Series, cands: pd.Series) -> pd.Series:
    """Words of the reference sentences on a common subsequence with any sentence of the prediction, none
    counted more often than the prediction has it."""
    out = []
    for ref, cand in zip(refs, cands):
        have: dict[str, int] = {}
        for sentence in cand:
            for w in sentence:
                have[w] = have.get(w, 0) + 1
        hits = 0
        for sentence in ref:
            words = list(sentence)
            union: set[int] = set().union(*[_lcs_positions(words, list(c)) for c in cand])
            for i in union:
                if have.get(words[i], 0):
                    have[words[i]] -= 1
                    hits += 1
        out.append(hits)
    return pd.Series(out, dtype="int64")


def rouge_lsum(df: DataFrame, group=("task",), sentences=line_sentences) -> DataFrame:
    """Mean summary-level ROUGE-L F-measure: each sentence of the target is matched with every sentence of
    the prediction, the matched words are united. A row with an empty side scores 0.

    The table of a sentence pair takes a bit per cell, and one table is held at a time."""
    words = lambda text: F.transform(sentences(text), rouge_tokens)
    t = df.select(*group, words("prediction").alias("p"), words("target").alias("r"))
    hits = F.pandas_udf(_union_hits, "long")("r", "p").alias("hits")
    t = t.select(*group, hits, F.size(F.flatten("p")).alias("n_pred"), F.size(F.flatten("r")).alias("n_ref"))
    return t.groupBy(*group).agg((F.avg(_f1(F.col("hits"), F.col("n_pred"), F.col("n_ref"))) * 100).alias("rougeLsum"))


def _corr(x: str, y: str) -> Column:
    """Pearson correlation over rows with both values; null where a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(df: DataFrame, x: str, y: str, group=("task",)) -> DataFrame:
    return df.groupBy(*group).agg((_corr(x, y) * 100).alias("pearson"))


def value_ranks(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """(group, value, rank): 1-based average rank of each distinct value of its group,
    ``(rows with a smaller value) + (ties + 1) / 2``.

    Ties collapse first (count per (group, value), partial aggregation map-side); the running
    count over the distinct values goes over sampled ranges of them, so neither a large group, nor
    a tied value, nor an outlier makes one large task."""
    from ..session import cut_lineage
    from .ordered import ordered_cumsum

    vc = cut_lineage(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__cnt")), "value_counts")
    vc = ordered_cumsum(vc, group, value, "__cnt", "__below")
    return vc.select(*group, value, (F.col("__below") + (F.col("__cnt") + 1) / 2.0).cast("double").alias(out))


def average_ranks(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Rows with the average rank of ``value`` in their group."""
    from ..session import cut_lineage

    extra = []
    if not group:
        df, group, extra = df.withColumn("__all", F.lit(1)), ["__all"], ["__all"]
    return df.join(cut_lineage(value_ranks(df, group, value, out), "ranks"), [*group, value]).drop(*extra)


def spearman(df: DataFrame, x: str, y: str, group=("task",)) -> DataFrame:
    """Pearson correlation of average ranks. The pairs are written once, both columns are ranked as
    one (column, value) table of counts, and the ranks are joined back twice."""
    from ..session import cut_lineage

    g = list(group)
    pairs = cut_lineage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*g, F.col(x).alias("x"), F.col(y).alias("y")), "rank_pairs")
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("double").alias("v")) for c in ("x", "y")]))
    ranks = cut_lineage(value_ranks(pairs.select(*g, sides.alias("s")).select(*g, "s.*"), [*g, "side"], "v", "rank"), "ranks")
    for c in ("x", "y"):
        own = ranks.where(F.col("side") == c).select(*g, F.col("v").alias(c), F.col("rank").alias(f"r{c}"))
        pairs = pairs.withColumn(c, F.col(c).cast("double")).join(own, [*g, c])
    return pairs.groupBy(*g).agg((_corr("rx", "ry") * 100).alias("spearman"))


def auc(df: DataFrame, label: str, score: str, group=("task",)) -> DataFrame:
    """ROC AUC by the rank-sum formula (average ranks for tied scores); null for a one-class task."""
    r = average_ranks(df, list(group), score, "__r")
    s = r.groupBy(*group).agg(
        F.sum(F.when(F.col(label) == 1, F.col("__r")).otherwise(0.0)).alias("rs"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("P"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("N"),
    )
    a = F.try_divide(F.col("rs") - F.col("P") * (F.col("P") + 1) / 2.0, F.col("P") * F.col("N"))
    return s.select(*group, (a * 100).alias("auc"))


def multirc(df: DataFrame, group=("task",), question: str = "question") -> DataFrame:
    """Binary F1 over all answers (a prediction other than "0"/"1" counts as wrong) and exact
    match per question (every answer of the question right)."""
    ok = F.col("prediction").isin("0", "1")
    pred1 = ok & (F.col("prediction") == "1")
    t1 = F.col("target") == "1"
    rows = df.select(*group, question, pred1.alias("p1"), t1.alias("t1"), (ok & (F.col("prediction") == F.col("target"))).alias("right"))
    f1 = rows.groupBy(*group).agg(
        F.sum(F.when(F.col("p1") & F.col("t1"), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p1") & ~F.col("t1"), 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("p1") & F.col("t1"), 1).otherwise(0)).alias("fn"),
    )
    f1 = f1.select(*group, F.when(F.col("tp") == 0, 0.0).otherwise(200.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1a"))
    em = rows.groupBy(*group, question).agg(F.min(F.col("right").cast("int")).alias("q_ok")).groupBy(*group).agg(
        (F.avg("q_ok") * 100).alias("em")
    )
    return f1.join(em, list(group))


def class_f1(df: DataFrame, positive: str, group=("task",)) -> DataFrame:
    """F1 of one class label after strip (e.g. paraphrase detection's F1)."""
    p = strip("prediction") == positive
    t = strip("target") == positive
    s = df.groupBy(*group).agg(
        F.sum(F.when(p & t, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(p & ~t, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~p & t, 1).otherwise(0)).alias("fn"),
    )
    return s.select(*group, F.when(F.col("tp") == 0, 0.0).otherwise(200.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def edit_distance_chars(df: DataFrame, group=("task",)) -> DataFrame:
    """Character Levenshtein distance statistics (min, max, mean, median, total)."""
    d = df.select(*group, F.levenshtein(strip("prediction"), strip("target")).alias("d"))
    return _dist_stats(d, group)


def edit_distance_words(df: DataFrame, group=("task",)) -> DataFrame:
    """Word-level Levenshtein distance statistics."""
    words = lambda c: F.split(strip(c), "\\s+", -1)
    return _dist_stats(df.select(*group, edit_length(words("prediction"), words("target")).alias("d")), group)


def _dist_stats(d: DataFrame, group) -> DataFrame:
    return d.groupBy(*group).agg(
        F.min("d").cast("long").alias("min_distance"),
        F.max("d").cast("long").alias("max_distance"),
        F.avg("d").alias("mean_distance"),
        F.percentile("d", 0.5).alias("median_distance"),
        F.sum("d").cast("long").alias("total_distance"),
    )


def gen_len(df: DataFrame, ids: str, group=("task",)) -> DataFrame:
    return df.groupBy(*group).agg(F.round(F.avg(F.size(F.filter(ids, lambda x: x != 0))), 4).alias("gen_len"))
