"""Token jobs as array expressions: byte/vocab tokenisation, EOS, padding, masks, decoding,
dynamic padding, decoder inputs and the decoder-only / generation feature rows.

Byte mode ids: pad = 0, eos = 1, unk = 2, byte b -> b + 3 (every text is representable).
Vocab mode: pieces found in a vocabulary table get its ids; unknown pieces fall back to
their bytes. ``byte_tokens`` and the array jobs are per-row expressions inside whole-stage codegen;
``byte_tokens_arrow`` and vocab mode tokenise whole Arrow batches at once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Special ids of the byte vocabulary and the label padding sentinel.
PAD = 0
EOS = 1
UNK = 2
BYTE_OFFSET = 3
LABEL_PAD = -100
FIRST_PIECE_ID = BYTE_OFFSET + 256


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bytes_ids(binary) -> Column:
    """Bytes as ids (byte + 3): read as Latin-1 each byte is one character, so they are cut without a pattern."""
    chars = F.split(F.decode(_col(binary), "ISO-8859-1"), "", -1)
    chars = F.slice(chars, 1, F.octet_length(_col(binary)))  # no bytes are split into one empty string
    return F.transform(chars, lambda x: F.ascii(x) + BYTE_OFFSET)


def byte_tokens(text) -> Column:
    """UTF-8 bytes of ``text`` as ids (byte + 3); [] for an empty string, null for null."""
    return bytes_ids(F.encode(_col(text), "UTF-8"))


def _text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 buffer, start of each text in it, and which texts are null."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    null = pc.is_null(text).to_numpy(zero_copy_only=False)
    text = text.fill_null("").cast(pa.large_string())
    _, offs, data = text.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0], null


def _byte_ids(text: pa.Array) -> pa.Array:
    raw, off, null = _text_bytes(text)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(raw.astype(np.int32) + BYTE_OFFSET), mask=pa.array(null))


def byte_tokens_arrow(text) -> Column:
    """``byte_tokens`` over Arrow batches: the ids are the text buffer plus 3, cut at its offsets."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(t: pa.Array) -> pa.Array:
        return _byte_ids(t)

    return ids(_col(text))


def append_eos(ids) -> Column:
    return F.concat(_col(ids), F.array(F.lit(EOS)))


def truncate(ids, length: int) -> Column:
    return F.slice(_col(ids), 1, length)


def pad_to(ids, length, pad: int = PAD) -> Column:
    """Truncate to ``length`` and right-pad with ``pad`` (``length`` may be a Column)."""
    L = length if isinstance(length, Column) else F.lit(length)
    cut = F.slice(_col(ids), 1, L)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(L - F.size(cut), F.lit(0))))


def pad_up(ids, length: int, pad: int = PAD) -> Column:
    """Right-pad to ``length``; longer arrays are kept whole."""
    return pad_to(ids, F.greatest(F.size(_col(ids)), F.lit(length)), pad)


def attention_mask(ids) -> Column:
    return F.transform(_col(ids), lambda x: F.when(x != PAD, 1).otherwise(0))


def mask_labels(ids) -> Column:
    """Padding positions of the labels -> -100 (ignored by the loss)."""
    return F.transform(_col(ids), lambda x: F.when(x == PAD, F.lit(LABEL_PAD)).otherwise(x))


def unmask_labels(ids) -> Column:
    return F.transform(_col(ids), lambda x: F.when(x == LABEL_PAD, F.lit(PAD)).otherwise(x))


def decode_bytes(ids) -> Column:
    """Byte ids -> text, skipping special ids (< 3); invalid UTF-8 is replaced as Java does."""
    char = lambda x: F.when((x >= BYTE_OFFSET) & (x < BYTE_OFFSET + 256), F.char(x - BYTE_OFFSET)).otherwise(F.lit(""))
    latin = F.array_join(F.transform(_col(ids), char), "")
    return F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8")


def non_padding(ids) -> Column:
    """Loss weights: 1 where the position holds a token, 0 on padding."""
    return attention_mask(ids)


def shift_right(ids, segment_ids=None) -> Column:
    """Decoder inputs: targets shifted right by one with 0 first; with segment ids, the first
    position of every new segment is 0 as well (packed rows)."""
    t = _col(ids)
    shifted = F.concat(F.array(F.lit(PAD)), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))))
    shifted = F.when(F.size(t) == 0, t).otherwise(shifted)
    if segment_ids is None:
        return shifted
    s = _col(segment_ids)
    prev = F.concat(F.array(F.lit(None).cast("int")), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    changed = F.zip_with(s, prev, lambda a, b: b.isNull() | (a != b))
    return F.zip_with(shifted, changed, lambda x, f: F.when(f, F.lit(PAD)).otherwise(x))


def prefix_concat(inputs, targets) -> tuple[Column, Column, Column]:
    """Decoder-only rows: targets = inputs ++ targets and two constant-width arrays holding the
    inputs width and the width + 1 (one extra bidirectional position)."""
    i, t = _col(inputs), _col(targets)
    n = F.size(i) + F.size(t)
    return F.concat(i, t), F.array_repeat(F.size(i), n), F.array_repeat(F.size(i) + 1, n)


def causal_attention(width_add_pos: Column) -> Column:
    """1 for positions inside the bidirectional prefix (index < inputs width + 1)."""
    return F.transform(width_add_pos, lambda w, i: F.when(i < w, 1).otherwise(0))


def dynamic_pad(df: DataFrame, ids: str, batch: str = "batch", multiple: int = 8, out: str = "padded") -> DataFrame:
    """Pad every row to the longest row of its batch, rounded up to a multiple of ``multiple``."""
    w = Window.partitionBy(batch)
    L = (F.ceil(F.max(F.size(ids)).over(w) / F.lit(multiple)) * multiple).cast("int")
    return df.withColumn("batch_len", L).withColumn(out, pad_to(ids, F.col("batch_len")))


def ids_text(ids) -> Column:
    """Arrays compared across engines as space-joined strings."""
    return F.array_join(_col(ids), " ")


def _numbers_text(values: pa.Array) -> pa.Array:
    """Whole numbers as text; where they lie close together each is turned into text once."""
    low, high = (x.as_py() for x in pc.min_max(values).values()) if pa.types.is_integer(values.type) else (None, None)
    if low is None or high - low >= len(values):
        return values.cast(pa.string())
    return pa.array(np.arange(low, high + 1)).cast(pa.string()).take(pc.subtract(values, pa.scalar(low, values.type)))


def _joined(ids: pa.Array) -> pa.Array:
    """Lists as space-joined strings, a bounded number of ids at a time; null ids are left out."""
    done = []
    for first, rows in steps(ids):
        part = ids.slice(first, rows)
        values, n = part.flatten(), pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
        if values.null_count:
            owner = np.repeat(np.arange(rows), n)[values.is_valid().to_numpy(zero_copy_only=False)]
            values, n = values.drop_null(), np.bincount(owner, minlength=rows)
        off = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), _numbers_text(values), mask=pc.is_null(part))
        done.append(pc.binary_join(lists, " "))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def ids_text_arrow(ids) -> Column:
    """``ids_text`` made over Arrow batches, for plans whose arrays come out of Python."""

    @F.arrow_udf(T.StringType())
    def text(x: pa.Array) -> pa.Array:
        return _joined(x)

    return text(_col(ids))


# ---------------------------------------------------------------------------------------------
# vocabulary (top pieces) and vocab-mode tokenisation


def words(text) -> Column:
    return F.split(_col(text), " ", -1)


# Items a frequent-items sketch keeps track of, and candidates counted per piece asked for.
TRACKED = 1 << 17
CANDIDATES = 4
SKETCH_TOP = 100_000  # the largest k of the sketch


def pieces_of(df: DataFrame, text: str = "text") -> DataFrame:
    """Every space-separated piece, one row each."""
    return df.select(F.explode(words(text)).alias("piece")).where(F.col("piece") != "")


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Frequency of every space-separated piece (partial aggregation before the shuffle)."""
    return pieces_of(df, text).groupBy("piece").agg(F.count(F.lit(1)).alias("count"))


def top_counts(df: DataFrame, size: int, text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """Exact (piece, count) rows that hold the ``size`` most frequent pieces, ties at the end included.

    A frequent-items sketch (one per task, merged; ``tracked`` items each) names at most ``CANDIDATES *
    size`` pieces, and a second pass counts only those, so what is shuffled does not grow with the
    number of different pieces. The sketch guarantees that a piece it does not name occurs no more
    often than the last it names, or 7 / tracked of all pieces. If the ``size``-th exact count is above
    that, nothing can be missing; otherwise (flat distributions, few pieces) all pieces are counted."""
    from ..session import cut_lineage

    k = min(CANDIDATES * size, SKETCH_TOP)
    pieces = pieces_of(df, text)
    found = pieces.agg(F.expr(f"approx_top_k(piece, {k}, {max(tracked, k)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    top = found["top"] or []
    if len(top) >= size:
        keys = df.sparkSession.createDataFrame([(t["item"],) for t in top], "piece string")
        counts = pieces.join(F.broadcast(keys), "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("count"))  # k rows at most
        counts = cut_lineage(counts, "candidate_counts")
        unnamed = max(top[-1]["count"] if len(top) == k else 0, 7 * found["n"] / max(tracked, k))
        last = counts.orderBy(F.desc("count")).limit(size).agg(F.min("count")).first()[0]
        if last > unnamed:
            return counts
    return piece_counts(df, text)


def build_vocab(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Top ``size`` pieces by (count desc, piece), ids after the specials and the 256 bytes.

    The limit is the feature (a top-k); candidates come from a sketch and are counted exactly."""
    top = top_counts(df, size, text).orderBy(F.col("count").desc(), F.col("piece")).limit(size)
    w = Window.orderBy(F.col("count").desc(), F.col("piece"))
    return top.withColumn("id", (F.row_number().over(w) + FIRST_PIECE_ID - 1).cast("int"))


def _char_histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters of each batch of texts with their counts."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            joined = "".join(t for t in batch.column(0).slice(a, 1024).to_pylist() if t)
            n = np.bincount(np.frombuffer(joined.encode("utf-32-le"), dtype=np.int32))
            code = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in code.tolist()], pa.string()), pa.array(n[code], pa.int64())], names=["ch", "n"])


def char_coverage(df: DataFrame, coverage: float = 0.99999, text: str = "text") -> DataFrame:
    """Characters needed to cover ``coverage`` of all character occurrences (most frequent first).

    Texts become one histogram per 1024 of them inside the task; only those are shuffled. The windows
    run over one row per character."""
    counts = df.select(_col(text)).mapInArrow(_char_histogram, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("count"))
    return covered(counts, coverage)


def covered(counts: DataFrame, coverage: float) -> DataFrame:
    """The most frequent rows of (ch, count) that reach ``coverage`` of all counts."""
    w = Window.orderBy(F.col("count").desc(), F.col("ch"))
    tot = Window.partitionBy()
    return (
        counts.withColumn("cum", F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("count").over(tot))
        .where(F.col("cum") - F.col("count") < F.lit(coverage) * F.col("total"))
        .drop("cum", "total")
    )


# Fixed value: bytes of text, or ids, that a task turns into arrays at a time.
STEP = 1 << 20


def steps(*columns: pa.Array, most: int = STEP) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs whose texts or lists hold about ``most`` bytes or values, a row at least."""
    size = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        length = pc.list_value_length if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length
        size += length(c).fill_null(0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size) // most
    first = np.flatnonzero(np.diff(run, prepend=-1))
    yield from zip(first.tolist(), np.diff(first, append=len(size)).tolist())


def map_in_steps(df: DataFrame, key: str, source, out: str, kind: T.DataType, prepare: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """(key, out): ``source`` turned into another array, a bounded step of an Arrow batch at a time, so that
    what a task holds beside the batch does not follow the batch's rows. ``prepare`` runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = prepare()
        for batch in batches:
            for first, rows in steps(batch.column(1)):
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), convert(part.column(1))], names=[key, out])

    rows = df.select(key, _col(source).alias(out))
    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField(out, kind)]))


def piece_encoder(piece_ids: Callable[[str], list[int]]):
    """Function from an array of texts to their id arrays: the ids of space-separated pieces with a space
    byte between them; ``piece_ids`` is asked once per distinct piece of a batch."""
    sep = ord(" ") + BYTE_OFFSET

    def encode(text: pa.Array) -> pa.Array:
        null = pc.is_null(text)
        pieces = pc.split_pattern(text.fill_null(""), " ")
        where = pieces.offsets.to_numpy().astype(np.int64)
        where = where - where[0]
        coded = pieces.flatten().dictionary_encode()
        each = [piece_ids(p) for p in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        flat = np.fromiter((i for x in each for i in x), dtype=np.int32, count=int(size.sum()))
        code = coded.indices.to_numpy()
        gap = np.ones(len(code), dtype=np.int64)  # a separator before every piece but a text's first
        gap[where[:-1][where[:-1] < where[1:]]] = 0
        ends = np.concatenate(([0], np.cumsum(size[code] + gap)))
        out = np.full(ends[-1], sep, dtype=np.int32)
        begin = ends[:-1] + gap
        at = np.arange(int(size[code].sum())) - np.repeat(np.cumsum(size[code]) - size[code], size[code])
        out[np.repeat(begin, size[code]) + at] = flat[np.repeat((np.cumsum(size) - size)[code], size[code]) + at]
        return pa.ListArray.from_arrays(pa.array(ends[where], pa.int32()), pa.array(out), mask=null)

    return encode


def _vocab_encoder(ids: dict[str, int]):
    """Pieces by their id, others by their bytes."""
    return piece_encoder(lambda p: [ids[p]] if p in ids else [b + BYTE_OFFSET for b in p.encode()])


def vocab_tokenize(df: DataFrame, vocab: DataFrame, key: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Pieces (space separated) -> vocab id, unknown pieces -> their byte ids; a space byte
    token separates pieces. The vocabulary (a top-k of requested size) goes to the tasks as a
    broadcast table; texts are looked up where they are, without a shuffle."""
    table = {r["piece"]: r["id"] for r in vocab.select("piece", "id").collect()}
    shared = df.sparkSession.sparkContext.broadcast(table)
    return map_in_steps(df, key, text, out, T.ArrayType(T.IntegerType()), lambda: _vocab_encoder(shared.value))
