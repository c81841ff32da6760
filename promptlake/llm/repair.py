"""Repair of the turn structure of conversations by weighted interval parsing.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``: nothing, or an optional
system turn and then pairs of user and assistant. Its rows in order of turn (nulls first; equal
turns by role and a hash of the text) are edited at least cost: Keep 0, Rerole to user or assistant
3, Delete 4, Insert an empty user or assistant turn 3; a truncated row that is not deleted costs 3
more, a blank row and a repeat (role and text seen earlier in the conversation) must be deleted. Of
the cheapest edits the one whose initials, in order, are least in ASCII is taken: the audit.

The grammar is in Chomsky normal form. Its nonterminals are pairs of states (nothing yet, after the
system turn, after a user turn, after an assistant turn): a span derives (p, q) if its edited rows
lead from p to q. Rules are (p, q) -> (p, r) (r, q), (p, q) -> row, and insertions, which are closed
over at the leaves: a cell holds what the span derives with any insertions around and between. A
cell keeps the minimum (cost, audit) of each nonterminal; equal costs never leave one audit a proper
prefix of another, so least parts make least wholes. As every derivation passes some state r at
every place, one split of a span finds its minimum, and spans of 1, 2, 4, ... rows are combined
bottom-up instead of all spans.

Scale: rows without their texts are dealt by ranges of (conversation, turn, role, hash) and parsed
in segments of at most ``BLOCK`` rows, so a conversation may have any number of rows in any number
of tasks; segments are combined ``FAN`` at a time until one cell is left of each conversation, which
is at most eleven times as long as its audit. The audit is cut at the segments, and texts meet their
edits in one sort by the same ranges. Identical rows are counted before they are dealt.

Defined results: a null role or text counts as one space (so such a text is blank); an empty role
has no legal initial; a null turn sorts first and is no turn in ``gaps``; rows without a
conversation are one conversation; an empty table gives empty tables; only the four columns are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import broadcast_checked
from ..session import cut_lineage

BLOCK = 4096  # rows parsed together
FAN = 64  # cells combined together
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs
_SPACE = " \t\n\v\f\r"  # Fixed value: characters of which a blank text is made

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": [(NOTHING, SYSTEM)], "u": [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
NONTERMINALS = [(p, q) for p in range(4) for q in range(4) if p == q or q > max(p, SYSTEM) or (p, q) in ((NOTHING, SYSTEM), (ASSISTANT, USER))]
_AT = {x: i for i, x in enumerate(NONTERMINALS)}
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in NONTERMINALS]

Cell = list[tuple[int, str] | None]  # per nonterminal


class Repaired(NamedTuple):
    """``report``: per conversation conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``turns``: per turn of a repaired conversation conv_id, position (from 0), role, text."""

    report: DataFrame
    turns: DataFrame


def joined(x: Cell, y: Cell) -> Cell:
    """Cell of a span from the cells of its two parts."""
    out: Cell = []
    for rules in RULES:
        best = None
        for i, j in rules:
            a, b = x[i], y[j]
            if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                here = (a[0] + b[0], a[1] + b[1])
                best = here if best is None or here < best else best
        out.append(best)
    return out


def _cell(derived: list[tuple[tuple[int, int], int, str]]) -> Cell:
    out: Cell = [None] * len(NONTERMINALS)
    for pair, cost, audit in derived:
        i = _AT[pair]
        out[i] = min(out[i] or (cost, audit), (cost, audit))
    return out


def _closure() -> Cell:
    """What insertions alone derive: nothing, one, or a pair of turns (more never lead to another state)."""
    nothing = [((p, p), 0, "") for p in range(4)]
    once = _cell(nothing + [(step, INSERT, "I") for c in "ua" for step in STEPS[c]])
    return reduce(joined, [once, once, once])


INSERTED = _closure()


@cache
def leaf(initial: str, blank: bool, truncated: bool, duplicate: bool, copies: int) -> Cell:
    """Cell of ``copies`` identical rows: all but the first are repeats of it."""
    derived = [((p, p), DELETE * copies, "D" * copies) for p in range(4)]
    if not blank and not duplicate:
        more, rest = CUT * truncated + DELETE * (copies - 1), "D" * (copies - 1)
        derived += [(step, KEEP + more, "K" + rest) for step in STEPS.get(initial, [])]
        derived += [(step, REROLE + more, "R" + rest) for c in "ua" for step in STEPS[c]]
    return joined(joined(INSERTED, _cell(derived)), INSERTED)


def parsed(cells: list[Cell]) -> Cell:
    """Cell of a whole run: spans are combined bottom-up, each length from the one before."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of a conversation: it ends with nothing, or after an assistant turn."""
    return min(x for x in (cell[_AT[NOTHING, NOTHING]], cell[_AT[NOTHING, ASSISTANT]]) if x is not None)


# what is known of a run of rows besides its cell; turns are numbers or null, initials one character
_RUN = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, lowest long, first_initial string, last_initial string"
_CELL = "costs array<long>, audits array<string>"
_NAMES = [f.split()[0] for f in _RUN.split(", ")]


def _legal_pair(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _facts(initial: str, blank: bool, truncated: bool, duplicate: bool, copies: int, turn: int | None) -> dict:
    repeats = copies if duplicate and not blank else 0 if blank else copies - 1
    return {
        "rows": copies,
        "blank": copies * blank,
        "duplicate": repeats,
        "truncated": int(truncated and not blank and not duplicate),
        "illegal": copies - 1,
        "turns": int(turn is not None),
        "first_turn": turn,
        "last_turn": turn,
        "lowest": turn,
        "first_initial": initial,
        "last_initial": initial,
    }


def _with(x: dict, y: dict) -> dict:
    """Facts of a run from those of its two parts."""
    out = {k: x[k] + y[k] for k in _NAMES[:6]}
    out["illegal"] += not _legal_pair(x["last_initial"], y["first_initial"])
    out["turns"] -= x["last_turn"] is not None and x["last_turn"] == y["first_turn"]
    out["lowest"] = y["lowest"] if x["lowest"] is None else x["lowest"]
    return out | {"first_turn": x["first_turn"], "last_turn": y["last_turn"], "first_initial": x["first_initial"], "last_initial": y["last_initial"]}


def _packed(cell: Cell) -> dict:
    return {"costs": [None if x is None else x[0] for x in cell], "audits": [None if x is None else x[1] for x in cell]}


def _unpacked(row: dict) -> Cell:
    return [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)]


def _segments(schema: pa.Schema):
    """Rows in order -> one row per segment: its facts, its cell and its rows."""

    def one(conv, number: int, rows: list[tuple]) -> dict:
        kinds = [r[4:] for r in rows]
        facts = reduce(_with, (_facts(*k, r[1]) for k, r in zip(kinds, rows, strict=True)))
        cells = parsed([leaf(*k) for k in kinds])
        members = [{"turn": r[1], "role": r[2], "mark": r[3], "copies": r[8]} for r in rows]
        return {"conv_id": conv, "segment": number, **facts, **_packed(cells), "members": members}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) == BLOCK):
                    out.append(one(held[0][0], number, held))
                    number, held = number + 1, []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([one(held[0][0], number, held)], schema)

    return run


def _combined(schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("place").to_pylist()
        facts = reduce(_with, ({k: r[k] for k in _NAMES} for r in rows))
        cell = parsed([_unpacked(r) for r in rows])
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "place": rows[0]["place"] // FAN, **facts, **_packed(cell)}], schema)

    return run


def _reports(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost, audit = cheapest(_unpacked(r))
                gaps = 0 if r["lowest"] is None else r["last_turn"] - r["lowest"] + 1 - r["turns"]
                out.append({**{c: r[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")}, "gaps": gaps, "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(audit, [(segment, rows)]) -> per segment its part of the audit, the position of its first turn, whether a system turn leads."""
    for batch in batches:
        for audit, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            edits = audit.replace("I", "")
            leads = (len(audit) - edits.count("D")) % 2 == 1
            at, out, position = 0, [], 0
            for k, s in enumerate(segments):
                end, left = at, s["rows"]
                while left or (k == len(segments) - 1 and end < len(audit)):
                    left -= audit[end] != "I"
                    end += 1
                out.append((s["segment"], audit[at:end], position, leads))
                position += end - at - audit.count("D", at, end)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["segment", "audit", "position", "leads"])


def _edits(schema: pa.Schema):
    """Segments with their part of the audit -> each row that leaves a turn, with its edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                audit, at, position, out = r["audit"], 0, r["position"], []
                for k, m in enumerate(r["members"]):
                    end, left = at, m["copies"]
                    while left or (k == len(r["members"]) - 1 and end < len(audit)):
                        left -= audit[end] != "I"
                        end += 1
                    edits, at = audit[at:end], end
                    if edits.strip("D"):
                        out.append({"conv_id": r["conv_id"], **{c: m[c] for c in ("turn", "role", "mark")}, "edits": edits, "position": position, "leads": r["leads"]})
                        position += len(edits) - edits.count("D")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _turns(schema: pa.Schema):
    """Edits, each followed by the rows it belongs to -> turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edits, position, leads = None, "", 0, False
        for batch in batches:
            out = []
            for conv, turn, role, mark, e, p, lead, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if e is not None:
                    now, edits, position, leads = (conv, turn, role, mark), e, p, lead
                elif now == (conv, turn, role, mark):
                    for x in edits:
                        if x != "D":
                            other = "assistant" if (position + leads) % 2 else "user"
                            out.append({"conv_id": conv, "position": position, "role": role if x == "K" else other, "text": "" if x == "I" else text})
                            position += 1
                    now = None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(ddl: str, conv: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    member = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("mark", pa.binary()), ("copies", pa.int64())]))
    fields = [("conv_id", conv)]
    for name, kind in (f.split(" ", 1) for f in ddl.split(", ")):
        fields.append((name, member if name == "members" else kinds[kind]))
    return pa.schema(fields)


_MEMBERS = "array<struct<turn: long, role: string, mark: binary, copies: long>>"


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Report and repaired turns of the conversations in ``rows``; see the module."""
    from pyspark.sql.pandas.types import to_arrow_type

    conv, kind = to_arrow_type(rows.schema[id_col].dataType), rows.schema[id_col].dataType.simpleString()
    src = rows.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    src = src.withColumn("mark", F.unhex(F.md5("text")))
    bare = F.rtrim("text", F.lit(_SPACE))
    row = ["conv_id", "turn", "role", "mark"]

    def mapped(df: DataFrame, task, ddl: str) -> DataFrame:
        return df.mapInArrow(task(_arrow(ddl, conv)), f"conv_id {kind}, {ddl}".replace("members array", f"members {_MEMBERS}"))

    def both(a: DataFrame, b: DataFrame, on: list[str], how: str = "left") -> DataFrame:
        """Join on equal values, nulls included."""
        b = b.select([F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in b.columns])
        return a.join(b, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]), how).drop(*[f"_{c}" for c in on])

    plain = src.select(*row, (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    counted = cut_lineage(plain.groupBy(*row).agg(F.count(F.lit(1)).alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")), "rows")
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = counted.where("not blank").groupBy("conv_id", "role", "mark").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    faults = both(counted, broadcast_checked(again, "again"), ["conv_id", "role", "mark"])
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial")
    faults = faults.select(*row, initial, "blank", "truncated", F.coalesce(order > F.col("first"), F.lit(False)).alias("duplicate"), "copies")
    ordered = faults.repartitionByRange(*row).sortWithinPartitions(*row)
    segments = cut_lineage(mapped(ordered, _segments, f"segment long, {_RUN}, {_CELL}, members array"), "segments")

    several = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("segment", "rows"))).alias("segments"))
    several = cut_lineage(several, "of_conversation")
    places = several.where("n > 1").select(F.posexplode("segments").alias("place", "at")).select(F.col("place").cast("long").alias("place"), F.col("at.segment").alias("segment"))
    cells = segments.select("conv_id", "segment", *_NAMES, "costs", "audits")
    one = cells.join(places, "segment", "left_anti").drop("segment")
    level = cut_lineage(cells.join(places, "segment").select("conv_id", "place", *_NAMES, "costs", "audits"), "level")
    shape = f"place long, {_RUN}, {_CELL}"
    while (level.agg(F.max("place")).first()[0] or 0) > 0:
        level = level.groupBy("conv_id", F.floor(F.col("place") / FAN)).applyInArrow(_combined(_arrow(shape, conv)), f"conv_id {kind}, {shape}")
        level = cut_lineage(level, "level")
    whole = one.unionByName(level.drop("place"))
    found = "blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"
    report = cut_lineage(mapped(whole, _reports, found), "reports")

    cuts = both(several, report.select("conv_id", "audit"), ["conv_id"], "inner").select("audit", "segments")
    cuts = cuts.mapInArrow(_slices, "segment long, audit string, position long, leads boolean")
    edits = mapped(segments.select("conv_id", "segment", "members").join(cuts, "segment"), _edits, "turn long, role string, mark binary, edits string, position long, leads boolean")
    texts = src.select(*row, *[F.lit(None).cast(k).alias(c) for c, k in (("edits", "string"), ("position", "long"), ("leads", "boolean"))], "text")
    dealt = edits.withColumn("text", F.lit(None).cast("string")).unionByName(texts).repartitionByRange(*row).sortWithinPartitions(*row, F.col("edits").isNull())
    return Repaired(report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), mapped(dealt, _turns, "position long, role string, text string"))


def _digests(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for conv, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), itemgetter(0)):
                for _, position, role, text in rows:
                    if position == 0:
                        if digest is not None:
                            out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                        now, digest = conv, hashlib.sha256()
                    digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], schema)

    return run


def text_digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of the turns of each conversation, ``role:text`` joined by newlines; a stream of sorted rows, a text at a time."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = turns.schema["conv_id"].dataType
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.mapInArrow(_digests(_arrow("repaired_sha256 string", to_arrow_type(kind))), f"conv_id {kind.simpleString()}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of a table of conversations with fixed faults put in; nulls become one space.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes the marks
    ``. ! ?``, 3 repeats it, 4 makes its role user. Other columns go."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    out = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.array_repeat("times", F.col("times")))).drop("times")
