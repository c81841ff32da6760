"""Conversation repair against an exhaustive search and a row-by-row version, segments and odd rows included."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from promptlake.llm import repair as R

TYPES = "conv_id long, turn long, role string, text string, cost int, segment string, place int"
LEGAL = re.compile("(s?(ua)+)?")


def brute_edits(rows):
    """Cheapest (cost, audit) by a search over (rows done, roles so far); rows: (initial, must_delete, truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        state = (i, roles[-1:] if len(roles) > 1 or roles != "s" else "s1", len(roles) == 0)
        if i == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit
        if (state, i) in done:
            continue
        done.add((state, i))

        def add(more, edit, step, role):
            new = roles + role
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + edit, i + step, new))

        for role in "ua":
            add(3, "I", 0, role)
        if i < len(rows):
            initial, must, cut = rows[i]
            add(4, "D", 1, "")
            if not must:
                if initial in "sua":
                    add(3 * cut, "K", 1, initial)
                for role in "ua":
                    add(3 + 3 * cut, "R", 1, role)
    raise AssertionError


def brute(rows):
    """[(conv_id, turn, role, text)] -> {conv_id: report and digest}"""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    for conv, own in by.items():
        own.sort(key=lambda x: (*x[:3], hashlib.md5(x[3].encode()).digest()))
        seen, kinds, n = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            kinds.append((role[:1] or " ", fault in (0, 1), fault == 2))
            if fault is not None:
                n[fault] += 1
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        cost, audit = brute_edits(kinds)
        made, rest = [], iter(own)
        leads = (len(audit) - audit.count("D")) % 2
        for edit in audit:
            _, _, role, text = (None, None, None, "") if edit == "I" else next(rest)
            if edit != "D":
                made.append(f"{role if edit == 'K' else 'user' if (len(made) + leads) % 2 == 0 else 'assistant'}:{text}")
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def _rows():
    r = random.Random(8)
    texts = ["Yes.", "No!", "cut off", "", "  \n", None, "Why? ", "done.\n\t", "a b ", "ends ", "other."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "User", "tool"]
    rows = []
    for conv in [*range(60), None]:
        for t in range(r.randint(1, 9)):
            turn = None if r.random() < 0.1 else t + (t > 5) * 3
            rows.append((conv, turn, r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"text {conv} {t}."))
            if r.random() < 0.15:
                rows.append(rows[-1])
    rows += [(99, None, None, None), (98, 5, "user", "A long one " * 4000 + ".")]
    return rows


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], TYPES).repartition(parts)
    report, turns = R.repair_conversations(df)
    digest = {x.conv_id: x.repaired_sha256 for x in R.text_digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, digest.get(x.conv_id, empty)) for x in report.collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [2, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "FAN", 3)
    check(spark, _rows())


def test_one_long_conversation(spark, monkeypatch):
    """One conversation in many tasks and segments."""
    monkeypatch.setattr(R, "BLOCK", 5)
    monkeypatch.setattr(R, "FAN", 2)
    r = random.Random(3)
    rows = [(7, t // 2, r.choice(["user", "assistant", "system"]), r.choice(["Same.", "cut", f"t{t}."])) for t in range(300)]
    check(spark, rows + [(8, 1, "user", "x.")], 7)


def test_cells_are_cheapest():
    kinds = [(i, m, c) for i in "sua " for m, c in ((False, False), (False, True), (True, False))]
    for rows in itertools.chain(itertools.product(kinds, repeat=2), random.Random(1).sample(list(itertools.product(kinds, repeat=4)), 300)):
        assert R.cheapest(R.parsed([R.leaf(i, False, c, m, 1) for i, m, c in rows])) == brute_edits(list(rows))


def test_empty_table(spark):
    report, turns = R.repair_conversations(spark.createDataFrame([], TYPES))
    assert report.count() == 0 and turns.count() == 0


def test_damage(spark):
    rows = [(c, t, role, text) for c in [*range(30), None] for t in [*range(4), None] for role, text in [("user", "Hi. You?"), (None, None)]]
    want = []
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    key = lambda r: [(x is not None, x) for x in r]
    got = [tuple(x) for x in R.damaged(spark.createDataFrame([(*r, 1, "s", 2) for r in rows], TYPES)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
