"""Every numbered operator against a brute-force version on a small nasty fixture, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promptlake.session import scratch_path

DOCS = "doc_id long, text string, n_words long, kept boolean, row string, band string, component long"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def _prose(r, n, sep=" "):
    return sep.join("".join(r.choice(["the", "or", "in", "ea", "st", "É"]) for _ in range(r.randint(1, 4))) + r.choice(["", "", ".", ","]) for _ in range(n))


def _texts():
    r = random.Random(11)
    base, passage = _prose(r, 90), _prose(r, 60)
    lines = [_prose(r, 9) + "." for _ in range(8)]
    near = base.split(" ")
    near[40] = "changed"
    far = base.split(" ")
    for i in range(0, 90, 6):
        far[i] = f"w{i}"
    return [
        base, base, " ".join(near), " ".join(far), base.lower(), None, "", "  \n\t ", "one", "one", "two words", "A b c d",
        passage + " " + _prose(r, 30), _prose(r, 25) + "\n" + passage, passage, _prose(r, 3000), _prose(r, 40),
        "\n".join(lines), "\n".join(lines[2:6] + ["other line."]), "\n".join([lines[0], "", lines[1], lines[2]]), "x\nx\nx\nx\nx",
        " ".join(["again and"] * 60), "### %%% &&& " * 12, " | ".join(["home", "about", "news", "contact", "more", "login", "shop"] * 4),
        "Click here to read more.\n" + "\n".join(lines), "\r\n".join(lines), "z" * 5000,
    ]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0]), (None, "null id with a few words of its own")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, True, "r", "b", 1) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def key(row):
    return tuple((x is not None, x) for x in row)


def same(df, cols, want):
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    assert got == sorted(want, key=key)


def shingle_set(t):
    w = words(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows):
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sets, {i: find(i) for i in root}


def test_near_duplicates(docs, rows, none):
    from promptlake.llm.minhash import near_duplicates

    sets, root = brute_components(rows)
    out = near_duplicates(docs).where("doc_id is not null")
    want = [(i, len(s), root[i], root[i] == i) for (i, _), s in zip(rows, sets, strict=True) if i is not None]
    same(out, ["doc_id", "n_shingles", "component_id", "kept"], want)
    assert near_duplicates(docs).where("doc_id is null and kept").count() == 2
    assert near_duplicates(none).count() == 0


def test_near_duplicates_hub_and_hot_group(spark):
    """A hub whose spokes are not similar to each other, and many near copies of one text."""
    from promptlake.llm.minhash import near_duplicates

    r = random.Random(4)
    hub = [f"h{i}" for i in range(120)]
    rows = []
    for s in range(6):  # each spoke replaces another stretch: similar to the hub, less so to each other
        spoke = list(hub)
        spoke[s * 20 : s * 20 + 13] = [f"s{s}_{i}" for i in range(13)]
        rows.append((s, " ".join(spoke)))
    rows.append((50, " ".join(hub)))
    hot = [f"c{i}" for i in range(80)]
    for i in range(150):
        t = list(hot)
        t[r.randrange(80)] = f"e{i}"
        rows.append((100 + i, " ".join(t)))
    rows += [(500 + i, _prose(r, 60) + " " + " ".join(hot[:30])) for i in range(150)]
    sets, root = brute_components(rows)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    same(out, ["doc_id", "component_id"], [(i, root[i]) for i, _ in rows])


def test_sketch_estimate():
    from promptlake.llm.minhash import estimate, sketch

    r = np.random.default_rng(1)
    for n, both in ((400, 300), (400, 50), (30, 25), (2, 1)):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate((a[:both], r.integers(0, 1 << 63, n - both).astype(np.uint64)))
        est = []
        for s in range(30):
            x = sketch(np.concatenate((a, b)) ^ np.uint64(s * 7919), np.repeat([0, 1], n), 2)
            est.append(estimate(x[:1], x[1:], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(est) - both / (2 * n - both)) < 0.06
        merged = sketch(np.concatenate((a, b)), np.zeros(2 * n, dtype=int), 1)
        parts = sketch(np.concatenate((a, b)), np.repeat([0, 1], n), 2)
        assert (merged[0] == parts.max(axis=0)).mean() > 0.97  # equal but for stopped draws above all minima


def test_packing(docs, rows, none):
    from promptlake.llm.packing import pack, pieces_of

    tok = Tokenizer.from_file(BYTE)
    size = 64
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        n = -(-len(ids) // size)
        first = len(ids) - (n - 1) * size
        cuts = [0, *range(first, len(ids) + 1, size)]
        want += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    out = pack(pieces_of(docs, BYTE, "byte", 2, size, with_ids=True), size).cache()
    same(out, ["doc_id", "piece", "start", "length", "ids_crc32"], want)
    seqs = defaultdict(list)
    for r in out.collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    total = sum(w[3] for w in want)
    assert -(-total // size) <= len(seqs) <= -(-total // size) + 3
    assert pack(pieces_of(none, BYTE, "byte", 2)).count() == 0


def test_chat(spark):
    from promptlake.llm.chat import format_chats

    t = "conv_id long, turn long, role string, text string, i long, part string"
    chats = {
        1: [("user", "a"), ("assistant", "b")], 2: [("user", "a"), ("assistant", "b"), ("user", "c")], 3: [("user", "a"), ("assistant", "b"), ("user", "c")],
        4: [("user", "a"), ("assistant", "B")], 5: [(None, None)], 6: [("user", "<|im_end|>")], 7: [("user", f"t{i}") for i in range(2500)], 8: [("user", f"t{i}") for i in range(1100)],
        9: [("user", "b"), ("assistant", "a")],
    }
    rows = [(c, 10 + 2 * k, role, text, 1, "p") for c, turns in chats.items() for k, (role, text) in enumerate(turns)]
    rows += [rows[0], (None, 1, "user", "lost", 1, "p"), (10, None, "system", "s", 1, "p"), (10, 0, "user", "u", 1, "p")]
    chats[10] = [("system", "s"), ("user", "u")]
    keep = {c: x for c, x in chats.items() if not any((d != c and y[: len(x)] == x and (len(y) > len(x) or d < c)) for d, y in chats.items())}
    assert set(keep) == {2, 4, 5, 6, 7, 9, 10}
    want = []
    for c, turns in keep.items():
        done = [f"<|im_start|>{(r or 'user')}\n{(x or '').replace('<|', '< |')}<|im_end|>\n" for r, x in turns]
        want += [(c, p, len(done[p * 1024 : (p + 1) * 1024]), "".join(done[p * 1024 : (p + 1) * 1024])) for p in range(-(-len(done) // 1024))]
    df = spark.createDataFrame(rows, t)
    same(format_chats(df), ["conv_id", "part", "n_turns", "text"], want)
    assert format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_decontamination(spark, docs, rows, none, max_bytes):
    from promptlake.llm.decontam import decontaminate

    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    texts = _texts()
    items = [(1, texts[14]), (10, "ONE"), (9, "two, words!"), (2, None), (3, "..."), (4, " ".join(words(texts[0])[5:17])), (4, "b c d"), (5, "absent words here"), (1, texts[14])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit long")
    want = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for item, x in items:
            v = cut(x)
            k = min(10, len(v))
            for g in {tuple(v[a : a + 10]) for a in range(max(len(v) - 9, 1))} if v else ():
                for p in range(len(w) - k + 1):
                    if tuple(w[p : p + k]) == g:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        if i is not None:
            want.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    out = decontaminate(docs, bench, max_window_bytes=max_bytes).withColumn("i", F.concat_ws(",", "items"))
    same(out.where("doc_id is not null"), ["doc_id", "n_words", "n_hit", "n_items", "i", "contaminated"], want)
    assert out.where("doc_id is null").count() == 2
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_warc(spark):
    from promptlake.llm.warc import read_warc, write_warc

    big, r = "<html>" + "é" * 700, random.Random(3)
    pages = [(i, f"http://x/{i} y", r.choice([big, big + "1", "small", "", None, f"p{i}" * 600])) for i in range(120)]
    pages += [(None, None, big), (500, None, "a\r\n\r\nb" * 400), (501, "http://z", "a\r\n\r\nb" * 400), (120, "u\r\nX: 1", "small"), (7, "again", "twice")]
    df = spark.createDataFrame([(a, b, c, "d") for a, b, c in pages], "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "warc-test")
    out = read_warc(write_warc(df, folder, roll_bytes=3000, shard_bytes=20_000), folder, with_payload=True).cache()
    top = defaultdict(lambda: -1)
    for i, _, t in pages:
        top[t or ""] = max(top[t or ""], -1 if i is None else i)
    want = []
    for i, _, t in pages:
        p = (t or "").encode()
        other = len(p) >= 1000 and top[t or ""] != i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if other else "response", top[t or ""] if other else None, None if other else p))
    got = [tuple(x) for x in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()]
    got = [(*x[:5], None if x[5] is None else bytes(x[5])) for x in got]
    assert sorted(got, key=key) == sorted(want, key=key)
    again = scratch_path(spark, "warc-test")
    names = ["name", "n_records", "bytes", "sha1"]
    one = write_warc(df, folder + "-a", roll_bytes=3000, shard_bytes=20_000).select(*names).collect()
    two = write_warc(df.repartition(5), again, roll_bytes=3000, shard_bytes=20_000).select(*names).collect()
    unique = df.where("page_id <> 7")
    assert sorted(one)[0].name == sorted(two)[0].name and len(one) > 3
    one = write_warc(unique, folder + "-b", roll_bytes=3000, shard_bytes=20_000).select(*names).collect()
    two = write_warc(unique.repartition(5), again + "-b", roll_bytes=3000, shard_bytes=20_000).select(*names).collect()
    assert sorted(one) == sorted(two)
    assert read_warc(write_warc(df.limit(0), folder + "-0"), folder + "-0").count() == 0


@pytest.mark.parametrize("size", [20, None])
def test_cross_entropy_difference(spark, docs, rows, none, monkeypatch, size):
    from promptlake.llm import lmscore
    from promptlake.llm.lmscore import cross_entropy_difference

    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 9000)
    good = {0, 3, 36, 45}
    ids = spark.createDataFrame([(i,) for i in [*good, 0, None, 999]], "doc_id long")
    mu = 10.0
    texts = [(i, words(lower(t))) for i, t in rows]
    count = Counter(w for _, t in texts for w in t)
    vocab = {w: k + 1 for k, (w, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))[: size or len(count)])}
    side = len(vocab) + 2

    def codes(t):
        c = [vocab.get(w, 0) for w in t]
        return list(zip([side - 1, *c], c, strict=False))

    def model(some, scale=1.0):
        pair = Counter(b for t in some for b in codes(t))
        single, context = Counter(), Counter()
        for (v, w), n in pair.items():
            single[w] += n * scale
            context[v] += n * scale
        total = sum(single.values())
        return lambda v, w: math.log((pair[v, w] * scale + mu * (single[w] + 1) / (total + side)) / (context[v] + mu))

    want = {}
    for k, (i, t) in enumerate(texts):
        others = texts[:k] + texts[k + 1 :]
        there = [x for j, x in others if j in good]
        n_all = sum(len(x) for _, x in others)
        background, target = model([x for _, x in others], sum(map(len, there)) / n_all), model(there)
        d = [background(v, w) - target(v, w) for v, w in codes(t)]
        want.setdefault(i, []).append((len(t), i in good, sum(d) / len(d) if d else None))
    for r in cross_entropy_difference(docs, ids, size, mu).collect():
        assert any(n == r.n_tokens and g == r.is_target and (s is None) == (r.score is None) and (s is None or abs(s - r.score) < 1e-9) for n, g, s in want[r.doc_id])
    assert cross_entropy_difference(none, ids).count() == 0
    without = cross_entropy_difference(docs, ids.limit(0))
    assert without.where("score is null").count() == 3 and without.where("abs(score) > 1e-12").count() == 0


@pytest.mark.parametrize("long", [None, 50, 12])
def test_line_dedup(docs, rows, none, long):
    from promptlake.llm.linededup import dedup_lines

    solid = lambda x: x.strip(" \t\r\f\x0b") != ""

    def windows(t):
        own = [(k, x) for k, x in enumerate((t or "").split("\n")) if solid(x)] if t is not None else []
        n = [0 if long is None else len(words(x)) for _, x in own]
        for a in range(len(own)):
            for size in (1, 2, 3) if long is not None else (3,):
                z = a + size
                if z <= len(own) and (size == 3 or sum(n[a:z]) > long) and (long is None or sum(n[a : z - 1]) <= long or sum(n[a + 1 : z]) <= long):
                    yield [k for k, _ in own[a:z]], tuple(x for _, x in own[a:z])

    places, kept = defaultdict(set), {}
    for i, t in rows:
        for at, run in windows(t):
            places[run].add((-1 if i is None else i, at[0]))
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = {k for at, run in windows(t) if min(places[run]) < (-1 if i is None else i, at[0]) for k in at}
        gone = gone if i is not None else set()
        kept[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append((i, None if t is None else kept[i], 0 if t is None else sum(map(solid, lines)), len(gone)))
    out = dedup_lines(docs, words=long)
    same(out, ["doc_id", "text", "n_lines", "n_removed"], want)
    assert out.select("row.*").columns == ["doc_id", "n_words", "kept", "row", "band", "component"]
    assert sum(w[3] for w in want) > 5 and dedup_lines(none, words=long).count() == 0


def test_id_files(docs, rows, none):
    from promptlake.llm._files import fs_of
    from promptlake.llm.bitpack import IdFile, read_ids, write_ids

    folder = scratch_path(docs.sparkSession, "ids-test")
    manifest = write_ids(docs, folder, WORD, "space", 49_408, 2, block_ids=64, file_ids=500, shard_bytes=4000)
    got = sorted((tuple(r) for r in read_ids(manifest, folder, with_ids=True).collect()), key=lambda r: r[1])
    tok = Tokenizer.from_file(WORD)
    left = Counter()
    for i, t in rows:
        left[i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    at, last = 0, -math.inf
    for i, start, n, crc, ids in got:
        order = -math.inf if i is None else i
        assert start == at and n == len(ids) and order >= last and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        left[i, tuple(ids)] -= 1
        at, last = at + n, order
    assert not +left and not -left and manifest.count() > 5
    name = manifest.orderBy("name").first()["name"]
    fs, root = fs_of(folder)
    f = IdFile(fs, f"{root}/{name}")
    assert (f.bits, f.n_ids) == (16, int(f.doc_at[-1]))
    for a, b in ((0, 1), (63, 65), (0, f.n_ids), (5, 5), (f.n_ids - 1, f.n_ids)):
        assert (f.read(a, b) == f.read(0, f.n_ids)[a:b]).all()
    assert (f.document(0) == f.read(0, int(f.doc_at[1]))).all()
    assert read_ids(write_ids(none, folder + "-0", WORD, "space", 49_408, 2), folder + "-0").count() == 0


def brute_quality(t):
    from promptlake.llm import quality as Q

    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {p for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lost = 0
    for x in lines:
        v = words(x)
        seps = sum(c in "|»›•·" for c in x)
        fails = not any(c in ".!?…。！？" for c in x) or 10 * sum(c in "#*$%&|<>" for c in x) > sum(map(len, v))
        fails |= seps >= 3 and 4 * seps >= len(v)
        fails |= len(v) <= 25 and bool(re.search(Q.BOILERPLATE, x, re.I))
        lost += len(v) * fails
    base = len(w) < 20 or 100 * len(again) > 30 * len(w)
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(again), base, not base and 2 * lost <= len(w)


def test_quality(docs, rows, none):
    from promptlake.llm.quality import quality

    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = quality(docs, with_row=True)
    same(out, cols, [(i, *brute_quality(t)) for i, t in rows])
    got = {r.doc_id: r.clean_text for r in out.where("doc_id is not null").collect()}
    assert not got[72].startswith("Click") and got[51] == dict(rows)[51]
    assert out.select("row.*").columns == ["doc_id", "n_words", "kept", "row", "band", "component"]
    assert quality(none).count() == 0


def brute_substrings(rows, size):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - size + 1):
            g = tuple(w[a : a + size])
            first[g] = min(first.get(g, math.inf), math.inf if i is None else i)
    for i, t in rows:
        w = words(t)
        gone = {p for a in range(len(w) - size + 1) if first[tuple(w[a : a + size])] < (math.inf if i is None else i) for p in range(a, a + size)}
        yield i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)


@pytest.mark.parametrize("hot", [4000, 1])
def test_substrings(docs, rows, none, hot):
    from promptlake.llm.substring import dedup_substrings

    out = dedup_substrings(docs, shard_segments=20, hot_segments=hot)
    same(out, ["doc_id", "n_words", "n_removed", "kept_text"], list(brute_substrings(rows, 13)))
    if hot == 1:
        assert dedup_substrings(none).count() == 0


def test_cross_entropy_difference_scores_rare_words(spark):
    """Every word is a word of the models, not only the 1022 most frequent ones."""
    from promptlake.llm.lmscore import cross_entropy_difference

    common = " ".join(f"c{i}" for i in range(1500) for _ in range(3))
    rows = [(0, common), (1, "rare gold words"), (2, "rare gold words"), (3, "rare dull words"), (4, "rare dull words")]
    got = {r.doc_id: r.score for r in cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert got[2] < got[4] - 0.001


def test_cross_entropy_difference_held_out_targets_score_alike(spark):
    """A target document scores as it would if it were not named as one."""
    from promptlake.llm.lmscore import cross_entropy_difference

    r = random.Random(7)
    kinds = [[f"{c}{i}" for i in range(60)] for c in "gb"]
    rows = [(i, " ".join(r.choice(kinds[i % 2]) for _ in range(80))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = [i for i in range(0, 80, 2) if i % 8]
    got = [{x.doc_id: x.score for x in cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in some], "doc_id long")).collect()} for some in (named, [*named, 0])]
    held_in, held_out = [got[0][i] for i in named], [got[0][i] for i in range(0, 80, 8)]
    assert abs(sum(held_in) / len(held_in) - sum(held_out) / len(held_out)) < 0.05 and abs(got[0][0] - got[1][0]) < 1e-2
    assert max(held_out) < min(got[0][i] for i in range(1, 80, 2))


def test_line_dedup_finds_long_passages_on_few_lines(spark):
    """A repeated passage of over 50 words goes, also from one or two lines, to its last short line."""
    from promptlake.llm.linededup import dedup_lines

    long = " ".join(f"w{i}" for i in range(52))
    half, rest = (" ".join(f"{x}{i}" for i in range(30)) for x in "hr")
    rows = [
        (0, long), (1, "own start\n" + long + "\nown end"), (2, half + "\n" + rest + "\nfirst"), (3, "other\n" + half + "\n\n" + rest + "\nsecond"),
        (4, long + "\ntail"), (5, "new\n" + long + "\ntail\nnew end"), (6, half + "\nalone"), (7, " ".join(f"w{i}" for i in range(50))),
        (8, "a\nb\nc\n" + rest), (9, "z\na\nb\nc\ny"), (10, long + "\nx\ny"), (11, long + "\nx\ny\nq"),
    ]
    want = {0: long, 1: "own start\nown end", 2: rows[2][1], 3: "other\n\nsecond", 4: "tail", 5: "new\nnew end", 6: rows[6][1], 7: rows[7][1], 8: rows[8][1], 9: "z\ny", 10: "x\ny", 11: "q"}
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), words=50).collect()}
    assert got == want


def test_substrings_hot_windows_are_one_row_each(spark, monkeypatch):
    """A phrase in many surroundings is reduced to one row before its first document is looked up."""
    from promptlake.llm import substring

    tables = {}
    cut = substring.cut_lineage
    monkeypatch.setattr(substring, "cut_lineage", lambda df, name: tables.setdefault(name, cut(df, name)))
    phrase = " ".join(f"p{i}" for i in range(14))
    rows = [(i, f"a{i} b{i} {phrase} c{i} d{i}") for i in range(60)]
    out = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), hot_segments=5)
    same(out, ["doc_id", "n_words", "n_removed", "kept_text"], list(brute_substrings(rows, 13)))
    firsts = tables["hot_firsts"]
    assert firsts.where("first = 0").count() >= 2 and firsts.count() == firsts.select("k1", "k2").distinct().count()


def test_near_duplicate_margin():
    """The estimate drops a pair at the threshold no more often than the bands (registers taken as independent)."""
    from promptlake.llm.minhash import MARGIN, M

    below = sum(math.comb(M, k) * 0.75**k * 0.25 ** (M - k) for k in range(math.ceil(M * (0.75 - MARGIN))))
    assert below < 6e-6
