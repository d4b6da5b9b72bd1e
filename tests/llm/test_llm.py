"""Operators for training data against brute force, and their defined edge cases."""

import hashlib
import itertools
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import (blobs, chat_format, components, decontaminate, merging, ngram_join, packing, pii, quality_mil,
                            quality_rules, queries, scratch, sstable, suffix_dedup, tokens, warc)

DOCS = "doc_id long, text string, part string, kind string, n long, h string"
DATA = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Documents with further columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "p", None, 7, "h") for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows, base = [], [words(rng, 120) for _ in range(5)]
    for i in range(150):
        b = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            b[rng.randrange(len(b))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(b) if i % 3 else words(rng, rng.randrange(1, 60))))
    return rows + [(150, None), (151, ""), (152, " \n "), (153, "one two"), (154, "ONE\ttwo"), (155, rows[1][1]), (156, rows[1][1].upper())]


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_join_equals_brute_force(spark, corpus):
    sets = shingle_sets(corpus)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, corpus)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_join_counts_every_link(spark, corpus, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    copies = [(100000 + k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for k in range(0, 60, 3)]
    rows = [*corpus, *copies, (200000, copies[1][1]), (200001, copies[1][1].upper())]
    sets = shingle_sets(rows)
    want = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 75 * len(sets[a] | sets[b]):
            want[a] += 1
            want[b] += 1
    for block in (512, 7):  # in one block, and in several
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = {r.doc_id: r.n_links for r in ngram_join.jaccard_components(docs(spark, rows)).collect()}
        assert got == want


def test_join_moves_all_sets_to_their_classes_once(spark, corpus, monkeypatch):
    seen, stage = [], scratch.stage

    def spy(df, name):
        seen.append((name, any("/quill-sets-" in f for f in df.inputFiles())))
        return stage(df, name)

    monkeypatch.setattr(scratch, "stage", spy)
    ngram_join.jaccard_components(docs(spark, corpus))
    assert [name for name, reads in seen if reads and name != "classes"] == ["reps"]


def test_stage_through_leaves_nothing_between(spark):
    def staged():
        return {p.name for p in pathlib.Path(scratch.base_dir(spark).removeprefix("file://")).glob("quill-*")}

    kept = staged()
    out = scratch.stage_through(spark.range(10), "between", lambda x: x.filter("id > 6"), "after")
    assert sorted(r.id for r in out.collect()) == [7, 8, 9]
    assert [n.split("-")[1] for n in staged() - kept] == ["after"]


def test_join_edges(spark):
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    got = ngram_join.jaccard_components(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 2, 1), (2, 0, 2)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[kind], t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab1.2@-+ 45(6)7.é😀\n0%_") for _ in range(rng.randrange(200)))) for i in range(400)]
    rows += [(2000, "4" * 30000), (2001, None), (2002, ""), (2003, "a" * 40000 + "@"), (2004, "4111 1111 1111 1111 +1 (988) 555-2485😀a@b.c_d@x.y 1.2.3.4.5.6.7.8 256.1.1.1")]
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert got == {i: base_spans(t) for i, t in rows}
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_pii_bootstrap_and_redaction(spark):
    rows = [(i, f"x phone: +1 (988) 555-{1000 + i} y") for i in range(8)] + [(50, "my Phone: 555-123-9876 z"), (51, "size: 555125551 and"), (52, None)]
    got = {r.doc_id: r.added for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert [tuple(x) for x in got[50]] == [(10, 3, 22)] and not got[51] and not got[52]
    d = docs(spark, rows)
    out = pii.redact(d)
    assert out.columns == d.columns
    t = {r.doc_id: r.text for r in out.collect()}
    assert t[50] == "my Phone: [PHONE] z" and t[0] == "x phone: [PHONE] y" and t[51] == rows[9][1] and t[52] is None


IDENTIFIER = re.compile(pii.IDENTIFIER.replace(r"\G", r"(?!)"))


def bootstrap(rows):
    """The bootstrap by dictionaries: added spans by document."""
    found, graph = [], {}
    for i, t in rows:
        t, base = t or "", base_spans(t)
        cut = [m for m in IDENTIFIER.finditer(t)]
        for n, m in enumerate(cut):
            v = m[0].rstrip(".!?(+/-")
            s, e = m.start(), m.start() + len(v)
            before = t[cut[n - 1].end() if n else 0 : s][-pii.CONTEXT :].lower()
            after = t[m.end() : cut[n + 1].start() if n + 1 < len(cut) else len(t)][: pii.CONTEXT].lower()
            kinds = [k for a, k, b in base if a < e and s < b]
            ps = []
            if x := re.search(r"([^\W\d]{2,})[ ]?[:=#][ ]?[\"']?$", before):
                ps.append("label " + x[1])
            if x := re.search(r"(?:^|\s)(\S+\s+\S+)\s+$", before):
                ps.append("after " + re.sub(r"\s+", " ", x[1]))
            x, y = re.search(r"(?:^|\s)(\S+)\s+$", before), re.match(r"\s+(\S+)", after)
            if x and y:
                ps.append(f"between {x[1]} {y[1]}")
            found.append((i, s, e, v, bool(kinds), ps))
            for p in ps:
                old = graph.get((p, v))
                graph[p, v] = max([k for k in (old, kinds[0] if kinds else None) if k is not None], default=None)
    seeds = {}
    for (_, v), k in graph.items():
        if k is not None:
            seeds[v] = max(seeds.get(v, -1), k)
    known = {v: (k, 1.0) for v, k in seeds.items()}
    good = {}
    shaped = lambda v, k: (k == 0) == ("@" in v)
    for _ in range(pii.ROUNDS):
        by = {}
        for p, v in graph:
            by.setdefault(p, []).append(known.get(v))
        good = {}
        for p, xs in by.items():
            score, k = max((sum(x[1] for x in xs if x and x[0] == k), -k) for k in range(4))
            support = sum(1 for x in xs if x and x[0] == -k and x[1] >= pii.ACCEPT)
            if score / (len(xs) + 1) >= pii.ACCEPT and support >= pii.MIN_SUPPORT:
                good[p] = (score / (len(xs) + 1), k)
        new = {}
        for (p, v), k in graph.items():
            if k is None and v not in seeds and p in good and shaped(v, -good[p][1]):
                new[v] = max(new.get(v, (-1, 0)), good[p])
        known = {v: (k, 1.0) for v, k in seeds.items()} | {v: (-k, x) for v, (x, k) in new.items()}
    out = {i: set() for i, _ in rows}
    for i, s, e, v, seed, ps in found:
        hits = [good[p] for p in ps if p in good and shaped(v, -good[p][1])]
        if hits and not seed:
            out[i].add((s, -max(hits)[1], e))
    return {i: sorted(x) for i, x in out.items()}


def test_pii_bootstrap_equals_brute_force(spark):
    rng = random.Random(9)
    value = [lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: f"{rng.randrange(100, 999)}-555-{rng.randrange(1000, 9999)}", lambda: f"u{rng.randrange(99)}@h{rng.randrange(9)}.org",
             lambda: f"u{rng.randrange(99)}@local", lambda: f"{rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(256)}", lambda: f"{rng.randrange(256)}.{rng.randrange(999)}.1.{rng.randrange(99)}", lambda: str(rng.randrange(10**6, 10**9))]
    context = [("call me at ", " today", [0, 0, 0, 1]), ("Phone: ", " or", [0, 0, 1]), ("mail me under ", " please", [2, 2, 3]), ("host= ", ".", [4, 4, 4, 5]), ("the number is ", " so", [6, 0]), ("see also ", ", and", range(7)), ("reach x via ", " now", [1, 1, 0])]
    rows = []
    for i in range(250):
        t = ""
        for _ in range(rng.randrange(4)):
            a, b, kinds = rng.choice(context)
            t += rng.choice(["", "some words é ", "\n"]) + a + value[rng.choice(list(kinds))]() + b + " "
        rows.append((i, t))
    got = {r.doc_id: [tuple(x) for x in r.added] for r in pii.find_personal_data(docs(spark, rows)).collect()}
    want = bootstrap(rows)
    assert got == want and sum(map(len, want.values())) > 20


def test_pii_redacts_each_row_by_its_own_text(spark):
    long = "é" * 5000 + " 1.2.3.4 " + "b" * 5000 + " a@b.co"
    rows = [(1, "zz bob@x.org i"), (1, "far far ... carol@y.org"), (None, "x dan@z.org"), (3, None), (4, ""), (5, long)]
    got = sorted((r.doc_id or 0, r.text or "") for r in pii.redact(docs(spark, rows)).collect())
    assert got == sorted([(1, "zz [EMAIL] i"), (1, "far far ... [EMAIL]"), (0, "x [EMAIL]"), (3, ""), (4, ""), (5, long.replace("1.2.3.4", "[IP]").replace("a@b.co", "[EMAIL]"))])
    assert pii.redact(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["ref: 12 " + "34 " * 10**6, "@" * 10**6, "+1" + "(" * 10**6, "1" * 10**6, " ".join(f"phone: 555-1{k:06d}," for k in range(20000)), "a@b.c," * 20000])
def test_pii_survives_long_texts(spark, text):
    out = pii.redact(docs(spark, [(1, text)])).first().text
    assert out == text.replace("a@b.c", "[EMAIL]")


def noisy(rng, t, rate):
    x = list(t)
    for _ in range(int(rate * len(x))):
        p, o = rng.randrange(len(x)), rng.random()
        if o < 0.34:
            del x[p]
        elif o < 0.67:
            x.insert(p, rng.choice("abcdefgh"))
        else:
            x[p] = rng.choice("abcdefgh")
    return "".join(x)


def test_decontamination(spark):
    rng = random.Random(5)
    syl = "the and ing er ous tion re in th ea".split()
    text = lambda n: " ".join("".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    items = [(i, text(30)) for i in range(30)] + [(98, "short item"), (99, None)]
    rows, want = [], set()
    for k, (i, t) in enumerate(items[:30] * 4):
        rows.append((k, text(60) + " " + noisy(rng, t, [0, 0.02, 0.06, 0.1][k % 4]) + " " + text(40)))
        want.add((k, i))
    rows += [(900 + k, text(150)) for k in range(30)] + [(990, "a short  ITEM here"), (991, None), (992, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), b).collect()}
    assert {x for x in got if x[0] >= 900} == {(990, 98)}
    near = {(k, i) for k, t in rows for i, x in items[:30] if t and decontaminate.distance(x.encode(), t.encode()) <= decontaminate.EDITS * len(x)}
    assert want <= near and {x for x in got if x[0] < 900} <= near and len(got & near) >= 0.98 * len(near)
    assert decontaminate.contaminated(empty(spark), b).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), b.limit(0)).count() == 0


def test_decontamination_accepts_a_fifth_of_edits(spark):
    item = " ".join("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split())
    changed = list(item)
    for p in range(60, 60 + int(0.18 * len(item))):  # 18 % in one place: every key of the rest still agrees
        changed[p] = "#"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, [(1, "before it " + "".join(changed) + " after it"), (2, "nothing here")]), b).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(1, 1, int(0.18 * len(item)))]


@pytest.mark.parametrize("size", [10, 15, 20, 30, 45, 63, 64, 70, 85, 110, 150, 230])
def test_decontamination_recall_in_every_length_band(size):
    rng = random.Random(11)
    syl = "the and ing er ous tion re in th ea".split()
    items = [(k, " ".join("".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(90))[:size].strip().encode()) for k in range(100)]
    index = decontaminate.Index(items)
    for rate in (0.05, 0.1, 0.13, 0.15, 0.2):
        texts = [b"some words " + noisy(rng, t.decode(), rate).encode() + b" more words" for _, t in items]
        want = {(k, k) for k, t in items if decontaminate.distance(t, texts[k]) <= int(decontaminate.EDITS * len(t))}
        got = {(i, k): n for i, k, n in index.search(list(range(100)), texts)}
        assert len(want & set(got)) >= decontaminate.TARGET * len(want) and all(n <= decontaminate.EDITS * len(items[k][1]) for (_, k), n in got.items())


def test_decontamination_edges(spark):
    b = spark.createDataFrame([(1, "yes"), (2, "an item of a dozen words or so that stands in some text twice over"), (2, "an item of a dozen words or so that stands in some text twice over"), (None, "x"), (4, "  ")], "item_id long, text string")
    rows = [(1, "eyes"), (2, "oh YES sir"), (3, "An item  of a dozen words\nor so that stands in some text twice over"), (3, "and again"), (None, "yes"), (5, "é" * 100000)]
    got = decontaminate.contaminated(docs(spark, rows), b).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(2, 1, 0), (3, 2, 0)}


def test_many_distances():
    rng = random.Random(4)
    for _ in range(100):
        items = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 200))) for _ in range(3)]
        t = bytes(rng.choice(b"abc") for _ in range(300))
        lo = np.array([rng.randrange(100) for _ in items])
        hi = lo + np.array([rng.randrange(200) for _ in items])
        which = np.arange(3)
        want = np.array([decontaminate.distance(x, t[a:b]) for x, a, b in zip(items, lo, hi)])
        buf = np.frombuffer(t, np.uint8)
        assert (decontaminate.distances(items, which, buf, lo, hi) == want).all()


def test_edit_distance():
    rng = random.Random(2)

    def slow(a, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(t):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(300):
        a, t = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, n))) for n in (12, 30))
        assert decontaminate.distance(a, t) == slow(a, t)


def test_differencing():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randrange(1, 1025) for _ in range(rng.randrange(1, 300))]
        w = packing.windows(sizes)
        assert sorted(i for x in w for i in x) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in x) for x in w) <= packing.CAPACITY
    sums = [sum(x) for x in ([[8, 7, 6, 5, 4][i] for i in w] for w in packing.difference([8, 7, 6, 5, 4], 2))]
    assert max(sums) - min(sums) <= 2


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


ODD = ["x<|endoftext|>y", " <|endoftext|> <|startoftext|>é", "<|ENDOFTEXT|> a", "a  b", " x", "x ", "a \n b", "é\n\n  c  ", "don't  'S <|endoftext|> x<|endoftext|>", "", "  ", "tab\t x", "\n x", "Word, Word. ΑΣ Σ İx é", "a" * 5000, "z   q", None]


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_same_ids(name, space):
    import public_tokenizers

    e = tokens.Encoder(public_tokenizers.path(name), space)
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab ,.\n\té'1😀A") for _ in range(60)) for _ in range(800)]
    for part in (texts, texts[::-1]):
        want = [np.array(x.ids, "<u4").tobytes() for x in library(name).encode_batch(part, add_special_tokens=False)]
        assert e.encode(part) == want


def test_packing_many_pieces():
    import time

    import pandas as pd

    n = 20000
    rng = random.Random(3)
    pdf = pd.DataFrame({"grp": 7, "doc_id": range(n), "start": 0, "length": [rng.randrange(1, 1025) for _ in range(n)], "ids": b"", "doc_tokens": 1})
    began = time.time()
    out = packing._pack(4096)(pdf)
    assert time.time() - began < 30 and out.groupby("sequence_id").length.sum().max() <= 4096 and len(out) == n
    assert out.length.sum() >= 0.95 * 4096 * out.sequence_id.nunique()


def test_packing_pieces(spark, corpus):
    rows = corpus + [(900 + k, t) for k, t in enumerate(ODD)] + [(990, words(random.Random(1), 9000))]
    got = packing.pack(docs(spark, rows), packing.word_pieces_path()).collect()
    t = library("word_bpe_49k.json")
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        p = sorted(by[i], key=lambda r: r.start)
        assert [r.start for r in p] == [0, *itertools.accumulate(r.length for r in p)][:-1]
        assert np.frombuffer(b"".join(r.ids for r in p), "<u4").tolist() == ids and {r.doc_tokens for r in p} == {len(ids)}
    for p in seq.values():
        p.sort(key=lambda r: r.offset)
        assert [r.offset for r in p] == [0, *itertools.accumulate(r.length for r in p)][:-1] and sum(r.length for r in p) <= 4096
    assert packing.pack(empty(spark), packing.word_pieces_path()).count() == 0


def test_classifier_learns(spark):
    out = quality_mil.op5_quality_mil(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95
    assert ((out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)) == out.held_out).all()


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int")
    d = docs(spark, [(1, None), (2, ""), (3, "x" * 300000)]).select("doc_id", "text")
    m = quality_mil.train(d, labels)
    assert m.n_bags == 0
    assert [r.score for r in quality_mil.score(d, m).collect()] == [0.5] * 3
    assert quality_mil.score(empty(spark).select("doc_id", "text"), m).count() == 0


def test_classifier_survives_long_texts_and_clashing_columns(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 40) if i % 2 else "# $ % " * 40) for i in range(200)] + [(999, "long text " * 400000), (7, "")]
    d = spark.createDataFrame([(i, t, i % 3, "x") for i, t in rows], "doc_id long, text string, label int, bag string")
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(150)] + [(999, 1, "t"), (3, 1, "t"), (5000, 0, "t"), (4, 0, "t"), (4, 0, "t")], "doc_id long, label int, text string")
    m = quality_mil.train(d, labels)
    got = {r.doc_id: r.score for r in quality_mil.score(d, m).collect()}
    assert m.n_bags == 151 and all((got[i] >= 0.5) == bool(i % 2) for i in range(150, 200))


def removed(rows, width=200):
    count = Counter(t[s : s + width] for _, t in rows for s in range(len(t) - width + 1))
    out = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if count[t[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        out[i] = (len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(c for c, g in zip(t, gone) if not g))
    return out


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(600)), "x" * 900, "abc" * 300, "é" * 300]
    rows = [(-1, None), (-2, "q" * 199), (-3, "q" * 200)]
    for i in range(90):
        t = "".join(rng.choice("abcd ") for _ in range(rng.randrange(300)))
        for _ in range(rng.randrange(3)):
            s, a = rng.choice(base), rng.randrange(400)
            t += s[a : a + rng.randrange(150, 260)] + "".join(rng.choice("abcdé ") for _ in range(rng.randrange(50)))
        rows.append((i, t))
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == removed([(i, (t or "").encode()) for i, t in rows])
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_gram_hashes_spread_over_parts():
    """Anchors have the least hashes of their spans; the parts of their exchange still hold alike."""
    rng = random.Random(3)
    batch = pd.DataFrame({"doc_id": range(40), "text": [rng.randbytes(20_000) for _ in range(40)]})
    size = Counter()
    for out in suffix_dedup._grams(16)(iter([batch])):
        size.update(dict(out[out["kind"] == suffix_dedup.X.SINGLE].groupby("part")["b"].apply(lambda b: sum(map(len, b)))))
    assert len(size) == 16 and max(size.values()) < 1.3 * min(size.values())


def test_merges():
    rng = random.Random(6)
    for _ in range(60):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(20))) for _ in range(rng.randrange(6))]
        every = sorted(x for r in runs for x in r)
        assert list(merging.LoserTree(runs)) == every
        out = list(merging.lcp_merge([iter([(n, x, None) for n, x in zip(*merging.front_code(r))]) for r in runs]))
        assert [x for _, x, _ in out] == every
        assert [n for n, _, _ in out] == [merging.common(a, b) for a, b in zip([b"", *every], every)]


def test_rules(spark):
    rows = [(1, None), (2, "a b"), (3, words(random.Random(1), 50)), (4, "one two three four five six " * 30), (5, " ".join(["# $ %"] * 20)), (6, "same line here\n" * 12), (3, words(random.Random(1), 50))]
    got = {r.doc_id: r for r in quality_rules.rule_report(docs(spark, rows)).collect()}
    assert not got[1].kept and got[1].n_words == 0 and got[3].kept and got[4].n_repeat_words == 180 and got[4].base_failed
    assert got[6].n_dup_lines == 11 and not got[6].kept
    d = docs(spark, rows)
    a = quality_rules.apply_rules(d)
    assert a.count() == 7 and {r.doc_id for r in a.filter("rejected_by is null").collect()} == {3}
    assert quality_rules.rule_report(empty(spark)).count() == 0


def test_tables(spark, corpus, tmp_path):
    rows = corpus + [(-5, "neg"), (2**40, "far"), (901, None), (902, "x<|endoftext|>y"), (903, "w " * 2000)]
    out = scratch.new_dir(spark, "t")
    sstable.write_tables(docs(spark, rows), out, sstable.byte_pieces_path())
    got = {r.doc_id: r for r in sstable.read_tables(spark, out).collect()}
    e, at = library("byte_bpe_50k.json"), 0
    for i, t in sorted(rows):
        ids = e.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, np.frombuffer(got[i].ids, "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    shards = sstable.Shards(spark, out)
    before = shards.files.n_read
    for i in (-5, 2**40, 902, 0, 155):
        assert shards.get(i).tolist() == np.frombuffer(got[i].ids, "<u4").tolist()
    assert shards.get(123456) is None and shards.get(-10**9) is None and shards.files.n_read - before < 8 * (sstable.BLOCK + 20000)
    found = [sstable.Table.of(x) for r in blobs.read_blobs(spark, out).collect() for x in sstable.tables(bytes(r.content))]
    hit = [t.get(2**40) for t in found]
    assert sum(x is not None for x in hit) == 1 and all(t.get(123456) is None for t in found)
    out = scratch.new_dir(spark, "t")
    sstable.write_tables(empty(spark), out, sstable.byte_pieces_path())
    assert sstable.read_tables(spark, out).count() == 0


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.5), (1, 3, 1, "assistant", "a <|im_end|>\n\\n <\\|", 3.0), (1, 4, 3, None, None, 1.0), (2, 1, 99, "as\nsistant\\n", "x", 1.0)]
    m = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double").fillna("", ["role", "text"])
    f = chat_format.format_conversations(m).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()
    got = {r.conv_id: [(x.role, x.text) for x in r.t] for r in f}
    assert got == {1: [("user", "q"), ("assistant", rows[2][4]), ("", "")], 2: [("as\nsistant\\n", "x")]}
    assert chat_format.format_conversations(m, per_tree=5).count() == 3
    assert chat_format.format_conversations(m.limit(0)).count() == 0
    chain = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert chat_format.digests(chat_format.format_conversations(chat_format.replies(chain))).first().n_turns == 300


def test_chat_cycles_and_repeats(spark):
    schema = "conv_id long, node long, parent long, role string, text string, score double, low string, top int"
    rows = [(1, 5, 9, "user", "five", 1.0, "", 0), (1, 9, 7, "assistant", "nine", 1.0, "", 0), (1, 7, 5, "user", "seven", 1.0, "", 0), (1, 8, 9, "assistant", "eight", 9.0, "", 0),
            (2, 3, 3, "user", "self", 1.0, "", 0), (3, 1, None, "user", "b", 1.0, "", 0), (3, 1, None, "user", "a", 1.0, "", 0), (3, 2, 1, None, None, None, "", 0), (None, 1, None, "user", "x", 1.0, "", 0), (4, None, None, "user", "x", 1.0, "", 0)]
    f = chat_format.format_conversations(spark.createDataFrame(rows, schema)).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: [x.text for x in r.t] for r in f} == {1: ["five", "seven", "nine", "eight"], 2: ["self"], 3: ["a", ""]}


def test_chat_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 0, "assistant", "b"), (1, None, "user", "last"), (None, 1, "user", "x"), (2, 1, None, "only")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.digests(chat_format.format_conversations(chat_format.replies(d))).collect()}
    assert got == {1: (3, 1), 2: (1, 0)}


def test_archives_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 20000)
    rng = random.Random(2)
    rows = [(i, f"http://h{rng.randrange(3)}.example.com/{rng.randrange(5)}", "x" * rng.randrange(300) + str(rng.randrange(40))) for i in range(900)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = scratch.new_dir(spark, "w")
    warc.write_archives(p.repartition(7), out)
    got = warc.read_archives(spark, out).collect()
    key = {r.page_id: (r.k, r.page_id) for r in p.select("page_id", warc.url_key(F.col("url")).alias("k")).collect()}
    order = [key[r.page_id] for r in sorted(got, key=lambda r: (r.path.split("/")[-1], r.position))]
    assert order == sorted(order) and len(order) == 900
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert {r.page_id: r.refers_to for r in got} == {i: first[h] if len(h) >= 100 and first[h] != i else None for i, _, h in rows}


def test_archives(spark):
    big = "<p>" + "é" * 200
    rows = [(5, "http://b.example.com/x?y#z", big), (3, "https://a.example.org:80/Q", big), (9, None, None), (7, "not a url ü", ""), (8, "http://b.example.com/", "s"), (6, "http://b.example.com/x", "s"), (5, "http://zz", big)]
    out = scratch.new_dir(spark, "w")
    p = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(p, out)
    got = {r.page_id: r for r in warc.read_archives(spark, out).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {3: ("response", None), 5: ("revisit", 3), 9: ("response", None), 7: ("response", None), 8: ("response", None), 6: ("response", None)}
    assert got[5].payload_digest == hashlib.sha256(big.encode()).hexdigest() and bytes(got[3].html).decode() == big and got[7].url == "not a url ü"
    keys = {r.url: r.k for r in p.select("url", warc.url_key(F.col("url")).alias("k")).collect()}
    order = [keys[r.url or None] for r in sorted(got.values(), key=lambda r: (r.path, r.position))]
    assert order == sorted(order) and len(order) == 6
    out = scratch.new_dir(spark, "w")
    warc.write_archives(p.limit(0), out)
    assert warc.read_archives(spark, out).count() == 0


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as c

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = {r.doc_id for r in quality_rules.rule_report(spark.read.parquet(f"{DATA}/documents.parquet")).filter("kept").collect()}
    live = {i: t for i, t in rows.items() if i in kept}
    sets = shingle_sets(live.items())
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    items = [decontaminate.clean(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {i: t for i, t in live.items() if find(i) == i and not any(x in decontaminate.clean(t) for x in items)}
    got = c.run(spark, DATA).toPandas()
    assert set(got.doc_id) == set(want)
    t = tokens.encoder(packing.word_pieces_path(), False)
    for i, x in list(want.items()):
        out = x
        for s, k, e in reversed(base_spans(x)):
            out = out[:s] + f"[{pii.KINDS[k].upper()}]" + out[e:]
        assert got[got.doc_id == i].length.sum() == len(t.encode([out])[0]) // 4 + 1
    assert [n for n, _ in c.STAGES] == ["quality_rules", "ngram_join", "decontamination", "pii", "packing"]


def test_all_queries_run(spark):
    assert len(queries.QUERIES) == 10
    for k in ("op3_decontaminate", "op9_chat_format", "op10_warc"):
        assert queries.QUERIES[k](spark, DATA).count() > 0
