"""Operators 2, 5, 7 and 8 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from baitscope.llm import decontam, graph, probminhash, runindex, vecdup

DATA = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join(rng.choice(["ab", "cdé", "ef", "g", "hij"]) + str(rng.randint(0, 999)) for _ in range(n))


# Operator 2

def brute_repeats(rows, length):
    count, raws = collections.Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        count.update(b[p:p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        cov = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                cov[p:p + length] = True
        kept = bytes(x for x, z in zip(b, cov.tolist(), strict=True) if not z)
        spans = int((np.diff(np.concatenate(([0], cov.astype(int)))) > 0).sum())
        out.append((i, len(b), int(cov.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    rng = random.Random(2)
    passage, rows = words(rng, 150), []
    for i in range(60):
        t = words(rng, rng.randint(0, 120))
        if i % 6 == 1:
            t = words(rng, 30) + passage[:rng.randint(300, len(passage))] + words(rng, 20)
        if i % 6 == 2:
            t = passage[rng.randint(0, 400):] + words(rng, 5) + passage[:500]
        if i % 6 == 3:
            t = "ab " * rng.randint(100, 400)
        rows.append((i, rows[0][1] + "!" if i % 6 == 4 else t))
    return rows + [(200, None), (201, ""), (202, "x" * 399), (203, "y" * 400), (204, "y" * 400), (205, "z" * 401),
                   (None, rows[7][1]), (7, rows[7][1]), (300, "q" * 1000)]


@pytest.mark.parametrize(("length", "crowd"), [(400, 2000), (100, 2000), (400, 2)])
def test_repeats(spark, monkeypatch, length, crowd):
    monkeypatch.setattr(runindex, "SEGMENT", 700)
    whole = runindex.repeated_windows
    monkeypatch.setattr(runindex, "repeated_windows", lambda t, n: whole(t, n, crowd))
    rows = repeat_rows()
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, key string, runs string")
    got = sorted((tuple(r) for r in runindex.repeat_digests(df, length).collect()), key=str)
    assert got == brute_repeats(rows, length)


def test_halves_part_windows_by_what_they_hold():
    rng = random.Random(8)
    for _ in range(500):
        length, gram = rng.randint(40, 90), 32
        windows = rng.randint(1, length - gram + 1)
        at = rng.randint(windows - 1, length - gram)
        raw = bytes(rng.randrange(256) for _ in range(length + windows - 1))
        open_, seen = [(0, raw, at, gram)], []
        while open_:
            shift, part, place, core = open_.pop()
            if core == length:
                assert len(part) == length and place == 0
                seen.append(shift)
                continue
            kids = list(runindex.halves(part, place, core, length))
            assert sum(k[2] for k in kids) == len(part) - length + 1
            for _, first, n, where, size in kids:
                assert core < size <= length and where <= place and where + size >= place + core
                assert first + n - 1 <= where and where + size <= first + length  # every window holds the core
                open_.append((shift + first, part[first:first + n + length - 1], where - first, size))
        assert sorted(seen) == list(range(windows))


def test_popular_line_is_parted_not_counted(spark, monkeypatch):
    """A common line below the length costs a few parts a context; one above it is found; every group goes through the index."""
    rng = random.Random(9)
    line, long_line = words(rng, 62)[:360], words(rng, 90)[:450]
    rows = [(i, words(rng, 90) + line + words(rng, 90)) for i in range(300)]
    rows += [(1000 + i, words(rng, 90) + long_line + words(rng, 90)) for i in range(60)]
    made = []
    real = runindex.parted

    def counted(df, length):
        out = real(df, length).cache()
        made.append((df.count(), out.count()))
        return out

    monkeypatch.setattr(runindex, "parted", counted)
    whole = runindex.repeated_windows
    monkeypatch.setattr(runindex, "repeated_windows", lambda t, n: whole(t, n, 50))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in runindex.repeat_digests(df).collect()), key=str) == brute_repeats(rows, 400)
    assert 1 < len(made) <= 9 and all(out <= 2 * n for n, out in made) and sum(out for _, out in made) < 12 * len(rows)


def test_repeats_edges(odd_docs, no_docs):
    got = runindex.repeat_digests(odd_docs).collect()
    want = brute_repeats([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], 400)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert runindex.repeat_digests(no_docs).count() == 0
    kept = runindex.remove_repeats(odd_docs, 60)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert runindex.remove_repeats(no_docs).count() == 0


def test_run_index_against_all_suffixes():
    rng = random.Random(5)
    base = bytes(rng.choice(b"ab") for _ in range(60))
    parts = [base, base[10:] + b"c", b"a" * 30, b"a" * 17, base[:40], b"", b"xyz"]
    index = runindex.RunIndex(parts)
    suffixes = [(j, p[i:]) for j, p in enumerate(parts) for i in range(len(p) + 1)]
    common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    want = [max(common(s, t) for k, (_, t) in enumerate(suffixes) if k != n) for n, (_, s) in enumerate(suffixes)]
    assert index.statistics().tolist() == want
    assert len(index.heads) < len(index.text)


# Operator 7

def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows, least=0.8):
    rows = list(dict(rows).items())
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if find(i) != find(j):
                both = len(sets[i] & sets[j])
                if both and both / (len(sets[i]) + len(sets[j]) - both) >= least:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in rows}


def test_near_classes(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "CHUNK", 32)
    rng = random.Random(3)
    base, rows = [rng.choice("abcd") + str(rng.randint(0, 400)) for _ in range(120)], []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 50)}"
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One, two!"), (1004, "..."), (1005, "...")]
    rows += [(2000 + i, "same text all over again now and then") for i in range(20)] + [(2000, "same text all over again now and then")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = probminhash.near_classes(df).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_edges(odd_docs, no_docs):
    got = probminhash.near_classes(odd_docs).collect()
    by = {r.doc_id: r.class_id for r in got}
    assert len(got) == odd_docs.count() and by[1] == by[2] == 1 and by[3] == 3 and by[4] == 4 and by[5] == 5 and by[9] == 9
    kept = probminhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "None"])
    assert probminhash.near_classes(no_docs).count() == 0 and probminhash.keep_one(no_docs).count() == 0


def test_keep_one_leaves_one_row_of_each_class(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join(base[:-1] + ["other"])
    rows = [(1, " ".join(base), "en"), (1, " ".join(base), "en"), (1, " ".join(base), "fr"), (1, near, "en"), (2, near, "en"),
            (None, " ".join(base), "en"), (None, "five words without any id", None), (None, "five words without any id", None),
            (-1, "a", "en"), (None, "a", "en"), (7, "...", None), (7, "...", None), (8, "...", None), (None, "...", None), (None, "...", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in probminhash.keep_one(docs).collect()]
    first = [r for r in got if r[0] == 1]
    assert len(first) == 1 and first[0] in rows
    assert sorted(map(str, got)) == sorted(map(str, first + [rows[6], rows[8], rows[10], rows[12], rows[13], rows[14]]))


def test_copies_that_repeat_a_line_are_linked(spark):
    rows = []
    for k in range(16):
        w = [f"w{k}x{j}" for j in range(100)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + w[-20:] * 1000))]
    got = {r.doc_id: r.class_id for r in probminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    value = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 30, 60), rng.integers(1, 30, 60)
    a[:15] = 0
    wa, wb = np.where(a > 0, 1 + np.log(np.maximum(a, 1)), 0), 1 + np.log(b)
    want = sum(1 / sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in range(60)) for i in range(60) if wa[i] > 0)
    order = np.argsort(value)
    value, a, b = value[order], a[order], b[order]
    doc = np.concatenate((np.zeros((a > 0).sum(), int), np.ones(60, int)))
    s = probminhash.signatures(2, doc, np.concatenate((value[a > 0], value)), np.concatenate((a[a > 0], b)), 4000)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


# Operator 8

def brute_vectors(rows, least=0.98):
    good = {}
    for n, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[n] = x / np.linalg.norm(x)
    near = {n: [m for m in good if m != n and rows[m][2] == rows[n][2] and len(good[m]) == len(good[n]) and good[m] @ good[n] >= least]
            for n in good}
    out = []
    for n, (k, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in near.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        c = min(rows[m][0] for m in seen)
        out.append((k, len(near.get(n, [])), c, k == c))
    return sorted(out)


@pytest.mark.parametrize("cell_rows", [4096, 8])
def test_vectors(spark, cell_rows):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(4):
        center = rng.normal(size=64)
        for _ in range(40):
            rows.append((len(rows), (center + rng.normal(size=64) * rng.choice([0.05, 0.12, 0.3])).tolist(), c % 2))
    rows += [(500 + k, rows[0][1], 0) for k in range(5)] + [(600, [0.0] * 64, 0), (601, None, 0), (602, [float("nan")] * 64, 0), (603, [], 1),
             (604, rows[0][1], None), (605, [1.0, 2.0], 0), (606, [2.0, 4.0], 0), (607, [1.0], 0), (608, [None] * 64, 0), (609, [float("inf")] * 64, 1)]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "vec_id long, embedding array<float>, label int, k string, chunk string")
    got = sorted(tuple(r) for r in vecdup.near_vectors(df, cell_rows=cell_rows).collect())
    assert got == brute_vectors(rows)
    assert vecdup.near_vectors(df.limit(0)).count() == 0


def test_vector_cells_prune(spark):
    vectors = vecdup.distinct_vectors(vecdup.keyed(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")))
    met = vecdup.meetings(vectors.select("k", "label", "m", "embedding")).groupBy(*vecdup.CELL, "chunk").agg(
        F.count_if(F.col("role") == 0).alias("own"), F.count_if(F.col("role") == 1).alias("guests")).selectExpr(
        "sum(own * (own - 1) / 2 + own * guests) AS pairs").first().pairs
    every = vectors.groupBy("label").count().selectExpr("sum(count * (count - 1) / 2) AS pairs").first().pairs
    assert met <= 0.1 * every


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (100, 102), (7, 7), (200, 150), (150, 170)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[102] == 100 and got[200] == got[170] == 150
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Operator 5

def test_templates(spark):
    bench = spark.createDataFrame([
        (1, "If Alice buys 12 apples for 3 km each and Bob gives Alice 12 more, how many dollars does Alice spend?", "z"),
        (2, "tiny words here", "z"), (3, None, "z"), (4, "one two three four five", "z"), (9, "one two three four five", "z"), (None, "", "z")],
        "item_id long, text string, h string")
    docs = spark.createDataFrame([
        (1, "Now: If Carol buys 7 apples for 9 km each and Dave gives Carol 7 more, how many dollars does Carol spend? ok"),
        (2, "Now: If Carol buys 7 apples for 9 km each and Dave gives Erin 8 more, how many dollars does Zoe spend? ok"),
        (3, None), (4, ""), (5, "say one two three four five yes"), (None, "nothing"), (7, "tiny words here"), (5, "say one two three four five yes")],
        "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in decontam.flag(docs, bench).collect()}
    assert got == {1: (True, [1]), 2: (False, []), 3: (False, []), 4: (False, []), 5: (True, [4]), None: (False, []), 7: (False, [])}
    assert sorted(str(r.doc_id) for r in decontam.clean(docs, bench).collect()) == ["2", "3", "4", "7", "None"]
    assert decontam.flag(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_against_plain_windows(spark, odd_docs, no_docs):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    tok = lambda t: re.findall(r"\w+", t.lower())
    index = collections.defaultdict(set)
    for r in bench.collect():
        w = tok(r.text)
        for k in range(len(w) - 7):
            index[tuple(w[k:k + 8])].add(r.item_id)
    want = {}
    for r in docs.collect():
        w = tok(r.text)
        want[r.doc_id] = sorted(set().union(*[index.get(tuple(w[k:k + 8]), set()) for k in range(len(w) - 7)]))
    assert {r.doc_id: r["items"] for r in decontam.flag(docs, bench).collect()} == want
    assert decontam.flag(odd_docs, bench).count() == odd_docs.count() and decontam.clean(no_docs, bench).count() == 0


def test_windows_with_few_words_match_verbatim(spark):
    numbers = " ".join(str(17 * k) for k in range(1, 31))
    title = "Annual Report Of The Grand Northern Railway Company Board And Its Honoured Guests"
    bench = spark.createDataFrame([(1, "12 + 35 + 48 = 95 and " + numbers), (2, title), (3, "Name the largest planet of all"), (4, "3 m 4 kg")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "see 12 + 35 + 48 = 95 and " + numbers + " there"), (2, "see 12 + 35 + 48 = 96 and " + " ".join(str(19 * k) for k in range(1, 31))),
        (3, "at the " + title + " it was said"), (4, "please Name the largest planet of all today"), (5, "name the largest Planet of all"),
        (6, "a bit of 3 m 4 kg here"), (7, "a bit of 3 m 5 kg here"), (8, "0 " * 300), (9, "Annual Report Of The Small Southern Road Firm")],
        "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.flag(docs, bench).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [3], 5: [3], 6: [4], 7: [], 8: [], 9: []}


def test_a_contradiction_costs_only_its_windows(spark):
    filler = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ba", "de", "fi", "go", "hu", "ly", "mo", "pa")]
    long = " ".join(["Once"] + filler[:20] + ["it cost 450 coins"] + filler[20:] + ["then 450 coins more"])
    asked = "Tom has 5 apples and gives 5 to his sister How many apples remain now"
    bench = spark.createDataFrame([(1, long), (2, asked)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "so " + long.replace("then 450", "then 451")), (2, "so " + long.replace("cost 450", "cost 449")),
        (3, asked.replace("has 5", "has 7").replace("gives 5", "gives 3")), (4, asked.replace("5", "7")),
        (5, "Once upon a time it cost 9 coins")], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.flag(docs, bench).collect()}
    assert got == {1: [1], 2: [1], 3: [2], 4: [2], 5: []}


def test_items_of_one_template_are_one_class(spark):
    question = "If Alice buys {} apples for {} km each and Bob gives Alice {} more, how many dollars does Alice spend on them?"
    n = 300
    bench = spark.createDataFrame([(k, question.format(k + 2, 3 * k + 700, 5 * k + 9000)) for k in range(n)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "so " + question.format(k + 2, 7 * k + 1, 11 * k + 2) + " yes") for k in range(n)], "doc_id long, text string")
    got = decontam.flag(docs, bench).collect()
    assert len(got) == n and {(r.contaminated, r.n_items, tuple(r["items"])) for r in got} == {(True, n, (0,))}
    assert decontam.benchmark_windows(bench).select("class_id").distinct().count() == 1


def test_items_of_one_class_with_few_words(spark):
    """Only the item with the document's own numbers counts; equal slots make another class."""
    lines = [" ".join(str((13 * k + j * j) % 9973) for j in range(1, 25)) for k in range(40)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(lines)] + [(90, " ".join(["7"] * 24))], "item_id long, text string")
    half = " ".join(lines[3].split()[:12] + lines[8].split()[12:])
    docs = spark.createDataFrame([(1, "sum " + lines[5] + " end"), (2, half), (3, "7 " * 24), (4, "8 " * 24), (5, lines[2] + " and " + lines[6])],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r["items"]) for r in decontam.flag(docs, bench).collect()}
    assert got == {1: (1, [0]), 2: (0, []), 3: (1, [90]), 4: (0, []), 5: (2, [0])}


def test_a_common_first_sentence_meets_nothing(spark):
    first = "Which of the following is the most likely reason for what the passage above says about it"
    tail = lambda k: " ".join(f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for w in "red oak sea fog ink jet kit lap map net owl pea rim sun".split())
    tails = [tail(k) + " " + tail(k + 300) for k in range(200)]
    bench = spark.createDataFrame([(k, f"{first} {t}") for k, t in enumerate(tails)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{first} ? nothing else") for k in range(50)] + [(100 + k, f"{first} {tails[k]}") for k in range(50)],
                                 "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.flag(docs, bench).collect()}
    assert got == {**{k: [] for k in range(50)}, **{100 + k: [k] for k in range(50)}}
    shared = {int(h.view("int64")) for h in decontam.windows(*decontam.templates([first])[:2], decontam.WINDOW)[0]}
    assert not shared & {r.h for r in decontam.rarest(decontam.benchmark_windows(bench), decontam.SHARE).collect()}


def test_agreeing_windows():
    match = lambda place, *slots: dict(zip(("place", "spots", "filled", "found"), (place, *map(list, zip(*slots, strict=True))), strict=True))
    # 5 stands for 3 (at two of three places); 8 meets three values and stands for none.
    rows = [match(0, (0, 5, 3)), match(1, (1, 5, 3), (2, 5, 7)), match(2, (1, 5, 3)), match(3, (4, 8, 1)), match(4, (5, 8, 2), (6, 8, 4))]
    assert decontam.agreeing(rows) == [0, 2]
    # Half of the places each: the value in more windows.
    assert decontam.agreeing([match(0, (2, 5, 7)), match(1, (2, 5, 7)), match(2, (6, 5, 3))]) == [0, 1]
