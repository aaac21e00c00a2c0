import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanflow.llm import exact, lines, near
from spanflow.llm.common import tune

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("cut", [0, 5, 100])
def test_exact_against_grouping(spark, docs, cut):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    keep = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = sorted(((i, keep[plain(t)], len(groups[plain(t)]), i == keep[plain(t)], hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows), key=str)
    got = exact.exact_dedup_at(docs, F.col("doc_id") <= cut).collect()
    assert sorted(map(tuple, got), key=str) == want
    two = exact.exact_dedup(docs.where(f"doc_id > {cut} or doc_id is null"), docs.where(f"doc_id <= {cut}")).collect()
    assert sorted(map(tuple, two), key=str) == want


@pytest.mark.parametrize("cut", [0, 1, 100])
def test_exact_over_many_shards(docs, cut, monkeypatch):
    """Shards come from all rows: an empty or tiny history doesn't bring the new rows to one task."""
    want = sorted(map(tuple, exact.exact_dedup_at(docs, F.col("doc_id") <= cut).collect()), key=str)
    monkeypatch.setattr(exact, "SHARD_ROWS", 3)
    assert sorted(map(tuple, exact.exact_dedup_at(docs, F.col("doc_id") <= cut).collect()), key=str) == want


def test_exact_empty(empty):
    assert exact.exact_dedup_at(empty, F.lit(True)).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.sets(st.integers(0, 1 << 30), max_size=300), st.sets(st.integers(0, 1 << 30), max_size=50))
def test_perfect_hash(keys, others):
    parts = lambda xs: exact._parts([hashlib.sha256(str(x).encode()).digest() for x in xs])
    mine = parts(keys)
    levels, slot = exact.build_hash(mine)
    assert sorted(slot.tolist()) == list(range(len(keys)))  # minimal and perfect
    assert exact.find_slots(levels, mine).tolist() == slot.tolist()
    held = np.empty_like(mine)
    held[slot] = mine
    for x in others - keys:
        at = exact.find_slots(levels, parts([x]))[0]
        assert at < 0 or (held[at] != parts([x])[0]).any()


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("size,similarity", [(3, 0.85), (5, 0.8)])
def test_near_against_all_pairs(spark, sample, size, similarity):
    base = [(r.doc_id, r.text) for r in sample.collect()]
    word = base[0][1].split()
    more = [(1000 + k, " ".join(w if j % 60 != k else "zz" for j, w in enumerate(word))) for k in range(8)]
    df = sample.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    want = components(base + more, size, round(100 * similarity))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, size, similarity).collect()}
    assert got == want


def broadcast_of_exploded(plan):
    """Whether a broadcast in a plan's text is made from rows that the same plan has multiplied."""
    line = [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.splitlines()]
    for i, (deep, x) in enumerate(line):
        if "BroadcastExchange" in x:
            for d, y in line[i + 1 :]:
                if d <= deep:
                    break
                if "Generate " in y:
                    return True
    return False


@pytest.mark.parametrize(("size", "similarity"), [(3, 0.85), (5, 0.8)])  # op9's and the pipeline's
def test_near_large_templates(spark, monkeypatch, size, similarity):
    """Texts of one template on both sides of the bound: no step broadcasts rows that it has dealt out to many blocks."""
    tune(spark)
    rng = np.random.default_rng(11)
    base, rows = [f"w{x}" for x in range(90)], []
    for i in range(500):
        word = list(base if i % 5 else base[:60])
        for k in rng.choice(len(word), rng.integers(0, 7), replace=False):
            word[k] = f"v{rng.integers(4)}"
        rows.append((i, " ".join(word)))
    plans, write = [], near.materialise
    monkeypatch.setattr(near, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "FEW", 20, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, size, similarity).collect()}
    assert got == components(rows, size, round(100 * similarity))
    assert len({c for _, c in got.values()}) > 50 and not any(map(broadcast_of_exploded, plans))


@pytest.mark.parametrize("order", ["shuffled", "falling"])
def test_components_of_long_chains(spark, order):
    ids = [0, *range(999, 0, -1)] if order == "falling" else np.random.default_rng(1).permutation(1000).tolist()
    links = spark.createDataFrame([*zip(ids, ids[1:]), (2001, 2000)], "a long, b long")
    got = {r.id: r.comp for r in near.components(links).collect()}
    assert got == dict.fromkeys(range(1000), 0) | {2000: 2000, 2001: 2000}


def test_near_odd_rows(docs, empty):
    got = defaultdict(set)
    for r in near.near_duplicates(docs, 3, 0.85).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert got[1] == {(3, 1, True)} and got[5] == got[9] == got[10] == {(3, 1, False)}
    assert got[2] == {(0, 2, True)} and got[4] == {(0, 4, True)} and got[6] == {(1, 6, True)} and got[None] == {(3, None, True)}
    assert near.near_duplicates(empty).count() == 0


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(0)
    for n in (3, 50, 400):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.concatenate((a[: n - n // 10], rng.integers(0, 1 << 63, n // 10, np.uint64)))
        flip = lambda s: np.bincount((s >> np.uint64(22)).astype(np.int64) % near.SKETCH, minlength=near.SKETCH) & 1
        assert (flip(a) != flip(b)).sum() <= 2 * (n // 10)


BORDER = re.compile(r"[.!?]+(?=\s)[^\S\n]*\n?|\n")


def units(text):
    """(start, end, words, normalised text), by one pass of a regular expression."""
    at = 0
    for end in [*(m.end() for m in BORDER.finditer(text)), len(text)]:
        word = text[at:end].lower().split()
        if word:
            yield at, end, len(word), " ".join(word)
        at = end


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "c!", ". ", " ", "\n", "  ", "d?", "é", "\t", "x\ny", "..."]), max_size=12).map("".join))
def test_units_against_a_regular_expression(text):
    assert lines.units(text) == [u[:3] for u in units(text)]


def whole_lines(text):
    """(start, end, words, normalised text) of the lines that hold words, a line's end its own."""
    at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        if word := line.lower().split():
            yield at, at + len(line), len(word), "line " + " ".join(word)
        at += len(line)


@pytest.mark.parametrize("least", [lines.MIN_WORDS, 1])
def test_lines_against_brute_force(sample, least):
    """Every whole line that stands earlier goes, and the sentences in runs of `least` words; with 1 no repeated one is left."""
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    first: dict = {}
    for i, t in sorted(rows):
        for *_, p in [*units(t), *whole_lines(t)]:
            first.setdefault(p, i)
    for r in lines.dedup_passages(sample, least).collect():
        text = dict(rows)[r.doc_id]
        runs, whole, seen, last = [], [], set(), None
        for k, (a, b, w, p) in enumerate(units(text)):
            if w and (p in seen or first[p] < r.doc_id):
                if last == k - 1:
                    runs[-1] = (runs[-1][0], b, runs[-1][2] + w)
                else:
                    runs.append((a, b, w))
                last = k
            seen.add(p)
        for a, b, w, p in whole_lines(text):
            if p in seen or first[p] < r.doc_id:
                whole.append((a, b, w))
            seen.add(p)
        gone = np.zeros(len(text), bool)
        for a, b, _ in [x for x in runs if x[2] >= least] + whole:
            gone[a:b] = True
        marked = np.zeros(len(text), bool)
        for x in r.spans:
            assert not marked[x.start : x.end].any() and x.words == len(text[x.start : x.end].split())
            marked[x.start : x.end] = True
        assert (gone == marked).all()
        assert r.text == "".join(c for c, g in zip(text, gone, strict=True) if not g) and r.n_removed == gone.sum()


def test_repeated_lines_go_at_any_length(spark):
    df = spark.createDataFrame([(1, "Menu\nHello there. Yes.\nOne"), (2, "Menu\nYes. Hello again.\nTwo\nTwo"), (3, "hello  there.  yes.\nYes.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_substrings(df).collect()} == {1: "Menu\nHello there. Yes.\nOne", 2: "Yes. Hello again.\nTwo\n", 3: "Yes."}


def test_lines_odd_rows(docs, empty):
    got = lines.dedup_passages(docs, 3).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.text, r.n_removed))
    assert by[1] == [("a b c d e", 0)] and by[5] == [("", 10)] and by[9] == [("", 9)] * 2 and by[2] == [(None, 0)] and by[None] == [("a b c d e", 0)]
    assert lines.dedup_passages(empty).count() == 0


def test_lines_parted_by_blank_lines(spark):
    passage = "\n\n".join(f"Line {i} of a notice" for i in range(12)) + "\n"
    df = spark.createDataFrame([(1, f"One.\n\n{passage}\nend one"), (2, f"Two.\n \n{passage}\nend two")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_passages(df).collect()} == {1: f"One.\n\n{passage}\nend one", 2: "Two.\n \n\nend two"}


def test_substrings_against_windows(spark, sample, docs, empty):
    """Every window of 50 words that stands in an earlier document is removed, glued ends and all, and no word that nothing earlier holds."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = word(70)
    rows = [(i, " ".join([*word(30), *passage[k : k + 60], *word(30)])) for i, k in enumerate((0, 10, 5))]
    df = spark.createDataFrame([*rows, *((r.doc_id + 10, r.text) for r in sample.collect())], "doc_id long, text string")
    texts, known = {r.doc_id: r.text for r in df.collect()}, {}
    for i, t in sorted(texts.items()):
        w = t.lower().split()
        for k in range(len(w) - 49):
            known.setdefault(tuple(w[k : k + 50]), i)
    for r in lines.dedup_substrings(df).collect():
        text = texts[r.doc_id]
        gone = np.zeros(len(text) + 1, bool)
        for s in r.spans:
            gone[s.start : s.end] = True
        at = [m.span() for m in re.finditer(r"\S+", text)]
        w = text.lower().split()
        for k in range(len(w) - 49):
            if known[tuple(w[k : k + 50])] < r.doc_id:
                assert gone[at[k][0] : at[k + 49][1]].all()
        if r.doc_id < 3:
            assert len(r.text.split()) == (120, 70, 60)[r.doc_id]
    assert lines.dedup_substrings(docs, 3).count() == docs.count() and lines.dedup_substrings(empty).count() == 0
