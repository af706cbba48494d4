"""op9 against all pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from attesta.llm import jaccard_join
from attesta.llm.components import components

from .conftest import EDGES


def fold(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def sets(rows):
    out = defaultdict(list)
    for i, x in rows:
        w = re.findall("[^\x20\x09-\x0d]+", fold(x))
        out[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(rows):
    s = sets(rows)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holding = defaultdict(set)
    for i, own in s.items():
        for x in own:
            for g in x:
                holding[g].add(i)
    for i in s:
        for x in s[i]:
            for j in Counter(j for g in x for j in holding[g]):
                if j < i and any(100 * len(x & y) >= 75 * len(x | y) for y in s[j] if y):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in s}


def near(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.random()}"
    return " ".join(words)


def corpus(seed):
    rnd = random.Random(seed)
    shared = [f"p{i}" for i in range(60)]
    rows, i = [], 10
    for _ in range(12):
        base = [f"v{rnd.randrange(400)}" for _ in range(rnd.randrange(5, 160))]
        for _ in range(rnd.randrange(1, 12)):
            rows.append((i, near(rnd, base, rnd.randrange(0, 6))))
            i += 1
    for _ in range(25):  # documents that share a passage only
        rows.append((i, " ".join([f"u{rnd.random()}" for _ in range(80)] + shared)))
        i += 1
    hub = [f"h{k}" for k in range(150)]
    for _ in range(60):  # one large group of near copies
        rows.append((i, near(rnd, hub, rnd.randrange(0, 7))))
        i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block", [(1, 1 << 20), (2, 1 << 20), (3, 700)])
def test_equals_all_pairs(spark, make, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(make(rows).repartition(5)).collect()}
    want, s = brute(rows), sets(rows)
    assert got == {i: (len(s[i][0]), want[i]) for i in s}


def test_edges(spark, make):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(make(EDGES)).collect()), key=str)
    by = {(a, b, c) for a, b, c in got}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (8, 1, 8)} <= by and len(got) == len(EDGES)
    assert jaccard_join.near_duplicates(make([(1, "a")]).filter("doc_id < 0")).count() == 0


def test_copies_of_a_row_without_id(spark, make):
    w = [f"c{i}" for i in range(60)]
    rows = [(None, " ".join(w)), (7, " ".join(w)), (5, " ".join(["x", *w[1:]]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(make(rows).coalesce(1)).collect()}
    assert got == {7: 5, 5: 5, None: 5}


def test_chain(spark, make):
    """a links b and b links c, a does not link c: one component."""
    w = [f"c{i}" for i in range(100)]
    rows = [(3, " ".join(w)), (2, " ".join(w[10:] + [f"d{i}" for i in range(10)])), (1, " ".join(w[20:] + [f"d{i}" for i in range(20)]))]
    assert {r["component_id"] for r in jaccard_join.near_duplicates(make(rows)).collect()} == {1}


def test_keep_one(spark, make):
    kept = jaccard_join.keep_one(make(EDGES))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, 6, 7, 8, None]
    assert kept.columns == make([(1, "a")]).columns


def test_keep_one_loses_no_text(spark, make):
    """Rows of one id with different texts are judged by their texts; equal rows leave one, always the same."""
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, words("a")), (1, words("b")), (2, words("b") + " more"), (3, words("c")), (3, words("c")), (3, words("c") + " tail"), (4, words("a")), (5, None), (5, None), (5, ""), (None, words("a")), (None, words("a"))]
    docs = make(rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs).collect()), key=str)
    c = {(3, words("c")), (3, words("c") + " tail")} & set(kept)
    assert len(c) == 1 and kept == sorted([(1, words("a")), (1, words("b")), *c, (5, None), (5, ""), (None, words("a")), (None, words("a"))], key=str)
    assert kept == sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(make(rows[::-1])).collect()), key=str)
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 3), (2, 1)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 10: 1, 4: 4, 5: 4}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["root"] for r in components(chain).collect()} == {0}
    assert components(edges.filter("a < 0")).count() == 0


def test_matches_grow_with_cost():
    import numpy as np

    assert jaccard_join.choose_matches(np.ones(200), 200) == 10
    assert jaccard_join.choose_matches(np.r_[np.ones(51), np.full(149, 50.0)], 200) in (10, 20)
    assert jaccard_join.choose_matches(np.full(200, 100.0), 200) == 20
