"""Ranked search, source mixing and whitening against plain Python."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from attesta.llm import lexical_search, mixing, whitening

from .conftest import EDGES

# ---- ranked lexical search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def search_brute(items, docs, k=10):
    cut = [(i, Counter(_terms(t))) for i, t in docs]
    cut = [(i, c) for i, c in cut if c]
    n, total = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, words in {(i, tuple(sorted(_terms(t)))) for i, t in items if _terms(t)}:
        scored = []
        for doc, c in cut:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def _found(spark, items, docs, **options):
    i = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 AS query", "2 AS rank")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS terms", "'x' AS n", "'x' AS seed", "'x' AS score")
    return sorted(map(repr, (tuple(r) for r in lexical_search.search(i, d, **options).select("item_id", "rank", "doc_id", "score").collect())))


def test_search_edges(spark):
    items = [("a", "one TWO"), ("b", None), ("c", ""), ("d", "--- !!"), ("e", "ünï 日本語 w5 w5 w7"), ("a", "one TWO"), ("a", "null id"), ("f", "absent words only"), (None, "one")]
    assert _found(spark, items, EDGES) == search_brute(items, EDGES)
    assert _found(spark, [], EDGES) == [] and _found(spark, items, []) == [] and _found(spark, items, [(1, None), (2, "..")]) == []


@pytest.mark.parametrize("shard, k", [(4096, 10), (64, 3), (700, 10)])
def test_search_equals_brute_force(spark, shard, k):
    rng = random.Random(shard)
    topics = [[f"t{t}w{i}" for i in range(40)] for t in range(6)]
    common = [f"c{i}" for i in range(25)]
    text = lambda t, n: " ".join(rng.choice(common if rng.random() < 0.5 else topics[t]) for _ in range(n))
    docs = [(i, text(rng.randrange(6), rng.randrange(1, 80))) for i in range(1500)]
    copy = text(2, 60)
    docs += [(2000 + i, copy) for i in range(300)] + [(7, "c1 c1 c1"), (7, "c1 c1 c1"), (None, copy)]
    items = [(f"i{j}", text(rng.randrange(6), rng.randrange(1, 30))) for j in range(25)] + [("copy", copy), ("rare", "t0w1 t5w39"), ("common", " ".join(common))]
    assert _found(spark, items, docs, shard=shard, k=k) == search_brute(items, docs, k)


def test_search_in_batches(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BATCH_WORDS", 5)
    items, docs = [(f"i{j}", f"w{j} w{j + 1} w{j + 2}") for j in range(6)], [(i, " ".join(f"w{(i * j) % 9}" for j in range(1, 6))) for i in range(30)]
    assert _found(spark, items, docs) == search_brute(items, docs)


def test_summaries_bound_every_document():
    rng = np.random.default_rng(3)
    n, width = 3000, 60
    sets = [np.sort(rng.choice(width, rng.integers(1, 30), replace=False)) for _ in range(n)]
    first = np.r_[0, np.cumsum([len(s) for s in sets])]
    term, impact = np.concatenate(sets), rng.integers(1, 1_000_000, first[-1])
    shard = lexical_search.Shard.build(np.arange(n), np.ones(n, bool), first, term, impact, np.ones(width, np.int64))
    dense = np.zeros((n, len(shard.terms)), np.int64)
    dense[np.repeat(np.arange(n), np.diff(shard.first)), shard.term] = shard.impact
    for t in range(len(shard.terms)):
        own = shard.posting[shard.list_first[t] : shard.list_first[t + 1]]
        assert sorted(own) == np.flatnonzero(dense[:, t]).tolist() and shard.most[t] == dense[:, t].max()
        stops = np.r_[shard.block_first[shard.blocks[t] : shard.blocks[t + 1]], shard.list_first[t + 1]]
        assert len(own) <= lexical_search.SMALL or stops[0] == shard.list_first[t]
        for b, (x, y) in enumerate(zip(stops[:-1], stops[1:]), shard.blocks[t]):
            s = slice(shard.summary_first[b], shard.summary_first[b + 1])
            row = np.zeros(len(shard.terms), np.int64)
            row[shard.summary_term[s]] = shard.summary[s]
            assert y - x <= lexical_search._block_size(len(own)) and (row == dense[shard.posting[x:y]].max(axis=0)).all()


# ---- mixing sources


def targets_brute(sizes, weights=mixing.WEIGHTS, share=Fraction(3, 2), repeats=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > repeats * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = Fraction(repeats * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def _mixed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' AS unit", "'x' AS place", "'x' AS size", "'x' AS target", "'x' AS mark")
    return docs, mixing.mix(docs, **options)


def _check_mix(spark, rows, block):
    docs, mix = _mixed(spark, rows, block=block)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    want = targets_brute(dict(sizes))
    got = [tuple(r) for r in mix.taken().collect()]
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((i, s, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, s, t in rows)
    taken = Counter()
    for _, source, size, source_size, target, n in got:
        assert source_size == sizes[source] and target == pytest.approx(float(want[source]), rel=1e-9) and 0 <= n <= 2 * size
        taken[source] += n
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    again = _mixed(spark, list(reversed(rows)), block=block)[1].taken()
    assert sorted(map(repr, got)) == sorted(map(repr, (tuple(r) for r in again.collect())))
    blocks = mix.texts(docs).collect()
    of = Counter()
    for r in blocks:
        n = len(r["text"].split(" "))
        assert 0 < n <= block
        of[r["source"]] += n
    assert {s: n for s, n in taken.items() if n} == dict(of)
    return mix, blocks


def test_mix_edges(spark):
    rows = [(i, s, t) for (i, t), s in zip(EDGES, ["a", "a", None, "b", "b", "b", "é", None, "Z", "Z"])] + [(9, "empty", None), (10, "empty", " \n")]
    _check_mix(spark, rows, 64)
    assert _mixed(spark, [])[1].taken().count() == 0 and _mixed(spark, [])[1].pieces.count() == 0
    assert [r["taken"] for r in _mixed(spark, [(1, "a", None), (2, None, "")])[1].taken().collect()] == [0, 0]


def test_mix_of_a_hot_source_is_spread_evenly(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.6 else f"s{rng.randrange(7)}", " ".join(f"w{i}" for _ in range(rng.choice([1, 5, 30, 90])))) for i in range(1500)] + [(None, "hot", "x y")] * 300
    mix, _ = _check_mix(spark, rows, 16)
    slots = [r[0] for r in sorted(mix.pieces.select("place", "slot", "rank").distinct().collect(), key=lambda r: (r["slot"], r["place"], r["rank"]))]
    total = Counter(slots)
    for end in range(100, len(slots), 97):
        seen = Counter(slots[:end])
        assert all(abs(seen[p] - end * n / len(slots)) <= 4 for p, n in total.items())
    used = mix.pieces.groupBy("unit", "copy", "epoch").agg({"rank": "count"})
    assert used.count() > 0


def test_mix_words_are_the_documents_words(spark):
    rows = [(i, f"s{i % 2}", " ".join(f"d{i}x{j}" for j in range(1 + i * 3))) for i in range(12)]
    _, blocks = _check_mix(spark, rows, 8)
    seen = Counter(w for r in blocks for w in r["text"].split(" "))
    assert set(seen) <= {w for _, _, t in rows for w in t.split(" ")} and max(seen.values()) <= 2


def test_one_small_source_in_a_salted_join(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES_TO_BROADCAST", 0)
    _check_mix(spark, [(i, ["a", "b", None][i % 3], "w " * (i + 1)) for i in range(30)], 4)


# ---- whitening


def _rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS x", "'y' AS deviation", "'z' AS extra")


def whiten_brute(rows):
    held = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in held), default=0)
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v))) for i, v in held]
    n, sums = len(x), [sum(r[d] for _, r in x) for d in range(width)]
    return n, [(i, sum((n * c - s) ** 2 for c, s in zip(r, sums))) for i, r in x], np.array([r for _, r in x], object)


def _check_whitening(spark, rows):
    out, found, error = whitening.whiten(_rows(spark, rows))
    n, deviations, x = whiten_brute(rows)
    got = out.collect()
    assert out.columns == ["vec_id", "embedding", "extra", "n", "deviation", "whitened"] and all(r["n"] == n and r["extra"] == "z" for r in got)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"])) for r in got) == sorted((i is None, i or 0, d) for i, d in deviations)
    k = len(found.values)
    if k:
        centred = np.array([[float(Fraction(int(c)) - m) for c, m in zip(r, [Fraction(int(sum(col)), n) for col in x.T])] for r in x])
        v = centred.T @ centred / n
        assert np.allclose(v @ found.components.T, found.components.T * found.values, atol=1e-9 * found.values.max()) and np.allclose(found.components @ found.components.T, np.eye(k), atol=1e-12)
        assert (np.diff(found.values) <= 1e-12 * found.values.max()).all() and np.allclose(found.explained, found.values / np.trace(v), rtol=1e-9)
        want = centred @ found.components.T / np.sqrt(found.values)
        have = np.array(sorted((r["whitened"] for r in got)))
        assert np.allclose(np.array(sorted(want.tolist())), have, atol=1e-6) and error < 1e-4
    return k, error


def test_whitening_equals_plain_sums(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 40)) + rng.normal(size=(400, 40)) * 0.2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(1, base[1].tolist()), (None, base[2].tolist()), (500, None), (501, [float("nan")] * 40), (502, [float("inf")] + [0.0] * 39), (503, [None] * 40)]
    k, _ = _check_whitening(spark, rows)
    assert k == whitening.COMPONENTS


def test_whitening_edges(spark):
    assert _check_whitening(spark, []) == (0, None)
    assert _check_whitening(spark, [(1, [1.0, 2.0])]) == (0, None)  # one row has no variance
    assert _check_whitening(spark, [(i, [0.5, -0.5]) for i in range(9)]) == (0, None)
    assert _check_whitening(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, [1.0, 4.0])])[0] == 1  # a constant dimension is no direction
    assert _check_whitening(spark, [(1, [1.0, 2.0]), (2, [3.0]), (3, []), (4, [-1.0, 0.25, 9.0])])[0] >= 2  # shorter vectors end in zeros
    assert _check_whitening(spark, [(1, [1e9, 1.0]), (2, [-2e9, 0.0]), (3, [5e8, -3.0]), (4, [7.0, 2.0])])[0] == 1  # sums beyond 64 bits
    _check_whitening(spark, [(1, [1e30, 1.0]), (2, None)])


def test_slices_are_exact():
    rng = np.random.default_rng(2)
    x = np.c_[rng.integers(0, 2, 333), rng.integers(-(1 << 40), 1 << 40, 333), np.full(333, 5)]
    s = whitening.Slices(x.min(axis=0).tolist(), x.max(axis=0).tolist())
    limbs, y = s.scatter(x), np.c_[x - x.min(axis=0), np.ones(333, np.int64)].astype(object)
    for i in range(4):
        for j in range(i, 4):
            assert sum(int(v) << (16 * k) for k, v in enumerate(limbs[i, j])) == int((y[:, i] * y[:, j]).sum())
