"""op7 against a scan of every window."""

import hashlib
import re

import pytest

from attesta.llm import decontamination

from .conftest import EDGES


def words(x):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))


def brute(docs, bench):
    windows = {}
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).update({str(i)} if i is not None else set())
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    items |= windows[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


PASSAGE = " ".join(f"b{i}" for i in range(30))
DOCS = [
    *EDGES, (20, f"start {PASSAGE} end"), (21, f"start {PASSAGE.upper()}, end"), (22, " ".join(f"b{i}" for i in range(12))), (23, "the the the " * 20), (24, "short item here"),
    (25, "x " * 2000 + PASSAGE), (26, " ".join(f"b{i}" for i in range(15)) + " q " + " ".join(f"b{i}" for i in range(14, 30))), (20, f"start {PASSAGE} end"), (27, "solo"),
]
BENCH = [(1, PASSAGE), (2, "short item"), (3, None), (4, ""), (5, "the the the the the the the the the the the the the the"), (6, PASSAGE), (None, "nobody lists this"), (7, "solo"), (10, " ".join(f"b{i}" for i in range(5, 25)))]


@pytest.mark.parametrize("block", [500_000, 40])
def test_equals_scan(spark, make, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontamination.mark(make(DOCS), bench).select("row.doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, BENCH)


def test_filter_keeps_columns(spark, make):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = make(DOCS)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in brute(DOCS, BENCH) if not r[4]), key=str)


def test_empty(spark, make):
    docs = make(DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.mark(docs, none).filter("contaminated or n_hit > 0").count() == 0
    assert decontamination.mark(docs.limit(0), spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_query_digest(spark, sf):
    for r in decontamination.op7_benchmark_decontamination(spark, sf).filter("n_items = 0").limit(3).collect():
        assert r["items_sha256"] == hashlib.sha256(b"").hexdigest()
