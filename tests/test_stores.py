"""Stored structures against plain Python: duplicate filters, indexes, stores, ingestion and streams."""

import collections
import os
import random
import re
import time
import types
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.operators import dense, dense_index, firstwins, ingest, lexical, lexical_index
from attesta.operators.ingestion import Ingestion
from attesta.sources.chunks import ChunkTable
from attesta.sources.store import KeyedStore


def first_wins_brute(rows, num, den):
    words = {}
    for i, t in rows:
        words.setdefault(i, set()).update((t or "").lower().split())
    kept, out = [], {}
    for i in sorted(words):
        same = lambda o: den * len(words[i] & words[o]) >= num * len(words[i] | words[o]) and words[i] & words[o]  # noqa: B023, E731
        out[i] = not any(same(o) for o in kept)
        if out[i]:
            kept.append(i)
    return out


def _first_wins(spark, rows, least, short):
    found = firstwins.first_wins(spark.createDataFrame(rows, "id long, text string"), least, short)
    return {r["id"]: r["kept"] for r in found.rows.collect()}, found


def test_first_wins_follows_a_chain(spark):
    """Each text is similar to the one before it only: every other one is kept, which components would not give."""
    rows = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 30))) for i in range(8)]
    got, found = _first_wins(spark, rows, 0.8, 64)
    assert got == first_wins_brute(rows, 4, 5) == {i: i % 2 == 0 for i in range(8)}
    assert found.edge == 4 and found.leading == 0  # a round keeps a text and drops the next


def test_first_wins_takes_a_group_of_copies_in_one_round(spark):
    rng = random.Random(1)
    base = [f"b{j}" for j in range(40)]
    near = [(i, " ".join(w for k, w in enumerate(base) if k != i % 40) + f" own{i}") for i in range(200)]
    rows = [*near, (500, " ".join(base)), (501, " ".join(rng.choice("pqrstuv") + str(j) for j in range(30))), (502, None), (503, "  "), (504, "Base"), (505, "base"), (506, "b1")]
    got, found = _first_wins(spark, rows, 0.8, 8)
    assert got == first_wins_brute(rows, 4, 5) and found.leading >= 1 and sum(got[i] for i, _ in near) < 10


@pytest.mark.parametrize("least, num, den, short", [(0.8, 4, 5, 4), (0.5, 1, 2, 10_000)])
def test_first_wins_equals_the_fold(spark, least, num, den, short):
    rng = random.Random(num)
    vocabulary = [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(rng.sample(vocabulary[: rng.choice([6, 12, 30])], rng.randrange(0, 6)))) for i in range(150)] + [(7, "v1 v2"), (7, "v3"), (9, None)]
    got, _ = _first_wins(spark, rows, least, short)
    assert got == first_wins_brute(rows, num, den)


@pytest.mark.parametrize("least, num, den", [(0.8, 4, 5), (0.5, 1, 2), (0.25, 1, 4)])
@pytest.mark.parametrize("rare", [0, 3])
def test_first_wins_meets_on_joint_lists(spark, least, num, den, rare):
    rng = random.Random(den)
    vocabulary = [f"v{i}" for i in range(20)]
    rows = [(i, " ".join(rng.sample(vocabulary[: rng.choice([4, 8, 20])], rng.randrange(0, 5)))) for i in range(120)]
    rows += [(200 + i, " ".join(rng.sample(vocabulary, 14))) for i in range(30)]
    texts = spark.createDataFrame(rows, "id long, text string")
    assert {r["id"]: r["kept"] for r in firstwins.first_wins(texts, least, 10_000, rare).rows.collect()} == first_wins_brute(rows, num, den)


@pytest.mark.parametrize("least, num, den, short", [(0.8, 4, 5, 10_000), (0.5, 1, 2, 10_000), (0.8, 4, 5, 12)])
def test_first_wins_of_large_sets(spark, least, num, den, short):
    """Sets of which similar ones share several lists, on both sides of the threshold, by pairs and by leaders."""
    rng = random.Random(num * short)
    words = [f"v{i}" for i in range(3000)]
    bases = [rng.sample(words, n) for n in (70, 140, 300, 600)]
    rows = []
    for i in range(120):
        base = bases[i % 4]
        away = rng.sample(base, round(len(base) * rng.choice([0.02, 0.1, 0.11, 0.12, 0.3, 0.34, 0.5])))
        rows.append((i, " ".join([w for w in base if w not in set(away)] + [f"own{i}x{k}" for k in range(rng.choice([0, len(away) // 2, len(away)]))])))
    got, found = _first_wins(spark, rows, least, short)
    assert got == first_wins_brute(rows, num, den) and 10 < sum(got.values()) < 110 and (found.leading > 0) == (short == 12)


def test_first_wins_writes_the_sets_of_compared_texts_alone(spark, monkeypatch):
    """What lies on disk: no set of a text that nothing is like, and no pair of texts that merely share frequent words."""
    rng = random.Random(9)
    rows = [(i, " ".join([*rng.sample([f"often{k}" for k in range(20)], 12), *[f"own{i}x{k}" for k in range(12)]])) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(5)]
    written = collections.Counter()

    def settle(df, name, plain=firstwins.settle):
        out = plain(df, name)
        written[name] += out.count()
        return out

    monkeypatch.setattr(firstwins, "settle", settle)
    got, _ = _first_wins(spark, rows, 0.8, 10_000)
    assert got == {i: i < 300 for i in range(305)} and written["words"] == 0 and written["sets"] == 10


def test_first_wins_deals_long_lists_out():
    """Every pair of a list is found once, whether the list is one or several."""
    rng, rule = np.random.default_rng(2), firstwins._Rule(Fraction(1, 2))
    sets = [rng.choice(1000, 12, replace=False).tolist() if i % 3 else [*range(11), 2000 + i] for i in range(90)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(90), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])
    found = []
    for level in (40, 4 * (firstwins.LONG + 3)):
        held = types.SimpleNamespace(value=np.full(firstwins.CELLS, level, np.uint8))
        posted = pa.Table.from_batches(firstwins._posted(firstwins._ordered(iter([batch]), held, rule), held, rule, True)).sort_by("token")
        pairs = collections.Counter()
        for r in pa.Table.from_batches(firstwins._met(iter(posted.to_batches(64)), rule, 50)).to_pylist():
            pairs[r["a"], r["b"]] += r["shared"]
        found.append((posted.num_rows, pairs))
    assert found[0][1] == found[1][1] and len(found[0][1]) >= 30 * 29 // 2 and found[1][0] == 8 * found[0][0]


def test_first_wins_of_nothing(spark):
    assert _first_wins(spark, [], 0.8, 64)[0] == {}


# ---- lexical index


def _ranked(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def _corpus(spark, n=400):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    text = lambda k: " ".join(words[min(199, int(rng.expovariate(0.03)))] for _ in range(k))
    chunks = [(i * 7, text(rng.randrange(1, 60))) for i in range(n)] + [(5000 + i, text(10) + " 晶圆良率 low-k") for i in range(20)] + [(9000, None), (9001, ""), (9002, "!!")]
    queries = [(i, text(rng.randrange(1, 25))) for i in range(12)] + [(50, "晶圆良率 low-k"), (51, None), (52, "nowhere"), (53, chunks[3][1]), (54, "w0 w0 w1")]
    return spark.createDataFrame(queries, "query_id long, question string"), spark.createDataFrame(chunks, "chunk_id long, content string")


def test_coverage_is_counted_where_the_chunks_are(spark, monkeypatch):
    queries, chunks = _corpus(spark, 60)
    scored = lambda least: sorted(map(tuple, lexical.coverage_scores(queries, chunks, least).collect()))
    assert "Exchange" not in lexical.coverage_scores(queries, chunks, 0.3)._jdf.queryExecution().executedPlan().toString()
    counted = [scored(least) for least in (0.0, 0.3, 1.0)]
    assert lexical.coverage_scores(queries.filter("query_id = 51"), chunks).count() == 0
    monkeypatch.setattr(lexical, "CELLS", 64)
    assert scored(0.3) == counted[1]
    monkeypatch.setattr(lexical, "VOCABULARY", 3)
    assert counted == [scored(least) for least in (0.0, 0.3, 1.0)] and counted[2]


@pytest.mark.parametrize("block, batch", [(256, 1024), (16, 5)])
def test_lexical_index_equals_the_scan(spark, tmp_path, block, batch):
    queries, chunks = _corpus(spark)
    lexical_index.build(chunks, str(tmp_path / "index"), block=block)
    index = lexical_index.Index(spark, str(tmp_path / "index"))  # as a later application opens it
    scores = lexical.bm25_scores(queries, chunks)
    assert _ranked(lexical_index.search(index, queries, 4, batch_size=batch)) == _ranked(lexical._ranked(scores, 4))
    for least in (0.0, 0.4):
        cover = lexical.coverage_scores(queries, chunks, least)
        assert _ranked(lexical_index.search(index, queries, 3, "coverage", least)) == _ranked(lexical._ranked(cover, 3))


def test_lexical_index_keeps_block_maxima(spark, tmp_path):
    _, chunks = _corpus(spark, 60)
    index = lexical_index.build(chunks, str(tmp_path / "index"), block=8)
    row = index.lists.selectExpr("most = array_max(parts) AS same", "size(chunks) <= 8 AND size(chunks) = size(parts) AS short").distinct().collect()
    assert [tuple(r) for r in row] == [(True, True)]
    assert "Exchange" not in index.lists.filter("term = 'w3'")._jdf.queryExecution().executedPlan().toString()


def test_lexical_index_counts_where_tokens_are_cut(spark, tmp_path, monkeypatch):
    """No row for each token is dealt out, and postings of a term and block that several tasks hold become one row in order."""
    seen, settle = [], lexical_index.settle
    monkeypatch.setattr(lexical_index, "settle", lambda df, name: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df, name))
    monkeypatch.setattr(lexical_index, "_TOKENS", 5)
    rows = [(i * 7 % 90, f"a {'b ' * (i % 4)}w{i % 5}") for i in range(90)] + [(3, None), (200, ""), (5, "a a x"), (5, "x x a"), (-1, "a 中文字")]
    index = lexical_index.build(spark.createDataFrame(rows, "chunk_id long, content string").repartition(5), str(tmp_path / "index"), block=16)
    assert "Generate" not in "".join(seen)
    tokens = [(i, re.findall("[a-z0-9]+", t or "") + (["中文", "文字"] if "中" in (t or "") else [])) for i, t in rows]
    counts = collections.Counter((t, i, len(ts)) for i, ts in tokens for t in ts)
    mean = sum(counts.values()) / len(rows)
    want = {}
    for (t, i, dl), tf in sorted(counts.items()):
        want.setdefault((t, i // 16), []).append((i, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 9)))
    got = index.lists.collect()
    assert {(r["term"], r["block"]): list(zip(r["chunks"], [round(x, 9) for x in r["parts"]], strict=True)) for r in got} == want and len(got) == len(want)


def test_tokens_of_a_batch_are_those_of_the_patterns(spark):
    """Joints at the ends of texts and of runs, letters of two and three bytes, runs of ideographs that end with a text, slices of a batch."""
    rng = random.Random(7)
    odd = ["", "a", ".", "a.", ".b", "a.b", "a..b", "a._b", "a/b-c_d.e", "-a-", "K\u212a\u0130ſ", "é.a", "a.é", "ABC-12", "中", "中文", "中文字a", "a中", "中.文", "\u4dff\u4e00\u9fff\ua000", "文" * 5, "low-k 晶圆 热", "\u0000a\nb", "😀a"]
    odd += ["".join(rng.choice("aZ9._/- é中文\u4dff😀") for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate([*odd, None])), "chunk_id long, content string")
    own = lexical.F.concat(lexical.text.ascii_tokens(lexical.F.col("content")), lexical.text.cjk_bigrams(lexical.F.col("content")))
    want = [sorted(r["t"]) for r in rows.select("chunk_id", own.alias("t")).orderBy("chunk_id").collect()]
    texts = lexical.lowered(rows).orderBy("chunk_id").toArrow().column("text").combine_chunks()
    for begin, size in ((0, len(texts)), (3, 50), (20, 1), (len(texts), 0), (0, 1)):
        found, row = lexical.tokens(texts.slice(begin, size))
        got = [[] for _ in range(size)]
        for t, i in zip(found.to_pylist(), row.tolist(), strict=True):
            got[i].append(t)
        assert [sorted(t) for t in got] == want[begin : begin + size]


def test_lexical_index_counts_a_term_once_for_many_blocks(spark, tmp_path, monkeypatch):
    """A row for a term and each of its blocks is made after the shuffle; texts reach the tasks whole, not as lists of tokens."""
    seen, settle = {}, lexical_index.settle
    monkeypatch.setattr(lexical_index, "settle", lambda df, name: seen.update({name: (df._jdf.queryExecution().optimizedPlan().toString(), settle(df, name))}) or seen[name][1])
    chunks = spark.createDataFrame([(i - 40, f"a {'b ' * (i % 3)}w{i}") for i in range(640)], "chunk_id long, content string").coalesce(1)
    index = lexical_index.build(chunks, str(tmp_path / "index"), block=4)
    plan, raw = seen["postings"]
    assert "regexp_extract_all" not in plan and raw.filter("term = 'a'").count() == 4  # spans of 256 ids from -256 on
    assert index.lists.filter("term = 'a'").count() == 160 and index.lexicon.filter("term = 'a'").first()["df"] == 640
    assert [r["chunks"] for r in index.lists.filter("term = 'a'").orderBy("block").collect()] == [list(range(i, i + 4)) for i in range(-40, 600, 4)]


def test_hybrid_retrieval_cuts_found_documents_alone(spark, sf, monkeypatch):
    from attesta.plans import retrieval_queries as queries

    seen, settle = {}, queries.settle
    monkeypatch.setattr(queries, "settle", lambda df, name: seen.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or settle(df, name))
    assert queries.hybrid_retrieval(spark, sf).count()
    assert "LeftSemi" in seen["hybrid"]


def test_lexical_backends(spark, tmp_path):
    queries, chunks = _corpus(spark, 40)
    index = lexical_index.build(chunks, str(tmp_path / "index"))
    named = lambda df: {(r["backend"], r["fallback_reason"]) for r in df.collect()}
    assert named(lexical_index.candidates(queries, chunks, 2, "auto", index)) == {("index", None)} and named(lexical_index.candidates(queries, chunks, 2)) == {("scan", "index_missing")}
    assert named(lexical_index.candidates(queries, chunks, 2, "scan", index, "coverage")) == {("scan", None)}
    for bad in ("index", "other"):
        with pytest.raises(ValueError):
            lexical_index.candidates(queries, chunks, 2, bad)


# ---- dense index


def test_dense_index_equals_the_comparison_with_all(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.3).tolist()) for i in range(600)] + [(2000 + i, centres[0].tolist()) for i in range(80)]
    odd = [(900, [0.0] * 16), (901, []), (902, None), (903, [float("nan")] * 16), (904, [1.0, 2.0]), (905, [1.0, 2.0, None]), (1, [-1.0, -2.0])]
    v = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>")
    asks = spark.createDataFrame([(i, x) for i, x in rows[:20]] + [(500, [3.0, 1.0]), (501, [0.0] * 16), (502, None), (503, [-float(c) for c in centres[3]])], "query_id long, embedding array<double>")
    found = dense_index.search(dense_index.build(v, row=64), asks, 4)
    assert _ranked(found.rows) == _ranked(dense.cosine_topk(asks, v, 4))
    assert found.compared < found.possible * 0.4  # clusters are skipped
    assert _ranked(dense_index.search(dense_index.build(v, row=64), asks, 4, pass_=7).rows) == _ranked(found.rows)
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    assert dense_index.search(dense_index.build(none), asks, 4).rows.count() == 0


# ---- keyed store


def _files(path):
    return {str(f): os.stat(f).st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_store_writes_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    store = KeyedStore(spark, path, "id", "id long, v string, n long", 8)
    assert store.read().count() == 0
    store.upsert(spark.createDataFrame([(i, "a", 1) for i in range(100)], "id long, v string, n long"), "n")
    before = _files(path)
    time.sleep(0.01)
    new = spark.createDataFrame([(3, "b", 2), (3, "c", 3), (1000, "d", 1), (None, "x", 1)], "id long, v string, n long")
    touched = store.upsert(new, "n")
    after = _files(path)
    assert touched <= 2 and sum(after.get(f) == t for f, t in before.items()) == len(before) - touched
    want = {i: ("a", 1) for i in range(100)} | {3: ("c", 3), 1000: ("d", 1)}
    read = lambda s: {r["id"]: (r["v"], r["n"]) for r in s.read().collect()}
    assert read(store) == want
    store.upsert(new, "n")  # again, as after a failure
    assert read(store) == want
    store.delete(spark.createDataFrame([(i,) for i in range(50)] + [(None,), (77777,)], "id long"))
    assert read(KeyedStore(spark, path, "id", "id long, v string, n long", 8)) == {i: v for i, v in want.items() if i >= 50}
    store.delete(store.read().select("id"))
    assert read(store) == {}  # partitions that lose all rows are written too


def test_store_reads_the_partitions_of_its_keys(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "id", "id string, v long", 16)
    store.replace(spark.createDataFrame([(f"k{i}", i) for i in range(200)], "id string, v long"))
    found = store.of("k7", "k9")
    assert sorted(tuple(r) for r in found.collect()) == [("k7", 7), ("k9", 9)] and store.of().count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


# ---- ingestion


def _ingestion(spark, path):
    return Ingestion(spark, str(path), lambda rows, column: ingest.with_digest_vectors(rows, column, 8), "fixed", 20, 5, buckets=4)


def _held(store):
    return sorted((r["doc_id"], r["idx"], r["content"]) for r in store.chunks.read().collect())


def _cut(spark, docs):
    from attesta.operators import chunking

    return sorted((r["doc_id"], r["idx"], r["content"]) for r in chunking.chunks(spark.createDataFrame([(i, t) for i, _, t in docs if t and i is not None], "doc_id long, text string"), "fixed", 20, 5).collect())


def test_second_run_over_equal_documents_embeds_nothing(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, filename string, text string")
    store = _ingestion(spark, tmp_path)
    docs = [(1, "a", "x" * 70), (2, "b", "y" * 10), (3, "c", "z" * 45), (4, "d", ""), (5, "e", None), (None, "f", "lost")]
    assert store.run(make(docs), 0, complete=True) == {"added": 4, "changed": 0, "unchanged": 0, "deleted": 0, "embedded": len(_cut(spark, docs))}
    assert store.run(make(docs), 1, complete=True) == {"added": 0, "changed": 0, "unchanged": 4, "deleted": 0, "embedded": 0}
    later = [(1, "a", "x" * 15), (2, "b", "y" * 10), (6, "g", "w" * 30)]  # 1 is shorter, 3 and 4 are gone
    assert store.run(make(later), 2, complete=True) == {"added": 1, "changed": 1, "unchanged": 1, "deleted": 2, "embedded": 1 + len(_cut(spark, later[2:]))}
    assert _held(store) == _cut(spark, later)  # no chunk of the longer text is left
    assert store.run(make(docs), 2, complete=True) is None and _held(store) == _cut(spark, later)  # a batch id counts once
    assert store.run(make([(2, "b", None), (9, "n", "new text")]), 3) == {"added": 1, "changed": 0, "unchanged": 0, "deleted": 1, "embedded": 1}
    assert {r["doc_id"]: r["chunks"] for r in store.state.read().collect()} == {1: 1, 6: 2, 9: 1}
    assert store.run(make([(1, "renamed", "x" * 15)]), 4)["changed"] == 1


def test_ingestion_writes_chunks_twice_at_most(spark, tmp_path, monkeypatch):
    """Once as they are cut, once in the store; texts are neither sorted nor joined to their own names."""
    from attesta.operators import ingestion
    from attesta.sources import store as stored

    seen, settle = [], stored.settle
    for module in (ingestion, stored):
        monkeypatch.setattr(module, "settle", lambda df, name: seen.append((name, "content" in df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or settle(df, name))
    store = _ingestion(spark, tmp_path)
    docs = [(i, f"f{i}", "x" * (i * 9)) for i in range(1, 9)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, filename string, text string")
    store.run(make(docs), 0, complete=True)
    assert [name for name, content, _ in seen if content] == ["chunks"]
    assert [plan.count("Join") for name, _, plan in seen if name == "chunks"] == [0] and "Aggregate" not in next(plan for name, _, plan in seen if name == "changes")
    later = [(i, f, t[:-4] + "y" if i % 2 else t) for i, f, t in docs]
    store.run(make([*later, (3, "a", "earlier name")]), 1, complete=True)
    assert _held(store) == _cut(spark, later)


def test_a_run_that_failed_is_repeated(spark, tmp_path, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, filename string, text string")
    store = _ingestion(spark, tmp_path)
    store.run(make([(1, "a", "x" * 50), (2, "b", "y" * 50)]), 0)
    monkeypatch.setattr(store.state, "replace", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    batch = make([(1, "a", "x" * 10), (3, "c", "z" * 30)])
    with pytest.raises(RuntimeError):
        store.run(batch, 1)
    monkeypatch.undo()
    assert store.run(batch, 1)["changed"] == 1
    assert _held(store) == _cut(spark, [(1, "a", "x" * 10), (2, "b", "y" * 50), (3, "c", "z" * 30)])


def test_ingestion_of_a_stream(spark, tmp_path):
    schema = "doc_id long, filename string, text string"
    store = _ingestion(spark, tmp_path / "store")
    for rows in ([(1, "a", "x" * 50), (2, "b", "y" * 20)], [(1, "a", "x" * 8), (2, "b", "y" * 20)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination()
    assert _held(store) == _cut(spark, [(1, "a", "x" * 8), (2, "b", "y" * 20)])
    assert {r["batch_id"] for r in store.batches.read().collect()} == {0, 1}


# ---- chunk table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def windows(spark):
    rows = [(f"kb{d % 3}", d, i, f"text {d} {i}") for d in range(60) for i in range(4)]
    table = ChunkTable(spark, "chunks_of_test", 4).write(spark.createDataFrame(rows, "kb_id string, doc_id long, idx long, content string"))
    yield table
    spark.sql("DROP TABLE chunks_of_test")


def test_chunk_table_prunes_bases(spark, windows):
    own = windows.read("kb1")
    assert own.count() == 80 and windows.read().count() == 240
    assert "kb_id" in _plan(own).split("PartitionFilters: [")[1].split("]")[0]
    bases = spark.createDataFrame([("kb2", "x")], "kb_id string, name string").filter("name = 'x'")
    assert windows.read().join(F.broadcast(bases), "kb_id").count() == 80


def test_chunk_table_looks_up_without_moving_chunks(spark, windows):
    places = spark.createDataFrame([("kb1", 1, 2, "a"), ("kb1", 2, 2, "wrong base"), ("kb2", 2, 9, "no such place")], "kb_id string, doc_id long, idx long, note string")
    found = windows.at(places)
    assert [(r["doc_id"], r["idx"], r["content"], r["note"]) for r in found.collect()] == [(1, 2, "text 1 2", "a")]
    for df in (found, windows.of_documents(places.select("kb_id", "doc_id"))):
        plan = df._jdf.queryExecution().sparkPlan().toString()  # before exchanges that joins ask for
        assert plan.count("Bucketed: true") == 1
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            again = windows.at(places) if df is found else windows.of_documents(places.select("kb_id", "doc_id"))
            assert _plan(again).count("Exchange ") == 1  # only the places move
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_chunk_table_neighbours(spark, windows):
    seeds = spark.createDataFrame([(1, "kb0", 0, 0, 0.5), (1, "kb0", 0, 1, 0.9), (1, "kb1", 4, 3, 1.0), (2, "kb2", 5, 2, 0.4)], "query_id long, kb_id string, doc_id long, idx long, score double")
    got = {(r["query_id"], r["doc_id"], r["idx"], round(r["score"], 6), r["kind"]) for r in windows.neighbours(seeds, 1, 2).collect()}
    assert got == {(q, d, i, s, "seed") for q, _, d, i, s in [tuple(r) for r in seeds.collect()]} | {(1, 4, 2, 0.95, "neighbour"), (1, 0, 2, 0.855, "neighbour"), (2, 5, 1, 0.38, "neighbour"), (2, 5, 3, 0.38, "neighbour")}


# ---- scans


def test_scans_add_up_where_the_chunks_are(spark, monkeypatch):
    """The best chunks of both kinds come from one cut without postings, and equal those of all scores and of postings."""
    queries, chunks = _corpus(spark, 150)
    full, names, settle = lexical._ranked(lexical.bm25_scores(queries, chunks), 4), [], lexical.settle
    want = [_ranked(full), *[_ranked(lexical._ranked(lexical.coverage_scores(queries, chunks, least), 3)) for least in (0.0, 0.4)]]
    gold = sorted(map(tuple, lexical.coverage_scores(queries, chunks, 1.0).collect()))
    monkeypatch.setattr(lexical, "settle", lambda df, name: names.append(name) or settle(df, name))
    scans = lambda: [_ranked(lexical.bm25_topk(queries, chunks, 4)), *[_ranked(lexical.coverage_topk(queries, chunks, 3, least)) for least in (0.0, 0.4)]]
    assert scans() == want and names == ["counts"]
    held = lexical.Counts(queries, chunks)
    assert sorted(map(tuple, held.coverage(1.0).collect())) == gold and gold and _ranked(held.bm25(4)) == want[0] and names == ["counts", "counts"]
    with monkeypatch.context() as m:
        m.setattr(lexical, "CELLS", 64)
        m.setattr(lexical, "ROWS", 3)
        assert scans() == want
    monkeypatch.setattr(lexical, "VOCABULARY", 3)
    assert scans() == want and "postings" in names
    assert lexical.bm25_topk(queries.filter("query_id = 51"), chunks).count() == 0


def test_parts_are_scored_where_the_documents_are(spark, monkeypatch):
    """All parts of a document of which one covers enough, without postings of all parts; the same from postings and from few documents at a time."""
    queries, chunks = _corpus(spark, 90)
    rows = [(i, [r["content"] for r in part if r["content"]]) for i, part in enumerate(chunks.collect()[j : j + 3] for j in range(0, 113, 3))] + [(900, []), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, parts array<string>")
    every = [(q, c // 1000, c % 1000, s) for q, c, s in map(tuple, lexical.coverage_scores(queries, docs.select("doc_id", F.posexplode("parts").alias("i", "content")).selectExpr("doc_id * 1000 + i AS chunk_id", "content")).collect())]
    admitted = {(q, doc) for q, doc, _, s in every if s >= 0.6}
    want = sorted(x for x in every if x[:2] in admitted)
    scored = lambda: sorted(map(tuple, lexical.part_scores(queries, docs, 0.6).collect()))
    with monkeypatch.context() as m:
        m.setattr(lexical, "postings", None)
        assert scored() == want and 0 < len(want) < len(every) and any(s < 0.6 for *_, s in want)
        m.setattr(lexical, "CELLS", 40)
        assert scored() == want
    monkeypatch.setattr(lexical, "VOCABULARY", 3)
    assert scored() == want


def test_chunk_table_deals_a_large_bucket_to_several_tasks(spark):
    from attesta.plans import store_queries

    rows = spark.range(4000).selectExpr("concat('kb', id % 2) AS kb_id", "id AS doc_id", "0L AS idx", "repeat(sha2(cast(id AS string), 512), 4) AS content").repartition(8)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        table = ChunkTable(spark, "large_chunks_of_test", 2).write(rows)
        assert len(table.read("kb0").inputFiles()) > 4 and table.read().count() == 4000
        places = rows.filter("doc_id % 100 = 7").select("kb_id", "doc_id", "idx", F.lit(1).alias("n"))
        assert sorted(r["doc_id"] for r in table.at(places).collect()) == list(range(7, 4000, 100))
    finally:
        spark.conf.set(key, before)
        spark.sql("DROP TABLE IF EXISTS large_chunks_of_test")
    assert not hasattr(store_queries, "lexical_index")  # the query scans once and builds no index for its own documents


def test_scan_backend_writes_no_postings(spark, monkeypatch):
    queries, chunks = _corpus(spark, 40)
    monkeypatch.setattr(lexical, "postings", None)
    assert {r["fallback_reason"] for r in lexical_index.candidates(queries, chunks, 2).collect()} == {"index_missing"}
