"""op6, op10 and the pipeline: held-out accuracy, exact inference, edge rows."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import quality, toxicity
from attesta.llm.shared import read

from .conftest import EDGES

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(3)
    f = toxicity.Field()
    f.start, f.move = 0.4, rnd.normal(size=(2, 2))
    for n in (1, 2, 5):
        e = rnd.normal(size=(3, n))
        p, steps = f.marginals(e, pairs=True)
        expected = np.zeros((2, 2))
        for r in range(3):
            weight = {}
            for tags in itertools.product((0, 1), repeat=n):
                s = f.start * tags[0] + sum(e[r, i] * t for i, t in enumerate(tags)) + sum(f.move[a, b] for a, b in itertools.pairwise(tags))
                weight[tags] = np.exp(s)
            z = sum(weight.values())
            assert np.allclose(p[r], [sum(w for t, w in weight.items() if t[i]) / z for i in range(n)])
            for t, w in weight.items():
                for a, b in itertools.pairwise(t):
                    expected[a, b] += w / z
        assert np.allclose(steps, expected)


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, SF, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["predicted"], t) for i, t in labels.items() if i in got and got[i]["held_out"]]
    assert np.mean([p == t for p, t in held]) > 0.9


def test_toxicity_spans_and_edges(spark, make):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(10, 410):
        w = [f"w{rnd.randrange(200)}" for _ in range(40)]
        if i % 3 == 0:
            w[rnd.randrange(40)] = "awful"
        rows.append((i, "ünï " + " ".join(w)))
        labels.append((i, int(i % 3 == 0), 1))
    df = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = {r["doc_id"]: r for r in toxicity.score(make(rows + EDGES), df).collect()}
    hit = [i for i, t, _ in labels if t]
    assert np.mean([out[i]["predicted"] for i in hit]) > 0.95 and np.mean([out[i]["predicted"] for i, t, _ in labels if not t]) < 0.05
    text = dict(rows)
    assert all(text[i][s["start"] : s["end"]] == "awful" for i in hit for s in out[i]["spans"])
    assert out[1]["predicted"] == 0 and out[1]["spans"] == [] and out[2]["score"] == out[1]["score"]
    none = toxicity.score(make(EDGES), df.limit(0)).collect()
    assert len(none) == len(EDGES) and all(r["score"] == 0 for r in none)
    assert toxicity.score(make(rows).limit(0), df).count() == 0


def test_quality_held_out(spark):
    """Scores of documents whose labels were not shown."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    shown = labels.filter("doc_id % 4 <> 0")
    got = {r["doc_id"]: r for r in quality.judge(docs, shown, ["doc_id"]).select("row.doc_id", "score", "keep", "p_text", "p_page").collect()}
    hidden = [(got[r["doc_id"]]["keep"], r["quality"] == 1) for r in labels.filter("doc_id % 4 = 0").collect() if r["doc_id"] in got]
    assert np.mean([a == b for a, b in hidden]) > 0.93
    assert np.mean([k for k, good in hidden if good]) > 0.97


def test_quality_edges(spark, make):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 200)], "doc_id long, quality int")
    rows = [(i, f"some normal sentence number {i}." if i % 2 else "| | | ## " * 5) for i in range(10, 200)]
    docs = make(rows + EDGES)
    out = quality.drop_rejected(docs, labels)
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and all(i % 2 for i in kept if i is not None and i >= 10)
    assert quality.judge(docs, labels.limit(0)).filter("keep and score = 0.5").count() == len(rows) + len(EDGES)
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs.select("doc_id", "text"), labels).count() == len(rows) + len(EDGES)


def test_pipeline_stages(spark):
    """Each stage on its own input against a plain version of its rule."""
    from .test_decontamination import brute as contaminated
    from .test_native import lines_brute
    from .test_near_duplicates import brute as near

    docs = read(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece_encoding"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns
    scores = {r["doc_id"]: r["keep"] for r in quality.op10_quality_classifier(spark, SF).collect()}
    held = first.collect()
    assert {r["doc_id"] for r in held} == {i for i, k in scores.items() if k}
    first = spark.createDataFrame(held, first.schema)
    second = corpus_pipeline.STAGES[1][1](spark, first, SF)
    rows = second.collect()
    want = {r[0]: r[1] for r in lines_brute([(r["doc_id"], r["text"], r["source"] or "") for r in held])}
    assert {r["doc_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)
    third = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(rows, second.schema), SF)
    low = near([(r["doc_id"], r["text"]) for r in rows])
    kept = third.collect()
    assert {r["doc_id"] for r in kept} == {i for i, c in low.items() if i == c} and len(kept) == len({r["doc_id"] for r in kept})
    fourth = corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(kept, third.schema), SF)
    bench = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in kept], bench) if not r[4]}
    last = fourth.collect()
    assert {r["doc_id"] for r in last} == clean and fourth.columns == docs.columns
    fifth = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(last, fourth.schema), SF)
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    assert {r["doc_id"]: r["ids"] for r in fifth.collect()} == {r["doc_id"]: library.encode(r["text"] or "") for r in last}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edges(spark, tmp_path, empty):
    """Null and empty texts, rows and ids that repeat, null ids, extra columns with the operators' own names; and no documents at all."""
    said = "a normal sentence with quite a few words that go on for a while and end here"
    rows = [(i, f"{said} {i}." if i % 2 else "| | | ## " * 5, "en", "s", 10) for i in range(10, 130)]
    odd = [(1, None, None, None, None), (2, "", "en", None, 0), (3, said, "en", "s", 5), (3, said, "en", "s", 5), (None, f"{said} none", "en", "s", 5), (4, "x" * 300_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("own") for c in ("row", "lines", "kept", "n_lines", "hit", "label", "keep", "score", "id")})
    (docs.limit(0) if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10, 130)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "nothing of the kind")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert got == [] if empty else {i for i in got if i is not None and i > 9} <= set(range(11, 130, 2)) and got.count(3) <= 1 and len(got) > 0


def test_document_features():
    """What the scores of documents are made of, against the definition."""
    rng = np.random.default_rng(1)
    p, first = rng.random(50) * rng.random(50) ** 4, np.array([0, 0, 7, 8, 50])
    got = toxicity.document_features(p, first)
    for i in range(4):
        own = p[first[i] : first[i + 1]]
        none = min(float(np.log1p(-own).sum()), -1e-9)
        want = [np.clip(np.log(-np.expm1(none)) - none, -20, 20), np.log1p(own.sum()), np.log((own.sum() + 0.01) / (len(own) + 20))]
        assert np.allclose(got[i], want)


def test_quality_scores_are_the_model(spark):
    """Every score is the calibrated combination of both views, document by document."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    m = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.judge(docs, labels, ["doc_id"]).select("row.doc_id", "score").collect()}
    assert m is not None
    for r in docs.limit(25).collect():
        (_, _, a, b), = quality.features(pa.array([r["text"]]), [r["source"]], [r["lang"]], [float(r["n_chars"])])
        la, lb = (m["platt"][v].logit(m["models"][v].logit(x)[:, None]) for v, x in ((0, a), (1, b)))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-m["both"].logit(np.c_[la, lb])[0]))) < 1e-6


@pytest.mark.parametrize("name", list(corpus_pipeline.QUERIES))
def test_run(spark, name):
    assert corpus_pipeline.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
