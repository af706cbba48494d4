"""Operators on small tables, against plain Python where a rule is sequential."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import analyzer, automaton, budget, chunking, critic, dense, evaluation, evidence, feeds, fusion, governance, grounding, ingest, lexical
from attesta.plans import retrieval_queries, sqlguard
from attesta.sources import tables
from attesta.streaming import events


def test_chunker_traps():
    assert len(chunking.split_text("ab " * 160)) == 2 and len(chunking.split_text("ab " * 150)) == 1
    assert chunking.split_text(None) == [] and chunking.split_text("   ") == []
    words = " ".join("word%d." % i for i in range(400))
    parts = chunking.split_text(words)
    assert all(len(p) <= 500 for p in parts) and parts[0].endswith(".")
    assert all(w in "".join(parts) for w in ("word0.", "word399."))


def test_markdown_chunker():
    got = chunking.split_markdown("intro\n# A\ntext\n## B\nmore")
    assert got == ["intro", "文档位置：A\n\ntext", "文档位置：A > B\n\nmore"]


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "a" * 960), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["idx"]): len(r["content"]) for r in chunking.chunks(df, "fixed").collect()}
    assert got == {(1, 0): 500, (1, 1): 500, (1, 2): 60}


def test_pack_equals_fold(spark):
    rnd = random.Random(3)
    rows = [(g, d, round(rnd.random(), 3), rnd.randint(100, 3000)) for g in range(5) for d in range(30)]
    got = {(r["group_id"], r["doc_id"]): r["position"] for r in budget.pack(spark.createDataFrame(rows, "group_id long, doc_id long, weight double, tokens long")).collect()}
    want = {}
    for g in range(5):
        used, n = 0, 0
        for _, d, _, t in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if n < 10 and used + t <= 6000:
                used, n = used + t, n + 1
                want[g, d] = n
    assert got == want


@pytest.mark.parametrize("sizes", [(100, 3000), (500, 700), (0, 40)])
def test_pack_past_oversize_documents(spark, sizes):
    """More than 200 candidates that never fit come first, then more than 200 that might."""
    rnd = random.Random(5)
    rows = [(g, d, 1 + rnd.random(), rnd.randint(6001, 20_000)) for g in range(3) for d in range(250)]
    rows += [(g, d, round(rnd.random(), 2), rnd.randint(*sizes)) for g in range(3) for d in range(250, 900)]
    got = {(r["group_id"], r["doc_id"]): r["position"] for r in budget.pack(spark.createDataFrame(rows, "group_id long, doc_id long, weight double, tokens long")).collect()}
    want = {}
    for g in range(3):
        used, n = 0, 0
        for _, d, _, t in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if n < 10 and used + t <= 6000:
                used, n = used + t, n + 1
                want[g, d] = n
    assert got == want and {g for g, _ in got} == {0, 1, 2}


def test_suffix_budget(spark):
    df = spark.createDataFrame([(1, t, "x" * 30) for t in range(10)], "conv_id long, turn long, text string")
    assert sorted(r["turn"] for r in budget.suffix(df, 35).collect()) == [7, 8, 9]


def test_admission_and_neighbours(spark):
    hits = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, None), (1, 1, 1, 0.1, 0.0, None), (1, 2, 0, 0.1, 0.0, 0.0)], "query_id long, doc_id long, idx long, vector double, lexical double, strict double")
    kept = fusion.admit_documents(hits, 0.5)
    assert sorted((r["doc_id"], r["idx"]) for r in kept.collect()) == [(1, 0), (1, 1)]
    chunks = spark.createDataFrame([(1, i) for i in range(5)], "doc_id long, idx long")
    seeds = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 0.5)], "query_id long, doc_id long, idx long, score double")
    got = {(r["idx"], r["kind"], r["score"]) for r in fusion.add_neighbours(seeds, chunks).collect()}
    assert got == {(1, "seed", 1.0), (2, "seed", 0.5), (0, "neighbour", 0.95), (3, "neighbour", 0.475)}


def test_facet_seats_of_many_hits(spark):
    """Against the rule over all hits: few documents with many chunks, then many documents."""
    rnd = random.Random(8)
    for docs, top_k in ((3, 5), (40, 7)):
        rows = [(1, c, rnd.randrange(docs), round(rnd.random(), 2), [round(max(0.0, rnd.random() - 0.5), 2) for _ in range(4)]) for c in range(400)]
        free, used, of, want = sorted(rows, key=lambda r: (-r[3], r[1])), set(), {}, []
        for f in [*range(4), *[None] * top_k]:
            fit = [r for r in free if r[1] not in used and of.get(r[2], 0) < 3 and (f is None or r[4][f] > 0)]
            if fit and len(want) < top_k:
                r = fit[0] if f is None else max(fit, key=lambda r: (r[4][f], r[3], -r[1]))
                used.add(r[1])
                of[r[2]] = of.get(r[2], 0) + 1
                want.append(r[1])
        df = spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id long, score double, facets array<double>")
        assert [r["chunk_id"] for r in fusion.facet_seats(df, top_k).orderBy("seat").collect()] == want


def test_facet_seats(spark):
    rows = [(1, c, c % 2, 1.0 - c / 10, [0.0 if c < 3 else 1.0, 0.5]) for c in range(6)]
    got = [r["chunk_id"] for r in fusion.facet_seats(spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id long, score double, facets array<double>"), 4).orderBy("seat").collect()]
    assert got == [3, 0, 1, 2]


def _facet_rule(questions, texts):
    """Seats of questions (id, text) over texts (id, text), by the rule over all windows."""
    terms = lambda t: list(dict.fromkeys(re.findall(r"[a-z0-9]+(?:[._/-][a-z0-9]+)*", t.lower())))
    windows = [(d * 1_000_000 + i, d, set(terms(t[450 * i : 450 * i + 500]))) for d, t in texts if t for i in range(max(0, -(-(len(t) - 500) // 450)) + 1)]
    out = {}
    for q, text_ in questions:
        t = terms(text_)
        halves = [t[: -(-len(t) // 2)], t[-(-len(t) // 2) :]]
        share = lambda part, held: round(len(held & set(part)) / len(part), 9) if part else 0.0
        rows = [(c, d, share(t, held), [share(h, held) for h in halves]) for c, d, held in windows]
        rows = sorted((r for r in rows if r[2] >= 0.3), key=lambda r: (-r[2], r[0]))
        seats = []
        for f in [0, 1, *[None] * 5]:
            free = [r for r in rows if r not in seats and sum(s[1] == r[1] for s in seats) < 3 and (f is None or r[3][f] > 0)]
            if free and len(seats) < 5:
                seats.append(free[0] if f is None else max(free, key=lambda r: (r[3][f], r[2], -r[0])))
        out |= {(q, n): r[0] for n, r in enumerate(seats, 1)}
    return out


def test_facet_selection_takes_the_halves_of_the_terms(spark, sf, tmp_path):
    """Each half's best window has its seat, though other windows cover more of the whole."""
    texts = [(1, "alpha beta delta"), (2, "delta epsilon zeta"), (3, "gamma beta epsilon zeta"), (4, "alpha beta gamma"), (5, "alpha"), (6, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "Alpha beta gamma delta epsilon zeta alpha"), (2, "alpha"), (3, "!"), (4, "beta nowhere")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query_id"], r["seat"]): r["chunk_id"] for r in retrieval_queries.facet_selection(spark, str(tmp_path)).collect()}
    assert got == _facet_rule(asked, texts[:5]) and [got[1, n] // 1_000_000 for n in (1, 2, 3)] == [4, 2, 3]
    tables = [[tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()] for t, c in (("benchmark", ("item_id", "text")), ("documents", ("doc_id", "text")))]
    got = {(r["query_id"], r["seat"]): r["chunk_id"] for r in retrieval_queries.facet_selection(spark, sf).collect()}
    assert got == _facet_rule(*tables) and got


def test_half_scores_of_many_terms_come_from_postings(spark, monkeypatch):
    queries = spark.createDataFrame([(1, "a b c d e"), (2, "b"), (3, None)], "query_id long, question string")
    chunks = spark.createDataFrame([(1, "a b"), (2, "d e a"), (3, "b"), (4, None), (5, "c d x")], "chunk_id long, content string")
    scored = lambda: sorted((r["query_id"], r["chunk_id"], r["score"], tuple(r["halves"])) for r in lexical.half_scores(queries, chunks, 0.3).collect())
    counted = scored()
    assert counted[0] == (1, 1, 0.4, (round(2 / 3, 9), 0.0)) and (2, 3, 1.0, (1.0, 0.0)) in counted and len(counted) == 5
    monkeypatch.setattr(lexical, "VOCABULARY", 2)
    assert scored() == counted


def test_hybrid_equals_the_rule(spark):
    """Fusion, rerank and seats against plain Python: two and three variants, missing relevance and scores, ids by document and place, a failed route."""
    rnd = random.Random(4)
    for variants in (1, 3):
        rows, given = [], {}
        for q in (1, 2):
            for route in ("cloud", "local"):
                for rank, c in enumerate(rnd.sample(range(30), 15), 1):
                    by_place = c % 7 == 0
                    relevance = None if c % 5 == 0 else [round(max(0.0, rnd.random() - 0.4), 2) for _ in range(rnd.choice([variants, 1]))]
                    rows.append((q, route, None if by_place else c, c % 4, c, round(rnd.random(), 3), rank, relevance))
                    if c % 3:
                        given[q, f"{c % 4}:{c}" if by_place else str(c)] = round(rnd.random(), 1)
        want = []
        for q in (1, 2):
            merged = {}
            for r in [r for r in rows if r[0] == q]:
                key = str(r[2]) if r[2] is not None else f"{r[3]}:{r[4]}"
                m = merged.setdefault(key, {"rrf": 0.0, "doc": r[3], "routes": {}, "rel": [0.0] * variants})
                m["rrf"] += 1 / (60 + r[6])
                m["routes"][r[1]] = r[5]
                m["rel"] = [max(a, b) for a, b in zip(m["rel"], [*(r[7] or []), *[0.0] * variants], strict=False)]
            first = sorted(merged, key=lambda k: (-round(merged[k]["rrf"], 9), k))[:10]
            score = {k: given.get((q, k), round(merged[k]["rrf"], 9)) for k in first}
            first.sort(key=lambda k: -score[k])
            seats, of = [], {}
            for f in [*(range(variants) if variants > 1 else ()), *[None] * 5]:
                fit = [k for k in first if k not in seats and of.get(merged[k]["doc"], 0) < 3 and (f is None or merged[k]["rel"][f] > 0)]
                if fit and len(seats) < 5:
                    k = fit[0] if f is None else max(fit, key=lambda k: merged[k]["rel"][f])
                    seats.append(k)
                    of[merged[k]["doc"]] = of.get(merged[k]["doc"], 0) + 1
            want += [(q, i, k, score[k], merged[k]["routes"], ["local"] if q == 2 else None) for i, k in enumerate(seats, 1)]
        results = spark.createDataFrame(rows, "query_id long, route string, chunk_id long, doc_id long, idx int, score double, rank long, relevance array<double>")
        status = spark.createDataFrame([(1, "cloud", True), (1, "local", True), (2, "cloud", True), (2, "local", False)], "query_id long, route string, ok boolean")
        scores = spark.createDataFrame([(q, k, v) for (q, k), v in given.items()] * 2, "query_id long, key string, rerank_score double")
        got = [(r["query_id"], r["seat"], r["key"], r["score"], r["route_scores"], r["degraded"]) for r in fusion.hybrid(results, status, scores, variants, 5, 10).orderBy("query_id", "seat").collect()]
        assert got == want
        assert fusion.hybrid(results.filter("false"), status, scores, variants).count() == 0


def test_joint_gates(spark):
    """Every gate met, then each failed by one row; empty tables meet none."""
    def frames(bad=None):
        conversions = [("a", 2, 2), ("b", 1, 0 if bad == "adapter_conversion" else 1)]
        evidence = [(True,), (None if bad == "contract_validation" else True,)]
        cases = [(1, "x"), (2, "x"), (3, "x" if bad == "eval_structure" else "y")]
        held = [("d", i) for i in range(1, 3 if bad == "case_availability" else 4)]
        checked = [(True,)] * (2 if bad == "end_to_end_execution" else 3)
        c = spark.createDataFrame(cases, "case_id long, category string")
        available = evaluation.case_availability(c, spark.createDataFrame([(i, "d", i) for i in (1, 2, 3, 3)], "case_id long, source string, id long"), spark.createDataFrame(held, "source string, id long"))
        return spark.createDataFrame(conversions, "source string, input long, converted long"), spark.createDataFrame(evidence, "valid boolean"), c, available, spark.createDataFrame(checked, "passed boolean")

    for bad in [None, *evaluation.REPORT_GATES]:
        got = {r["gate"]: r["passed"] for r in evaluation.joint_gates(*frames(bad), {"x": 2, "y": 1}, 3).collect()}
        assert got == {g: g != bad for g in evaluation.REPORT_GATES} | {"overall": bad is None}
    empty = [f.filter("false") for f in frames()]
    assert not any(r["passed"] for r in evaluation.joint_gates(*empty, {"x": 2, "y": 1}, 3).collect())


def test_reciprocal_ranks(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 1)], "query_id long, chunk_id long, rank long")
    got = {r["chunk_id"]: r["rrf"] for r in fusion.reciprocal_ranks(df).collect()}
    assert got == {5: pytest.approx(1 / 61 + 1 / 62, abs=1e-9), 6: pytest.approx(1 / 61, abs=1e-9)}


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(dense.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, pytest.approx(1.0)]


def test_parties_and_clusters(spark):
    df = spark.createDataFrame([("采购人：中芯国际集成电路制造（上海）有限公司，中标人:华虹公司",), (None,)], "t string")
    got = df.select(governance.parties(F.col("t")).alias("p")).select("p.*").collect()
    assert got[0]["buyer"] == "中芯国际集成电路制造 有限公司" and got[0]["supplier"] == "华虹公司" and got[1]["buyer"] is None
    items = spark.createDataFrame([(1, "光刻机项目招标公告", "中芯国际"), (2, "光刻机项目中标公告", "中芯国际集成电路"), (3, "光刻机项目中标公告", "华虹"), (4, "光刻机项目", ""), (5, "光刻机项目", None)], "bid_id long, title string, buyer string")
    keys = {r["bid_id"]: r["project_key"] for r in governance.lifecycle_clusters(items).collect()}
    assert keys[1] == keys[2] and len(set(keys.values())) == 4


@pytest.mark.parametrize("beginning", [1024, 200])
def test_long_titles_fold_as_whole_ones(spark, monkeypatch, beginning):
    """The beginning of a long title gives what the whole does, at marks, types and sigmas near the cut and where it has no ASCII character too."""
    monkeypatch.setattr(governance, "BEGINNING", beginning)
    heads = ["", "采购公告" * 300, "e\u0301Ａ " * 60, " \t" * 600 + "ab", "ΑΣ" + "'" * 1100 + "a", "x" * 70 + "\u0301" * 1200, "标题" * 700, "a招标", "y" * 198 + "中标公", "é" * 500]
    titles = [h + t for h in heads for t in ("", "告 end", "\u0301z", " Σ" + "plain words " * 150, "中标公告" * 400)]
    df = spark.createDataFrame(list(enumerate(titles)) + [(-1, None)], "id long, t string")
    bare = F.regexp_replace(F.lower(text.nfkc(F.col("t"))), "|".join(governance.NOTICE_TYPES), " ")
    whole = F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, 80)
    assert df.select("id", governance.notice_title(F.col("t")).alias("a"), whole.alias("b")).filter("NOT a <=> b").collect() == []


def test_time_anchor_ranks_no_metric_in_one_task(spark):
    rows = [(str(i), f"alpha revenue {i}元", f"2024-{i % 12 + 1:02d}-01") for i in range(48)]
    e = spark.createDataFrame(rows, "evidence_id string, content string, published_at string").withColumn("as_of", F.col("published_at"))
    found = critic.time_anchor(e)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["evidence_ids"][0] == "47" or r["evidence_ids"][1] == "47" for r in found.collect()} == {True} and found.filter("subject = 'revenue'").count() == 36


def test_workers_take_small_batches(spark, monkeypatch):
    """Chunks, names and digests: Arrow functions are handed 4 MB at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a. b")], "doc_id long, text string")
    names = spark.createDataFrame([("b",)], "name string")
    for use in (lambda: chunking.chunks(docs), lambda: ingest.with_digest_vectors(docs, "text"), lambda: governance.longest_entity(docs.withColumnRenamed("doc_id", "text_id"), names)):
        spark.conf.unset(key)
        use()
        assert spark.conf.get(key) == f"{4 << 20}b"


def test_heads_of_notices_are_folded_many_a_pass(spark):
    items = spark.createDataFrame([(i, f"head {i % 7}", ["ab", "abc", "xyz", "bc", "x", "zz"][i * 5 % 6]) for i in range(60)], "bid_id long, title string, buyer string")
    found = governance.lifecycle_clusters(items)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    want, keys = {}, {}
    for i, title, buyer in items.collect():
        groups = want.setdefault(title, [])
        at = next((g for g in groups if g in buyer or buyer in g), buyer) if len(buyer) > 1 else buyer
        groups += [at] if len(buyer) > 1 and at not in groups else []
        keys[i] = (title, at)
    got = {r["bid_id"]: r["project_key"] for r in found.collect()}
    assert len(set(zip(got.values(), (keys[i] for i in got), strict=True))) == len(set(got.values())) == len(set(keys.values()))


def test_longest_entity(spark):
    texts = spark.createDataFrame([(1, "The Big Red Fox ran"), (2, "nothing"), (3, None)], "text_id long, text string")
    names = spark.createDataFrame([("red fox",), ("big red fox",), ("ran",)], "name string")
    assert [tuple(r) for r in governance.longest_entity(texts, names).collect()] == [(1, "big red fox")]


@pytest.mark.parametrize("limit", [200_000, -1])
def test_entities_in_texts_without_spaces(spark, monkeypatch, limit):
    monkeypatch.setattr(governance, "NAMES_TO_BROADCAST", limit)
    texts = spark.createDataFrame([(1, "请问长电科技股份和Ａ.Ｂ．公司如何"), (2, "none"), (3, None)], "text_id long, text string")
    registry = spark.createDataFrame([("长电", "sh1"), ("长电科技", "sh2"), ("a.b.", "sz3"), (" ", "x")], "name string, stock_code string")
    got = {r["text_id"]: (r["entity"], r["stock_code"], r["matched"], r["candidates"]) for r in governance.resolve_entities(texts, registry).collect()}
    assert got == {1: ("a.b.", "sz3", True, 3), 2: (None, None, False, 0), 3: (None, None, False, 0)}
    assert {r["entity"] for r in governance.entity_hits(texts, registry).collect()} == {"长电", "长电科技", "a.b."}


def test_automaton_equals_plain_search(monkeypatch):
    """Names inside each other, overlaps, lanes shorter than names, texts longer than a stream, characters beyond the basic plane."""
    monkeypatch.setattr(automaton, "STREAM", 64)
    rng = random.Random(5)
    for lanes in (1, 3, 4096):
        monkeypatch.setattr(automaton, "LANES", lanes)
        for letters in ("ab", "abc\U0001f600长 "):
            names = {"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(40)}
            texts = ["".join(rng.choices(letters + "x", k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(60)] + [None, ""]
            got = automaton.Automaton(list(names)).in_texts(texts)
            assert got == [sorted(n for n in names if t and n in t) for t in texts]
    assert automaton.Automaton([]).in_texts(["a", None]) == [[], []]


def test_entity_paths_agree(spark, monkeypatch):
    """The automaton, the join of runs, and names too long for the automaton give the same rows; copies of rows change nothing."""
    texts = spark.createDataFrame([(i, "x" * i + "Red Fox" + "y" * (40 - i)) for i in range(20)] * 2 + [(99, None), (100, "")], "text_id long, text string")
    names = spark.createDataFrame([("red fox",), ("RED FOX",), ("fox" + "y" * 30,), ("nowhere",), (None,), ("",)] * 2, "name string")
    rows = lambda: sorted(map(tuple, governance.entity_hits(texts, names).collect()))
    want = rows()
    assert len(want) == 2 * 20 + 11
    monkeypatch.setattr(governance, "LONGEST", 7)
    assert rows() == want
    monkeypatch.setattr(governance, "NAMES_TO_BROADCAST", -1)
    assert rows() == want
    assert governance.entity_hits(texts, names.filter("false")).count() == 0


def test_quotes_are_compared_case_folded(spark):
    claims = spark.createDataFrame([(1, 0, "zzz", [1], [(1, "DIE STRASSE\n ist lang")], None), (1, 1, "zzz", [1], [(1, "ｄie straße ist")], None)], "answer_id long, claim int, text string, citation_ids array<int>, quotes array<struct<citation_id:int,quote:string>>, uncertainty string")
    references = spark.createDataFrame([(1, 1, "Die  Straße ist lang.")], "answer_id long, citation_id int, content string")
    assert {r["claim"]: (r["accepted"], r["provenance_only"]) for r in grounding.validate_claims(claims, references).collect()} == {0: (True, True), 1: (False, False)}


def test_parties(spark):
    blob = "采购人: （某）甲乙 公司，中标人：乙，供应商:丙丁有限公司；"
    assert tuple(spark.range(1).select(governance.parties(F.lit(blob)).alias("p")).first()[0]) == ("甲乙", "丙丁有限公司")
    own = lambda x: spark.range(1).select(governance.party_key(F.lit(x))).first()[0]
    assert [own(x) for x in ("北方 (华创) 集团有限公司", "公司", "有限公司", "X公司公司", None)] == ["北方 集团", "公司", "有限", "x", ""]


def test_candidate_rules(spark):
    rows = [("t", ["packaging_testing"], "blocked", "metadata_only", "pdf", None, "https://a"), ("t", ["packaging_testing"], "link_only", "pending", "pdf", None, None), ("t", [], "blocked", "pending", "pdf", None, None), ("t", ["packaging_testing"], "blocked", "approved", "markdown", None, None), ("t", ["packaging_testing"], "blocked", "pending", "html", None, None), (" ", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "title string, domains array<string>, ingestion_policy string, review_status string, content_format string, source_url string, fulltext_url string")
    assert [r[0] for r in df.select(governance.candidate_error()).collect()] == [None, "policy_invalid", "domains_invalid", "approval_without_rights", "format_invalid", "title_empty"]


def test_order_statistics(spark):
    rnd = random.Random(9)
    rows = [(g, v) for g, n in (("a", 4001), ("b", 1), ("c", 300)) for v in [float(rnd.randrange(60)) if g == "c" else rnd.random() for _ in range(n)]] + [("d", None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in evaluation.nearest_rank(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for g in "abc":
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert [got[g, q] for q in (0.0, 0.5, 0.95, 1.0)] == [own[max(0, -int(-q * len(own) // 1) - 1)] for q in (0.0, 0.5, 0.95, 1.0)]
    assert ("d", 0.5) not in got
    late = {r["g"]: (r["n"], r["p50"]) for r in evaluation.answer_latency(df, ["g"], "v").collect()}
    assert late["b"] == (2, None) and late["d"] == (1, None)


def test_cosine_of_ragged_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, []), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, None)], "id long, embedding array<double>")
    got = dense.cosine_topk(df.filter("id = 1").select(F.col("id").alias("query_id"), "embedding"), df.select(F.col("id").alias("chunk_id"), "embedding"), 9).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(1, 1.0), (5, 1.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_similar_questions(spark):
    df = spark.createDataFrame([(1, "How long is the river?"), (2, "how long is the river"), (3, "What is the yield of a wafer?"), (4, None), (5, "?")], "id long, question string")
    assert sorted((r["a"], r["b"], r["similarity"]) for r in governance.similar_questions(df).collect()) == [(1, 2, 1.0), (4, 5, 1.0)]


def test_ground_facts(spark):
    facts = spark.createDataFrame([(1, 1, "a", 0.9), (2, 1, "zzz", 0.9), (3, 2, "zzz", 0.9)], "fact_id long, query_id long, url string, credibility double")
    results = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, url string")
    got = {r["fact_id"]: (r["url"], r["needs_verification"], r["credibility"]) for r in evidence.ground_facts(facts, results).collect()}
    assert got == {1: ("a", False, 0.9), 2: ("", True, 0.3), 3: ("c", False, 0.9)}


def test_adapters(spark):
    news = spark.createDataFrame([("1", "t", "c", "s", "https://x.cn/1", "政策", "工信部", "2024-01-01", None)], "id string, title string, content string, source string, source_url string, category string, department string, publish_time string, collected_at string")
    quote = spark.createDataFrame([("n", "sh600000", "1", "2", None, "p")], "name string, gid string, nowPri string, increPer string, as_of string, provider string")
    notice = spark.createDataFrame([("b1", "t", "招标", "p", "c", None, "2024-01-01", "", None)], "bid_id string, title string, notice_type string, province string, city string, content string, publish_time string, source string, collected_at string")
    e = evidence.from_news(news).unionByName(evidence.from_quotes(quote)).unionByName(evidence.from_notices(notice))
    got = {r["source_kind"]: r for r in evidence.issues(e).collect()}
    assert got["policy"]["quality_tier"] == "official" and got["policy"]["issues"] == []
    assert got["market_quote"]["issues"] == ["as_of_missing"] and got["bidding"]["issues"] == [] and got["bidding"]["content"] == "t"
    anchors = {r["source_kind"]: r["anchor"] for r in evidence.citation(e).collect()}
    assert anchors == {"policy": "x.cn — t", "market_quote": "sh600000", "bidding": "notice b1"}


def test_claims(spark):
    refs = spark.createDataFrame([(1, 1, "The wafer yield reached 95 in line A_1"), (1, 2, "unrelated words")], "answer_id long, citation_id int, content string")
    kind = "answer_id long, claim int, text string, citation_ids array<int>, quotes array<struct<citation_id:int,quote:string>>, uncertainty string"
    claims = spark.createDataFrame([
        (1, 0, "wafer yield reached 95", [1], None, "certain"), (1, 1, "wafer yield reached 96", [1], [(1, "wafer yield reached")], "certain"), (1, 2, "", [1], None, None),
        (1, 3, "yield", [9], None, None), (1, 4, "yield", [], None, None), (1, 5, "yield [[1]]", [1], None, None), (1, 6, "something else entirely", [2, 1], [(1, "The wafer yield reached")], None),
    ], kind)
    got = {r["claim"]: (r["accepted"], r["reason"], r["provenance_only"]) for r in grounding.validate_claims(claims, refs).collect()}
    assert got == {
        0: (True, None, False), 1: (False, "insufficient_lexical_support", False), 2: (False, "invalid_claim_text", False), 3: (False, "citation_out_of_range", False),
        4: (False, "missing_citations", False), 5: (False, "citation_marker_inside_claim_text", False), 6: (True, None, True),
    }


def test_critic(spark):
    e = spark.createDataFrame([("a", "营收规模12亿元", "2024-01-01", None), ("b", "营收规模500万元", "2023-01-01", None), ("c", "营收规模20亿元", None, None)], "evidence_id string, content string, as_of string, published_at string")
    assert {r["subject"] for r in critic.unit_mismatch(e).collect()} == {"营收规模"}
    assert [r["evidence_ids"] for r in critic.conflicts(e).collect()] == [["a", "c"]]
    assert [r["evidence_ids"] for r in critic.time_anchor(e).collect()] == [["a", "b"]]
    assert [x for x in spark.range(1).select(critic.plan_tools(F.lit("估值与政策"))).first()[0]] == ["knowledge_search", "news_search", "text2sql", "stock_query"]


def test_evaluation(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 21)], "g long, v double")
    assert {r["q"]: r["value"] for r in evaluation.nearest_rank(df, ["g"], "v", [0.5, 0.95]).collect()} == {0.5: 10.0, 0.95: 19.0}
    assert tuple(evaluation.answer_latency(df, ["g"], "v").first())[2:] == (10.0, 19.0)
    ranked = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3)], "query_id long, doc_id long, rank long")
    gold = spark.createDataFrame([(1, 8), (2, 1)], "query_id long, doc_id long")
    got = {r["query_id"]: (r["first_hit"], r["rr"]) for r in evaluation.ranking_metrics(ranked, gold, 3).collect()}
    assert got == {1: (2, 0.5), 2: (None, 0.0)}


def test_profile_of_nulls(spark):
    df = spark.createDataFrame([(None, None)], "a double, b string")
    assert [r["non_null"] for r in analyzer.profile(df).collect()] == [0, 0]


def _fold(rows, limit, seconds):
    kept, out = {}, {}
    for k, t, i in sorted(rows):
        own = [x for x in kept.get(k, []) if x > t - timedelta(seconds=seconds)]
        out[i] = len(own) < limit
        kept[k] = [*own, t] if out[i] else own
    return out


def test_rate_limit_stream_equals_table(spark, tmp_path):
    rnd = random.Random(5)
    base = datetime(2024, 1, 1)
    rows = [(rnd.randint(0, 3), base + timedelta(seconds=rnd.randint(0, 600)), i) for i in range(200)]
    df = spark.createDataFrame([(i, k, t) for k, t, i in rows], "event_id long, key long, ts timestamp")
    want = _fold(rows, 3, 60)
    assert {r["event_id"]: r["accepted"] for r in events.rate_limit(df, 3, 60.0).collect()} == want
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.rate_limit(stream, 3, 60.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()} == want


def test_task_machine(spark):
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    rows = [("a", at(0), "start"), ("a", at(1), "success"), ("b", at(0), "start"), ("b", at(2), "failure"), ("b", at(10), "start"), ("b", at(2000), "success"), ("c", at(0), "cancel"), ("c", at(1), "start")]
    got = {r["task_id"]: (r["state"], r["attempt"]) for r in events.task_states(spark.createDataFrame(rows, "task_id string, ts timestamp, event string")).collect()}
    assert got == {"a": ("succeeded", 1), "b": ("retrying", 2), "c": ("cancelled", 0)}
    steps = spark.createDataFrame([(1, i, "next") for i in range(6)] + [(2, i, e) for i, e in enumerate(["next"] * 5 + ["revise", "next", "revise", "next", "revise"])], "session_id long, n long, event string")
    assert {r["session_id"]: (r["phase"], r["iteration"]) for r in events.phase_machine(steps).collect()} == {1: ("completed", 0), 2: ("completed", 3)}


def test_outbox(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "dispatching", 7, False, t), (2, "dispatching", 0, False, t), (3, "dispatching", 0, True, t)], "id long, status string, delivery_attempts long, ok boolean, available_at timestamp_ntz")
    got = {r["id"]: (r["status"], r["available_at"]) for r in feeds.after_attempt(df, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()}
    assert got == {1: ("failed", t), 2: ("pending", t + timedelta(seconds=5)), 3: ("published", t)}


ALLOWED = {"guard_a": ["x", "y"], "guard_b": ["x"]}
ACCEPT = ["SELECT x, y FROM guard_a", "WITH c AS (SELECT x FROM guard_a) SELECT x AS z FROM c ORDER BY z", "SELECT a.x FROM guard_a a LEFT JOIN guard_b b ON a.x = b.x", "SELECT x FROM guard_a UNION SELECT x FROM guard_b", "SELECT count(*) FROM guard_a LIMIT 5;", "SELECT x FROM guard_a WHERE y = '--x'"]
REJECT = [
    ("", "EMPTY"), ("SELECT x FROM guard_a -- hi", "COMMENT_DENIED"), ("SELECT * FROM information_schema.tables", "SYSTEM_SCHEMA_DENIED"), ("SELECT 1; SELECT 2", "MULTI_STATEMENT"),
    ("SELEC x", "PARSE_FAIL"), ("DROP TABLE guard_a", "DDL_DENIED"), ("CREATE TABLE z (x INT)", "DDL_DENIED"), ("INSERT INTO guard_a VALUES (1, 2, 3)", "DML_DENIED"), ("DELETE FROM guard_a", "DML_DENIED"),
    ("EXPLAIN SELECT x FROM guard_a", "EXPLAIN_DENIED"), ("SELECT x FROM guard_c", "TABLE_NOT_ALLOWED"), ("SELECT a.secret FROM guard_a a", "COLUMN_NOT_ALLOWED"), ("SELECT nope FROM guard_a", "COLUMN_NOT_ALLOWED"),
    ("SELECT x FROM guard_a LIMIT 100000", "ROW_CAP_EXCEEDED"), ("SELECT x FROM guard_a EXCEPT SELECT x FROM guard_b", "DDL_DENIED"), ("COPY guard_a TO 'x'", "COPY_DENIED"),
    ("SELECT x FROM guard_a UNION ALL SELECT secret FROM guard_a", "COLUMN_NOT_ALLOWED"),
]


@pytest.fixture(scope="module")
def guarded(spark):
    for n in ("guard_a", "guard_b", "guard_c"):
        spark.createDataFrame([(1, "a", 3)], "x int, y string, secret int").createOrReplaceTempView(n)
    return spark


@pytest.mark.parametrize("sql", ACCEPT)
def test_guard_accepts(guarded, sql):
    assert sqlguard.check(guarded, sql, ALLOWED)[0] == "OK"
    assert sqlguard.query(guarded, sql, ALLOWED).count() >= 0


@pytest.mark.parametrize("sql, code", REJECT)
def test_guard_rejects(guarded, sql, code):
    assert sqlguard.check(guarded, sql, ALLOWED)[0] == code


@pytest.mark.parametrize("sql, code", [
    ("SELECT * FROM parquet.`/root/testdata/sf0.001/lineitem.parquet`", "TABLE_NOT_ALLOWED"), ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SYSTEM_SCHEMA_DENIED"),
    ("SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SYSTEM_SCHEMA_DENIED"), ("SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM guard_a", "SYSTEM_SCHEMA_DENIED"),
    ("SELECT x, input_file_name() FROM guard_a", "SYSTEM_SCHEMA_DENIED"), ("SELECT x FROM guard_a LIMIT 1000 + 5000", "ROW_CAP_EXCEEDED"),
    ("SELECT x FROM guard_a LIMIT 5000 OFFSET 0", "ROW_CAP_EXCEEDED"), ("SELECT (SELECT max(secret) FROM guard_a)", "COLUMN_NOT_ALLOWED"), ("SELECT * FROM global_temp.anything", "TABLE_NOT_ALLOWED"),
    ("WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "TABLE_NOT_ALLOWED"), ("SELECT x FROM guard_a WHERE EXISTS (SELECT 1 FROM parquet.`/root/testdata/sf0.001/region.parquet`)", "TABLE_NOT_ALLOWED"),
])
def test_guard_sees_the_analysed_plan(guarded, sql, code):
    assert sqlguard.check(guarded, sql, ALLOWED)[0] == code


@pytest.mark.parametrize("sql, code", [
    ("SELECT TRANSFORM(x) USING 'sed s/^/ran-/' AS (z) FROM guard_a", "PROCEDURAL_DENIED"), ("SELECT z FROM (SELECT TRANSFORM(x, y) USING 'cat' AS (z, w) FROM guard_a)", "PROCEDURAL_DENIED"),
    ("WITH t AS (SELECT TRANSFORM(x) USING 'id' AS (z) FROM guard_a) SELECT * FROM t", "PROCEDURAL_DENIED"), ("SELECT x FROM guard_a WHERE x IN (SELECT TRANSFORM(x) USING 'id' AS (z) FROM guard_b)", "PROCEDURAL_DENIED"),
    ("SELECT x FROM guard_b UNION ALL SELECT TRANSFORM(x) USING 'id' AS (z) FROM guard_a", "PROCEDURAL_DENIED"), ("FROM guard_a MAP x USING 'cat' AS z", "PROCEDURAL_DENIED"),
    ("SELECT * FROM range(10)", "TABLE_NOT_ALLOWED"), ("SELECT x FROM guard_a, range(3)", "TABLE_NOT_ALLOWED"), ("SELECT * FROM sql_keywords()", "SYSTEM_SCHEMA_DENIED"), ("SELECT * FROM global_temp.guard_a", "TABLE_NOT_ALLOWED"),
    ("SELECT x FROM guard_b WHERE x = (SELECT max(secret) FROM global_temp.guard_a)", "TABLE_NOT_ALLOWED"), ("SELECT * FROM spark_catalog.default.guard_a", "TABLE_NOT_ALLOWED"),
    ("SELECT explode(array(x)) AS z FROM guard_a", "OK"), ("SELECT y, z FROM guard_a LATERAL VIEW OUTER explode(array(x, 2)) t AS z", "OK"), ("SELECT x, row_number() OVER (ORDER BY x) AS n FROM guard_a", "OK"),
    ("SELECT DISTINCT x FROM guard_a WHERE y BETWEEN 'a' AND 'b' ORDER BY x LIMIT 5 OFFSET 1", "OK"), ("SELECT y, sum(x) FROM guard_a GROUP BY ROLLUP (y) HAVING sum(x) > 0", "OK"), ("SELECT * FROM VALUES (1, 'a') AS t(p, q)", "OK"),
    ("SELECT a.x FROM guard_a a CROSS JOIN guard_b b WHERE EXISTS (SELECT 1 FROM guard_b c WHERE c.x = a.x)", "OK"), ("SELECT CASE WHEN x > 0 THEN 'DROP TABLE' ELSE 'INFORMATION_SCHEMA' END AS z FROM guard_a", "OK"),
    ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT n FROM r", "OK"), ("SELECT x FROM guard_a ORDER BY secret", "COLUMN_NOT_ALLOWED"), ("DO $$ BEGIN END $$", "PARSE_FAIL"),
    ("CALL p()", "PROCEDURAL_DENIED"), ("SELECT 1;\nDROP TABLE guard_a", "MULTI_STATEMENT"), ("SELECT x FROM guard_a LIMIT 10; -- more", "COMMENT_DENIED"), ("MERGE INTO guard_a USING guard_b ON guard_a.x = guard_b.x WHEN MATCHED THEN DELETE", "DML_DENIED"),
])
def test_guard_lets_relational_nodes_through_alone(guarded, sql, code):
    guarded.table("guard_a").createOrReplaceGlobalTempView("guard_a")
    assert sqlguard.check(guarded, sql, ALLOWED)[0] == code
    if code == "OK":
        assert sqlguard.query(guarded, sql, ALLOWED).count() >= 0


def test_guard_refuses_functions_of_users(guarded):
    guarded.udf.register("own_udf", lambda x: str(x))
    assert sqlguard.check(guarded, "SELECT own_udf(x) FROM guard_a", ALLOWED)[0] == "SYSTEM_SCHEMA_DENIED"


def test_guard_narrows(guarded):
    before = guarded.table("guard_a").columns
    for sql in ("SELECT * FROM guard_a", "SELECT c.* FROM guard_a c", "SELECT t.* FROM (SELECT * FROM guard_a) t", "WITH w AS (SELECT * FROM guard_a) SELECT * FROM w"):
        assert set(sqlguard.query(guarded, sql, ALLOWED).columns) == set(ALLOWED["guard_a"])
    assert guarded.table("guard_a").columns == before and sqlguard.query(guarded, "SELECT x FROM guard_a", ALLOWED, 1).count() <= 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: \"T\"\nyear: 2024\n---\nbody\n", encoding="utf-8")
    (tmp_path / "b.bin").write_bytes(b"%PDF-1.7")
    got = tables.front_matter(tables.text_files(spark, str(tmp_path))).collect()
    assert len(got) == 1 and got[0]["meta"] == {"title": "T", "year": "2024"} and got[0]["body"] == "body\n"
    assert {r["path"][-5:]: r["kind"] for r in tables.file_kinds(spark, str(tmp_path)).collect()}["b.bin"] == "pdf"
    old, new = (spark.createDataFrame(x, "id long, v string, t long") for x in ([(1, "a", 0), (2, "b", 0)], [(2, "c", 1), (2, "d", 2), (3, "e", 1)]))
    assert sorted((r["id"], r["v"]) for r in tables.upsert(old, new, ["id"], "t").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r["id"] for r in tables.delete(old, new, ["id"]).collect()] == [1]
    sse = spark.createDataFrame([(1, "event: a\ndata: x\n\ndata: y\n\n")], "id long, body string")
    assert [(r["event"], r["data"]) for r in tables.sse_events(sse).orderBy("n").collect()] == [("a", "x"), ("", "y")]


def test_route_review(spark):
    issues = [(1, 1, "outdated", "major", True, "q1"), (1, 2, "style", "critical", True, "no"), (1, 3, "outdated", "minor", True, "no"), (2, 1, "style", "major", False, None), (3, 1, "style", "minor", False, None)]
    df = spark.createDataFrame(issues, "review_id long, n long, issue_type string, severity string, requires_new_search boolean, search_query string")
    missing = spark.createDataFrame([(1, i, a) for i, a in enumerate(["q1", "b", "c", "d"])] + [(2, 1, "x"), (4, 1, "y")], "review_id long, n long, aspect string")
    got = {r["review_id"]: (r["should_research"], r["search_queries"]) for r in critic.route_review(df, missing).collect()}
    assert got == {1: (True, ["q1", "b", "c"]), 2: (False, ["x"]), 3: (False, []), 4: (True, ["y"])}


def test_single_route(spark):
    rows = spark.createDataFrame([(1, "cloud", 5, 1, 0, 0.5, 1), (1, "local", 6, 1, 0, 0.9, 1), (1, "cloud", None, 2, 3, 0.4, 2)], "query_id long, route string, chunk_id long, doc_id long, idx int, score double, rank long")
    status = spark.createDataFrame([(1, "cloud", True), (1, "local", False)], "query_id long, route string, ok boolean")
    one = fusion.by_routes(rows, status, "cloud").orderBy("rank").collect()
    assert [(r["key"], r["score"], r["degraded"]) for r in one] == [("5", 0.5, None), ("2:3", 0.4, None)]
    assert {r["degraded"][0] for r in fusion.by_routes(rows, status).collect()} == {"local"} and fusion.candidate_depth(3, True) == 20 and fusion.candidate_depth(9, True) == 36 and fusion.candidate_depth(9, False) == 9


def test_fixture(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"news": [{"id": 1}, {"id": 2}], "quotes": [], "other": 3}')
    got = tables.read_fixture(spark, str(tmp_path / "f.json"), {"news": "news", "quotes": "market_quote", "none": "x"}).collect()
    assert [(r["kind"], r["row"]) for r in got] == [("news", '{"id":1}'), ("news", '{"id":2}')]


def test_order_statistics_of_repeated_values(spark):
    """A value that most rows repeat is one row of what is put in order."""
    rows = [("a", 0.0)] * 900 + [("a", float(i)) for i in range(1, 101)] + [("b", 5.0)] * 7 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in evaluation.nearest_rank(df, ["g"], "v", [0.0, 0.5, 0.9, 0.901, 0.95, 1.0]).collect()}
    assert got == {("a", 0.0): 0.0, ("a", 0.5): 0.0, ("a", 0.9): 0.0, ("a", 0.901): 1.0, ("a", 0.95): 50.0, ("a", 1.0): 100.0} | {("b", q): 5.0 for q in (0.0, 0.5, 0.9, 0.901, 0.95, 1.0)}
