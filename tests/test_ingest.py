"""Query plans, page text, manifests, JSON repair and answer support."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import queryplan
from attesta.operators import dense, evaluation, ingest

def planned(spark, question):
    rows = queryplan.query_plans(spark.createDataFrame([(1, question)], "query_id long, question string")).orderBy("variant").collect()
    return [(r["query"], r["focus"]) for r in rows]


def test_glossary(spark):
    assert len(queryplan.GLOSSARY) == 66
    own = lambda q: queryplan.with_phrases(spark.range(1).select(F.lit(q).alias("q")), "q").first()["phrases"]
    assert own("低翘曲怎么办") == ["low warpage"] and own("人才与劳动力") == ["workforce"] and own("none") == []


def test_plan(spark):
    assert planned(spark, "翘曲") == [("翘曲", [])] and planned(spark, None) == []
    assert [q for q, _ in planned(spark, "DRC 翘曲")] == ["DRC 翘曲", "DRC warpage", "DRC 翘曲 Technical terms: warpage"]
    many = planned(spark, "供应链, 基础设施, 人才, 网络安全, 纯度, 颗粒, 供应商")
    assert len(many) == 6 and [len(f) for _, f in many] == [0, 2, 2, 1, 1, 1] and many[1][0].startswith("供应链 ")


def test_plans_of_a_table(spark):
    df = spark.createDataFrame([(1, "DRC 翘曲"), (2, None)], "query_id long, question string")
    got = queryplan.query_plans(df).filter("query_id = 1").orderBy("variant").collect()
    assert [r["focus"] for r in got] == [[], ["warpage"], ["warpage"]]
    assert df.select(queryplan.explain_identifier(F.lit("SP-800"))).first()[0].count("SP-800") == 1


def test_pages(spark):
    page = lambda n: "\n".join(["ACME Report", "Draft", "", "INTRODUCTION", f"line one of page {n} is manu-", "factured here.", "More text", "• item", "and more", "", f"body {n} ends", "Draft", f"Page {n}"])
    texts = ["\f".join(page(n) for n in range(1, 5)), None, "# include <x>", "A. ONE\n\nTWO THREE\nCHAPTER 1\nFOUR FIVE\nSIX SEVEN\n\nself-\nmade in-\nline re-\nmade\nContents . . . . 3\n1) x\n\fnext page"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["markdown"] for r in ingest.pages_to_markdown(rows).collect()}
    assert "ACME" not in got[0] and "Page 1" not in got[0]
    assert "manufactured here." in got[0] and "## INTRODUCTION" in got[0] and "- item and more" in got[0]
    assert got[1] == "" and got[2] == "\\# include <x>"
    assert got[3] == "## A. ONE TWO THREE\n\n## CHAPTER 1\n\n## FOUR FIVE SIX SEVEN\n\nself-made in-line remade\n\n1) x\n\nnext page"


def test_pages_deal_out_their_lines_once(spark):
    page = lambda n: "\n".join(["Head  1", "Sub", "", *[f"text {n} {i}." for i in range(n % 4 + 2)], "", "tail 7", f"{n}"])
    rows = spark.createDataFrame([(1, "\f".join(map(page, range(6)))), (2, "\f \f" + page(3)), (3, None)], "doc_id long, text string")
    lines = [r.asDict() for r in ingest.running_lines(ingest.page_lines(rows)).collect()]
    assert {(r["doc_id"], r["pages"]) for r in lines} == {(1, 6), (2, 1)} and {r["line"] for r in lines if r["often"]} == {"Head 1", "Sub", "tail 7", *map(str, range(6))}
    filled = {}
    for r in sorted(lines, key=lambda r: (r["doc_id"], r["page"], r["at"])):
        filled.setdefault((r["doc_id"], r["page"]), []).append(r) if r["line"] else None
    edges = {(k, r["at"]) for k, own in filled.items() if len(own) >= ingest.FULL_PAGE for r in own[:2] + own[-2:]}
    assert {((r["doc_id"], r["page"]), r["at"]) for r in lines if r["edge"]} == edges and edges
    plan = ingest.pages_to_markdown(rows)._jdf.queryExecution().executedPlan().toString()
    moved = [x.split("hashpartitioning(")[1].split(", ENSURE")[0] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert sum("page#" in x or "shape#" in x for x in moved) <= 2  # of margins alone; all lines once, by document


def test_uploads(spark):
    df = spark.createDataFrame([("a", 4, bytearray(b"text")), ("b", 0, bytearray()), ("c", 4, bytearray(b"\x01\x02\x03x")), ("d", 99 << 20, bytearray(b"x"))], "path string, length long, content binary")
    assert {r["path"]: r["verdict"] for r in ingest.upload_verdicts(df).collect()} == {"a": "PASS", "b": "EMPTY", "c": "HIGH_CTRL_CHARS", "d": "TOO_LARGE"}


def test_manifest(spark):
    h = "a" * 64
    rows = [("1", "approved", "l", "u", h, "x.md"), ("2", "approved", "l", "u", h, "../y.md"), ("3", "pending", None, None, None, "/z.md"), ("3", "approved", None, "u", "bad", None)]
    df = spark.createDataFrame(rows, "candidate_id string, review_status string, license_name string, license_url string, content_hash string, local_path string")
    got = {(r["candidate_id"], r["code"]) for r in ingest.manifest_issues(df, 4).collect()}
    assert got == {
        ("2", "path_escape"), ("2", "duplicate_content"), ("3", "duplicate_candidate"), ("3", "absolute_path"), ("3", "unapproved_local_file"), ("3", "missing_license"), ("3", "invalid_hash"),
        ("3", "missing_path"), (None, "approved_count"),
    }
    done = spark.createDataFrame([("1",)], "candidate_id string")
    assert [r["candidate_id"] for r in ingest.admissible(df, done).collect()] == ["2"]


def test_manifest_of_raw_files(spark):
    """Raw paths are held to the rules of the others and asked for on request; a file that calls itself synthetic, or says nothing of it, is a mismatch."""
    h = "a" * 64
    rows = [("1", "approved", "d/1.md", "r/1"), ("2", "approved", "d/2.md", None), ("3", "approved", "d/3.md", "../r"), ("4", "pending", None, "/r"), ("5", "approved", None, None)]
    df = spark.createDataFrame([(i, s, "l", "u", h[:-1] + i, p, r, "s") for i, s, p, r in rows], "candidate_id string, review_status string, license_name string, license_url string, content_hash string, local_path string, local_raw_path string, source_url string")
    want = {("3", "path_escape"), ("4", "absolute_path"), ("4", "unapproved_local_file"), ("5", "missing_path")}
    assert {tuple(r) for r in ingest.manifest_issues(df).collect()} == want
    assert {tuple(r) for r in ingest.manifest_issues(df, require_raw=True).collect()} == want | {("2", "missing_raw_path")}
    assert {tuple(r) for r in ingest.raw_file_issues(df, spark.createDataFrame([("r/1",), ("r/1",)], "path string")).collect()} == {("3", "missing_raw_file")}
    meta = lambda i, **more: {"candidate_id": i, "content_hash": h[:-1] + i, "source_url": "s", "license_url": "u"} | more
    files = spark.createDataFrame([("d/1.md", meta("1", is_synthetic="False")), ("d/2.md", meta("2")), ("d/3.md", meta("3", is_synthetic="true"))], "path string, meta map<string,string>")
    assert {tuple(r) for r in ingest.metadata_issues(df, files).collect()} == {("2", "metadata_mismatch"), ("3", "metadata_mismatch")}


def test_memory_search(spark):
    """A user's own memories alone, ties by id; no user or no vector finds and is nothing; equal contents are one line."""
    memories = spark.createDataFrame([
        (1, 7, [1.0, 0.0], "summary", "a"), (2, 7, [1.0, 0.0], "insight", "a"), (3, 7, [0.0, 1.0], "topics", "b"), (4, 8, [1.0, 0.0], "topics", "c"), (5, None, [1.0, 0.0], "topics", "d"), (6, 7, None, "topics", "e"), (8, 7, [0.0, 0.0], "odd", "f"),
    ], "id long, user_id long, embedding array<double>, memory_type string, content string")
    queries = spark.createDataFrame([(1, 7, [1.0, 0.1]), (2, None, [1.0, 0.0]), (3, 8, None), (4, 9, [1.0])], "query_id long, user_id long, embedding array<double>")
    found = ingest.search_memories(queries, memories, 4)
    assert [(r["query_id"], r["rank"], r["id"]) for r in found.orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 8)]
    assert [r["context"] for r in ingest.memory_context(found).collect()] == ["[相关历史记忆]\n- 历史对话摘要: a\n- b"]
    assert ingest.search_memories(queries.filter("false"), memories).count() == 0


@pytest.mark.parametrize("block", [3, 8192])
def test_memory_search_moves_vectors_alone(spark, block):
    """Blocks of large users find what all pairs do, for odd vectors too, and what a memory says is looked up after its vector is found."""
    rng = np.random.default_rng(3)
    rows = [(f"m{i}", f"u{i % 4 if i < 40 else 9}", rng.integers(-3, 4, 4).astype(float).tolist(), f"text {i}") for i in range(60)]
    odd = [("n1", "u0", [1.0, None, 0.0, 0.0], "null"), ("n2", "u0", [], "empty"), ("n3", "u0", [float("nan")] * 4, "nan"), ("n4", "u0", [1.0, 1.0], "short"), ("m4", "u0", rows[4][2], "copy")]
    memories = spark.createDataFrame(rows + odd, "id string, user_id string, embedding array<double>, content string")
    queries = spark.createDataFrame([(i, u, rng.integers(-3, 4, 4).astype(float).tolist()) for i, u in enumerate(["u0"] * 7 + ["u1", "u9", "u8"])] + [(20, "u0", [0.0] * 4), (21, "u0", [2.0, 1.0])], "query_id long, user_id string, embedding array<double>")
    met = queries.withColumnRenamed("embedding", "_asked").join(memories, "user_id").withColumn("score", F.round(dense.cosine(F.col("_asked"), F.col("embedding")), 9))
    want = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter("rank <= 6")
    found = ingest.search_memories(queries, memories, 6, block)
    rows_of = lambda df: sorted((r["query_id"], r["rank"], r["id"], str(r["score"])) for r in df.collect())
    assert rows_of(found) == rows_of(want) and found.count() == want.count()
    assert {(r["id"], r["content"]) for r in found.collect()} <= {(r[0], r[3]) for r in rows + odd}
    plan = dense.cosine_topk_of_users(queries, memories, 6, block)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "content" in line and "LogicalRDD" not in line]


@pytest.mark.parametrize("source, want", [
    ('{"a": 1}', {"a": 1}), ('x ```json\n{"a": [1, 2,],}\n``` y', {"a": [1, 2]}), ('say {a: 1, // no\n "u": "http://x//y"} ok', {"a": 1, "u": "http://x//y"}),
    ('{"a": "\\[x"}', {"a": "[x"}), ("none", None), (None, None), ('{"a": "b: c, d: e"}', {"a": "b: c, d: e"}),
])
def test_json(source, want):
    assert ingest.repair_json(source) == want


def test_json_column(spark):
    df = spark.createDataFrame([("{b: 1, 'x'",), ("{b: 1}",)], "s string")
    assert [r[0] for r in df.select(ingest.mended_json("s")).collect()] == [None, '{"b": 1}']


def test_vectors(spark):
    df = ingest.with_digest_vectors(spark.createDataFrame([("a",), ("a",), (None,)], "t string"), "t", 70)
    v = [np.array(r["embedding"]) for r in df.collect()]
    assert np.array_equal(v[0], v[1]) and not np.array_equal(v[0], v[2]) and abs(np.linalg.norm(v[0]) - 1) < 1e-5 and len(v[0]) == 70


def test_markdown_and_cells(spark):
    df = spark.createDataFrame([("[a](u) [b](v) ![c](k) ![d](z)", ["u"], ["k"])], "b string, u array<string>, c array<string>")
    assert df.select(ingest.safe_markdown(F.col("b"), F.col("u"), F.col("c"))).first()[0] == "[a](u) b ![c](k) [d]"
    row = ingest.rendered(spark.sql("SELECT X'0102' AS b, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t, 5 AS n, CAST(NULL AS BINARY) AS z")).first()
    assert tuple(row) == ("<binary 2 bytes>", "2024-01-02T03:04:05", "5", None)


def test_search_tree(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "parent string, query string")
    got = {r["query"]: r["depth"] for r in ingest.bounded_search(spark.createDataFrame([("a",)], "query string"), edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_group_support(spark):
    cases = spark.createDataFrame([(1, "Yield is high. [[1]] Cost is low.", [["yield"], ["cost"], ["speed"]])], "case_id long, answer string, required_term_groups array<array<string>>")
    docs = spark.createDataFrame([(1, 1, "the yield of it")], "case_id long, citation_id int, content string")
    assert tuple(evaluation.group_support(cases, docs).first()) == (1, 3, 2, 1, 1)
