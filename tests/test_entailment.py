"""Entailment by an outside judge: cases, strict reading of responses, claims that stay."""

import json

import pytest

from attesta.operators import critic, entailment


def _judgments(*items, **more):
    return json.dumps({"judgments": list(items)} | more)


def _j(index, verdict="entailed", reason="r"):
    return {"claim_index": index, "verdict": verdict, "reason": reason}


@pytest.mark.parametrize(("raw", "error"), [
    (_judgments(_j(0), _j(1, " Uncertain ")), None), ("noise " + _judgments(_j(1), _j("0")) + " end", None), ("```json\n" + _judgments(_j(0), _j(1)) + "\n```", None), ("```JSON" + _judgments(_j(0), _j(1)) + "```", None),
    (None, "no_response"), ("", "not_json"), ("no object", "not_json"), ("{", "not_json"), (_judgments(_j(0), _j(1))[:-1], "not_json"), ("[1]", "not_json"), ("{}", "judgments"), ('{"judgments": 3}', "judgments"),
    (_judgments(_j(0), 5), "object"), (_judgments(_j(0), "x"), "object"), (_judgments(_j(None), _j(1)), "claim_index"), (_judgments(_j("a"), _j(1)), "claim_index"), (_judgments({"verdict": "entailed"}), "claim_index"),
    (_judgments(_j(0, "true"), _j(1)), "verdict"), (_judgments(_j(0, None), _j(1)), "verdict"), (_judgments(_j(0), _j(2)), "out_of_range"), (_judgments(_j(-1), _j(0)), "out_of_range"),
    (_judgments(_j(0), _j(0), _j(1)), "repeated"), (_judgments(_j(0)), "incomplete"), (_judgments(), "incomplete"), (_judgments(_j(9), _j(0, "bad")), "out_of_range"),
])
def test_parse(spark, raw, error):
    responses = spark.createDataFrame([(1, raw)], "answer_id long, raw string")
    got = entailment.parse(responses, spark.createDataFrame([(1, 2)], "answer_id long, n long")).orderBy("index").collect()
    assert {r["error"] for r in got} == {error}
    if error is None:
        assert [r["index"] for r in got] == [0, 1] and {r["verdict"] for r in got} <= set(entailment.VERDICTS)
    else:
        assert len(got) == 1 and got[0]["verdict"] is None


def test_judge(spark):
    """Claims are numbered over their own order; no response, or two different ones, keeps nothing; equal copies count once."""
    claims = spark.createDataFrame([(a, c) for a in (1, 2, 3, 4) for c in (10, 7)], "answer_id long, claim long")
    good = _judgments(_j(0, "not_entailed"), _j(1))
    responses = spark.createDataFrame([(1, good), (1, good), (3, good), (3, _judgments(_j(0), _j(1))), (4, _judgments(_j(0), _j(1), note="n")), (9, good)], "answer_id long, raw string")
    judged = entailment.judge(claims, responses)
    got = {(r["answer_id"], r["claim"]): (r["accepted"], r["reason"], r["error"]) for r in judged.collect()}
    failed = lambda e: (False, "semantic_verifier_error", e)
    assert got == {
        (1, 7): (False, "semantic_not_entailed", None), (1, 10): (True, None, None), (2, 7): failed("no_response"), (2, 10): failed("no_response"),
        (3, 7): failed("responses_differ"), (3, 10): failed("responses_differ"), (4, 7): (True, None, None), (4, 10): (True, None, None),
    }
    assert {r["answer_id"]: (r["status"], r["accepted"], r["rejected"]) for r in entailment.status(judged).collect()} == {1: ("grounded", 1, 1), 2: ("insufficient", 0, 2), 3: ("insufficient", 0, 2), 4: ("grounded", 2, 0)}
    assert entailment.judge(claims.filter("false"), responses).count() == 0


def test_cases(spark):
    claims = spark.createDataFrame([(1, 0, "a", [2, 1, 5]), (1, 1, "b", []), (2, 0, None, None)], "answer_id long, claim long, text string, citations array<long>")
    quotes = spark.createDataFrame([(1, 0, 2, 1, "second"), (1, 0, 2, 0, "first"), (1, 1, 1, 0, "other claim")], "answer_id long, claim long, citation_id long, place int, quote string")
    references = spark.createDataFrame([(1, 1, "x" * 300), (1, 2, "whole"), (1, 1, "y"), (2, 1, None)], "answer_id long, citation_id long, content string")
    got = {(r["answer_id"], r["claim"]): [(e["citation_id"], e["evidence"]) for e in r["evidence"]] for r in entailment.cases(claims, quotes, references, 10).collect()}
    assert got == {(1, 0): [(2, "first\nsecond"), (1, "x" * 200)], (1, 1): [], (2, 0): []}


def test_missing_kinds_refuse(spark):
    findings = spark.createDataFrame([("warn",), ("info",), (None,)], "severity string")
    sources = spark.createDataFrame([("news",), (None,), ("news",)], "source_kind string")
    assert tuple(critic.should_refuse(findings).first()) == (0, 1, 1, [], False)
    assert tuple(critic.should_refuse(findings, ("news",), sources).first()) == (0, 1, 1, [], False)
    assert tuple(critic.should_refuse(findings, ("law", "news"), sources).first()) == (0, 1, 1, ["law"], True)
    assert tuple(critic.should_refuse(findings.filter("false"), ("law",), sources.filter("false")).first()) == (0, 0, 0, ["law"], True)
