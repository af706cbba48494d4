"""Entailment of accepted claims by a judge outside: cases for it, its answers read strictly, and claims kept on its word alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

VERDICTS = ["entailed", "not_entailed", "uncertain"]  # fixed values
MOST_EVIDENCE, LEAST_BOUND, MOST_REASON = 2400, 200, 500


def cases(claims: DataFrame, quotes: DataFrame, references: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """(answer_id, claim, text, evidence) of each claim (answer_id, claim, text, citations); evidence: array of citation_id, evidence.

    The evidence of a citation is its verified quotes (answer_id, claim, citation_id, place, quote) in order, one a line, or else the
    reference's content (answer_id, citation_id, content), cut at ``most`` characters. Citations without a reference have none; of a
    reference's several rows the least content counts.
    """
    known = references.groupBy("answer_id", "citation_id").agg(F.min(text.blank(F.col("content"))).alias("content"))
    cited = claims.select("answer_id", "claim", F.posexplode("citations").alias("at", "citation_id")).join(known, ["answer_id", "citation_id"])
    said = quotes.groupBy("answer_id", "claim", "citation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "quote"))), lambda x: x["quote"]), "\n").alias("said"))
    shown = F.substring(F.coalesce("said", "content"), 1, max(LEAST_BOUND, most))
    held = cited.join(said, ["answer_id", "claim", "citation_id"], "left").select("answer_id", "claim", F.struct("at", "citation_id", shown.alias("evidence")).alias("e"))
    listed = F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["citation_id"].alias("citation_id"), e["evidence"].alias("evidence")))
    own = held.groupBy("answer_id", "claim").agg(listed.alias("evidence"))
    return claims.select("answer_id", "claim", "text").join(own, ["answer_id", "claim"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(own.schema["evidence"].dataType)))


def parse(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """(answer_id, index, verdict, reason, error) of a judge's responses (answer_id, raw) to ``expected`` (answer_id, n) claims, numbered from 0.

    A response is an object with a list ``judgments`` of objects with claim_index, verdict and reason, within text or a fence. One
    that is not, or has not exactly one of ``VERDICTS`` for each claim, gives a single row with the error that comes first and no verdict:
    no_response, responses_differ, not_json, judgments, object, claim_index, verdict, out_of_range, repeated, incomplete.
    """
    one = responses.groupBy("answer_id").agg(F.min("raw").alias("raw"), F.count_distinct("raw").alias("responses"))
    raw = F.trim(text.blank(F.col("raw")))
    bare = F.when(raw.startswith("```"), F.regexp_replace(F.regexp_replace(raw, r"^(?i)```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(raw)
    own = expected.select("answer_id", F.col("n").cast("long").alias("n")).join(one, "answer_id", "left")
    own = own.withColumn("payload", F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0))).withColumn("items", F.try_variant_get("payload", "$.judgments", "array<variant>"))
    whole = F.when(F.coalesce("responses", F.lit(0)) == 0, "no_response").when(F.col("responses") > 1, "responses_differ").when(F.col("payload").isNull(), "not_json").when(F.col("items").isNull(), "judgments")
    own = own.withColumn("failed", whole)
    read = own.filter("failed is null").select("answer_id", "n", F.posexplode("items").alias("at", "item")).select(
        "answer_id", "n", "at", F.schema_of_variant("item").startswith("OBJECT").alias("object"), F.try_variant_get("item", "$.claim_index", "bigint").alias("index"),
        F.lower(F.trim(text.blank(F.try_variant_get("item", "$.verdict", "string")))).alias("verdict"), F.substring(F.trim(text.blank(F.try_variant_get("item", "$.reason", "string"))), 1, MOST_REASON).alias("reason"),
    )
    seen = F.row_number().over(Window.partitionBy("answer_id", "index").orderBy("at"))
    fault = (
        F.when(~F.coalesce("object", F.lit(False)), "object").when(F.col("index").isNull(), "claim_index").when(~F.col("verdict").isin(VERDICTS), "verdict")
        .when((F.col("index") < 0) | (F.col("index") >= F.col("n")), "out_of_range").when(seen > 1, "repeated")
    )
    judged = read.withColumn("fault", fault)
    found = judged.groupBy("answer_id").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("at", "fault"))).alias("first"), F.count("*").alias("given"))
    late = F.when(F.col("first").isNotNull(), F.col("first.fault")).when(F.coalesce("given", F.lit(0)) != F.col("n"), "incomplete")
    errors = own.join(found, "answer_id", "left").select("answer_id", F.coalesce("failed", late).alias("error"))
    good = judged.join(errors.filter("error is null"), "answer_id", "left_semi").select("answer_id", "index", "verdict", "reason", F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    return good.unionByName(errors.filter("error is not null").select("answer_id", F.lit(None).cast("long").alias("index"), none.alias("verdict"), none.alias("reason"), "error"))


def judge(accepted: DataFrame, responses: DataFrame) -> DataFrame:
    """(answer_id, claim, verdict, accepted, reason, error) of accepted claims (answer_id, claim): only entailed ones stay.

    An answer's claims are numbered from 0 in their order. Where its response cannot be trusted (see ``parse``), all of them
    are rejected as semantic_verifier_error; others that are not entailed as semantic_ and their verdict.
    """
    numbered = accepted.select("answer_id", "claim").withColumn("index", (F.row_number().over(Window.partitionBy("answer_id").orderBy("claim")) - 1).cast("long"))
    parsed = parse(responses, numbered.groupBy("answer_id").agg(F.count("*").alias("n")))
    errors = parsed.filter("error is not null").select("answer_id", "error")
    out = numbered.join(parsed.filter("error is null").select("answer_id", "index", "verdict"), ["answer_id", "index"], "left").join(errors, "answer_id", "left")
    entailed = F.coalesce(F.col("verdict") == "entailed", F.lit(False))
    reason = F.when(F.col("error").isNotNull(), "semantic_verifier_error").when(~entailed, F.concat(F.lit("semantic_"), F.col("verdict")))
    return out.select("answer_id", "claim", "verdict", entailed.alias("accepted"), reason.alias("reason"), "error")


def status(judged: DataFrame) -> DataFrame:
    """(answer_id, status, accepted, rejected): grounded where a claim stays, else insufficient."""
    kept = judged.groupBy("answer_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    return kept.select("answer_id", F.when(F.col("accepted") > 0, "grounded").otherwise("insufficient").alias("status"), "accepted", "rejected")
