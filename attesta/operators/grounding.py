"""Grounding of claims on cited evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

LEAST_SUPPORT, MOST_CLAIMS, LEAST_QUOTE, MOST_TEXT = 0.12, 12, 8, 1200


def validate_claims(claims: DataFrame, references: DataFrame, least: float = LEAST_SUPPORT, most: int = MOST_CLAIMS) -> DataFrame:
    """(answer_id, claim, accepted, reason, citations, provenance_only) of an answer's first ``most`` claims.

    ``claims``: answer_id, claim (from 0), text, citation_ids (array of int), quotes (array of
    struct<citation_id:int, quote:string>), uncertainty; ``references``: answer_id, citation_id (from 1), content.
    A citation supports a claim if the evidence has all of the claim's identifiers and either enough of its
    tokens or one of its quotes word for word. The first broken rule is the reason.
    """
    own = claims.filter(F.col("claim") < most).withColumn("text", F.trim(text.blank(F.col("text"))))
    size = references.groupBy("answer_id").agg(F.max("citation_id").alias("references"))
    own = own.join(size, "answer_id", "left").withColumn("references", F.coalesce("references", F.lit(0)))
    outside = F.exists("citation_ids", lambda i: (i < 1) | (i > F.col("references")))
    reason = (
        F.when((F.col("text") == "") | (F.length("text") > MOST_TEXT), "invalid_claim_text").when(F.col("text").rlike(r"\[\[\d+\]\]"), "citation_marker_inside_claim_text")
        .when(~F.coalesce("uncertainty", F.lit("certain")).isin("certain", "limited"), "invalid_uncertainty")
        .when(F.col("citation_ids").isNull() | (F.size("citation_ids") == 0), "missing_citations").when(outside, "citation_out_of_range")
    )
    own = own.withColumn("reason", reason)
    cited = own.filter("reason is null").select("answer_id", "claim", "text", "quotes", F.explode(F.array_distinct("citation_ids")).alias("citation_id"))
    met = cited.join(references, ["answer_id", "citation_id"])
    ids = F.size(F.array_except(text.required_identifiers(F.col("text")), text.ascii_tokens(F.col("content")))) == 0
    own_quotes = F.filter(F.coalesce("quotes", F.array().cast("array<struct<citation_id:int,quote:string>>")), lambda q: (q["citation_id"] == F.col("citation_id")) & (F.length(F.trim(q["quote"])) >= LEAST_QUOTE))
    met = met.withColumn("said", text.normalise_quotes(F.transform(own_quotes, lambda q: q["quote"]))).withColumn("folded", text.normalise_evidence(F.col("content")))
    quoted = F.exists("said", lambda q: F.contains(F.col("folded"), q))
    enough = text.lexical_support(F.col("text"), F.col("content")) >= least
    good = met.withColumn("basis", F.when(ids & enough, "lexical_support").when(ids & quoted, "verbatim_quote_provenance")).filter("basis is not null")
    kept = good.groupBy("answer_id", "claim").agg(F.sort_array(F.collect_set("citation_id")).alias("citations"), F.bool_or(F.col("basis") == "verbatim_quote_provenance").alias("provenance_only"))
    return own.join(kept, ["answer_id", "claim"], "left").select(
        "answer_id", "claim", (F.col("reason").isNull() & F.col("citations").isNotNull()).alias("accepted"),
        F.coalesce("reason", F.when(F.col("citations").isNull(), "insufficient_lexical_support")).alias("reason"), "citations", F.coalesce("provenance_only", F.lit(False)).alias("provenance_only"),
    )


def apply_verdicts(accepted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Accepted claims with a supplied verdict of entailed; no verdict, or any other, rejects (answer_id, claim, verdict)."""
    last = verdicts.groupBy("answer_id", "claim").agg(F.max("verdict").alias("verdict"), F.count_distinct("verdict").alias("n"))
    verdict = F.when(F.col("n") == 1, F.col("verdict")).otherwise("uncertain")
    return accepted.join(last, ["answer_id", "claim"], "left").withColumn("verdict", F.coalesce(verdict, F.lit("uncertain"))).withColumn("entailed", F.col("verdict") == "entailed").drop("n")


def render(claims: DataFrame) -> DataFrame:
    """(answer_id, answer): the claims in order with their citation marks; limited ones are marked."""
    mark = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("[["), c.cast("string"), F.lit("]]"))), "")
    body = F.regexp_replace("text", "[。.!? ]+$", "")
    line = F.concat(body, F.when(F.col("uncertainty") == "limited", " (limited)").otherwise(""), mark)
    return claims.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))


def hypothesis_status(evidence: DataFrame) -> DataFrame:
    """(hypothesis, status) by votes (hypothesis, n, vote): the side that first has two of its own wins."""
    w = Window.partitionBy("hypothesis").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = evidence.withColumn("s", F.count_if(F.col("vote") == "supports").over(w)).withColumn("r", F.count_if(F.col("vote") == "refutes").over(w))
    hit = F.when(F.col("s") >= 2, "supported").when(F.col("r") >= 2, "refuted")
    return run.groupBy("hypothesis").agg(F.coalesce(F.min_by(hit, F.when(hit.isNotNull(), F.col("n"))), F.lit("open")).alias("status"))


def parse_answer(answers: DataFrame) -> DataFrame:
    """(answer_id, valid, status, n_claims, limitations) of answers (answer_id, json): a known status, claims and limitations as lists; the first five limitations that say something."""
    v = F.from_json("json", "answer_status string, claims array<string>, limitations array<string>")
    shape = F.schema_of_variant(F.try_variant_get(F.try_parse_json("json"), "$.claims", "variant"))
    lists = F.coalesce(shape.startswith("ARRAY"), F.try_parse_json("json").isNotNull())
    own = answers.select("answer_id", v.alias("v"), lists.alias("lists"))
    said = F.slice(F.filter(F.transform(F.coalesce("v.limitations", F.array().cast("array<string>")), F.trim), lambda x: x != ""), 1, 5)
    valid = F.coalesce(F.col("v.answer_status").isin("grounded", "insufficient") & F.col("lists"), F.lit(False))
    return own.select("answer_id", valid.alias("valid"), F.when(valid, F.col("v.answer_status")).alias("status"), F.when(valid, F.coalesce(F.size("v.claims"), F.lit(0))).alias("n_claims"), F.when(valid, said).alias("limitations"))
