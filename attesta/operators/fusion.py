"""Fusion of retrieval routes: reciprocal ranks, fused scores, admission, neighbours, facet seats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

RRF_K = 60
VECTOR_WEIGHT, LEXICAL_WEIGHT, RRF_WEIGHT = 0.75, 0.25, 0.35
FOCUS_WEIGHT, EXACT_WEIGHT, COVERAGE_WEIGHT = 0.55, 0.20, 0.12
COVERAGE_FROM, MIN_LEXICAL = 0.20, 0.18
DIGITS = 9


def reciprocal_ranks(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, rrf, routes) of rankings (query_id, chunk_id, rank) in one table."""
    return ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS).alias("rrf"), F.count("*").alias("routes"))


def merge_candidates(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Outer merge of (query_id, chunk_id, score): absent scores are 0."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("vector"))
    x = lexical.select("query_id", "chunk_id", F.col("score").alias("lexical"))
    return d.join(x, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", F.coalesce("vector", F.lit(0.0)).alias("vector"), F.coalesce("lexical", F.lit(0.0)).alias("lexical"))


def variant_relevance(vector, lexical, focus=None, focus_weight: float = FOCUS_WEIGHT):
    """A variant's relevance; with focus terms their coverage takes up to 0.8 of it."""
    base = VECTOR_WEIGHT * vector + LEXICAL_WEIGHT * lexical
    w = min(0.8, max(0.0, focus_weight))
    return base if focus is None else (1 - w) * base + w * focus


def fused_score(vector, lexical, rrf, exact, variants: int = 1, k: int = RRF_K, weight: float = RRF_WEIGHT):
    """Weighted scores and normalised reciprocal ranks; an exact-term score is blended in unless it is null."""
    w = min(1.0, max(0.0, weight))
    most = 2.0 * variants / (k + 1)
    base = (1 - w) * (VECTOR_WEIGHT * vector + LEXICAL_WEIGHT * lexical) + w * rrf / most
    return F.round(F.when(exact.isNull(), base).otherwise((1 - EXACT_WEIGHT) * base + EXACT_WEIGHT * exact), DIGITS)


def document_coverage(hits: DataFrame, variants: int, score: str = "score", weight: float = COVERAGE_WEIGHT, least: float = COVERAGE_FROM) -> DataFrame:
    """Re-weights scores by the share of query variants that the chunk's document meets.

    ``hits``: query_id, doc_id, chunk_id, variant, lexical, score.
    """
    w = Window.partitionBy("query_id", "doc_id")
    met = F.size(F.collect_set(F.when(F.col("lexical") >= least, F.col("variant"))).over(w)) / variants
    share = min(0.3, max(0.0, weight))
    return hits.withColumn("coverage", met).withColumn(score, F.round((1 - share) * F.col(score) + share * F.col("coverage"), DIGITS))


def admit_documents(hits: DataFrame, min_vector: float = 0.0, min_lexical: float = MIN_LEXICAL, hybrid: bool = True) -> DataFrame:
    """Every chunk of a document with a chunk that passes: its strict-identifier score is null or above 0, and its vector or lexical score is enough."""
    enough = F.col("vector") >= min_vector
    if hybrid:
        enough = enough | (F.col("lexical") >= min_lexical)
    passes = text.passes_strict(F.col("strict")) & enough
    return hits.withColumn("_ok", F.max(passes).over(Window.partitionBy("query_id", "doc_id"))).filter("_ok").drop("_ok")


def add_neighbours(seeds: DataFrame, chunks: DataFrame, window: int = 1, most: int = 4, damp: float = 0.95) -> DataFrame:
    """The seeds (query_id, doc_id, idx, score) and up to ``most`` neighbours of a query, best first, at a damped score.

    A neighbour is a chunk of the same document at most ``window`` places away that is not a seed itself.
    """
    offsets = F.explode(F.array(*[F.lit(o) for o in range(-window, window + 1) if o])).alias("o")
    near = seeds.select("query_id", "doc_id", "idx", "score", offsets).select("query_id", "doc_id", (F.col("idx") + F.col("o")).alias("idx"), (F.col("score") * damp).alias("score"))
    near = near.groupBy("query_id", "doc_id", "idx").agg(F.max("score").alias("score")).join(chunks.select("doc_id", "idx"), ["doc_id", "idx"])
    near = near.join(seeds.select("query_id", "doc_id", "idx"), ["query_id", "doc_id", "idx"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "idx")
    kept = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    out = seeds.select("query_id", "doc_id", "idx", F.round("score", DIGITS).alias("score"), F.lit("seed").alias("kind"))
    return out.unionByName(kept.select("query_id", "doc_id", "idx", F.round("score", DIGITS).alias("score"), F.lit("neighbour").alias("kind")))


def _contenders(hits: DataFrame, top_k: int, per_doc: int) -> DataFrame:
    """The hits that can win a seat.

    Of a document at most ``per_doc`` chunks are seated, so before one of its chunks is passed over by a sub-query at
    most ``per_doc`` better ones of it are; by score at most twice as many, as sub-queries may have seated others. Before a
    chunk is reached in an order at most ``top_k`` chunks are seated and the contenders of full documents are passed over.
    """
    facets = hits.select("query_id", "chunk_id", "doc_id", "score", F.posexplode("facets").alias("f", "value")).filter("value > 0")
    scored = hits.select("query_id", "chunk_id", "doc_id", "score", F.lit(-1).alias("f"), F.col("score").alias("value"))
    order = [F.desc("value"), F.desc("score"), "chunk_id"]
    own = F.row_number().over(Window.partitionBy("query_id", "f", "doc_id").orderBy(*order))
    place = F.row_number().over(Window.partitionBy("query_id", "f").orderBy(*order))
    kept = facets.unionByName(scored).withColumn("own", own).filter(F.col("own") <= 2 * per_doc).withColumn("place", place).filter(F.col("place") <= 4 * top_k + 2 * per_doc)
    return hits.join(kept.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")


def facet_seats(hits: DataFrame, top_k: int, per_doc: int = 3) -> DataFrame:
    """(query_id, chunk_id, seat) of a query's chosen chunks.

    ``hits``: query_id, chunk_id, doc_id, score, facets (relevance for each sub-query, equal lengths). Sub-queries
    take turns to seat their best unused chunk with relevance above 0; free seats go by score; a document
    has ``per_doc`` chunks at most. State runs along the seats, so a query's contenders, a number that ``top_k`` and the
    number of sub-queries bound, are one group.
    """

    def seat(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True])
        rows = pdf.to_dict("records")
        used, of, out = set(), {}, []

        def take(r: dict) -> None:
            used.add(r["chunk_id"])
            of[r["doc_id"]] = of.get(r["doc_id"], 0) + 1
            out.append(r["chunk_id"])

        free = lambda r: r["chunk_id"] not in used and of.get(r["doc_id"], 0) < per_doc
        for f in range(max((len(r["facets"]) for r in rows), default=0)):
            fit = [r for r in rows if free(r) and r["facets"][f] > 0]
            if len(out) < top_k and fit:
                take(max(fit, key=lambda r: (r["facets"][f], r["score"], -r["chunk_id"])))
        for r in rows:
            if len(out) < top_k and free(r):
                take(r)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "chunk_id": out, "seat": range(1, len(out) + 1)})

    return _contenders(hits, top_k, per_doc).groupBy("query_id").applyInPandas(seat, "query_id long, chunk_id long, seat long")


def rerank(hits: DataFrame, scores: DataFrame, top: int = 20) -> DataFrame:
    """Replaces scores by supplied ones in 0..1 (query_id, chunk_id, rerank_score) for the first ``top``; without one the score stays."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    first = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top).drop("n")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("rerank_score", "score")))
    return first.join(scores, ["query_id", "chunk_id"], "left").withColumn("score", clamped).withColumn("rank", F.row_number().over(order).cast("long"))


def across_routes(routes: DataFrame, k: int = RRF_K) -> DataFrame:
    """One ranking of route rankings (query_id, route, chunk_id, doc_id, idx, rank); a chunk without id goes by document and place."""
    key = F.coalesce(F.col("chunk_id").cast("string"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("idx").cast("string")))
    out = routes.withColumn("key", key).groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS).alias("score"), F.sort_array(F.collect_set("route")).alias("routes"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")).cast("long"))


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """Across knowledge bases: the best row of each chunk."""
    order = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "kb_id")
    return hits.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def per_base(hits: DataFrame, top_k: int, bases: int) -> DataFrame:
    """The first ``max(3, top_k // bases)`` rows of every knowledge base."""
    order = Window.partitionBy("query_id", "kb_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(3, top_k // max(1, bases))).drop("n")


def candidate_depth(top_k: int, hybrid: bool) -> int:
    """Candidates that a route is asked for: more where they are fused."""
    return max(4 * top_k, 20) if hybrid else top_k


def merge_variants(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, by_variant, rrf) of a query's variants (query_id, variant, chunk_id, score, rank): the best score, each variant's score, and the sum of reciprocal ranks."""
    one = hits.groupBy("query_id", "chunk_id", "variant").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "score"))))
    return one.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), by.alias("by_variant"), F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS).alias("rrf"))


def dense_only(merged: DataFrame, variants: int) -> DataFrame:
    """Merged variants as they are ranked where the lexical route is switched off; relevance has a score for each variant, 0 where it did not hit."""
    relevance = F.transform(F.sequence(F.lit(0), F.lit(variants - 1)), lambda v: F.coalesce(F.try_element_at("by_variant", v), F.lit(0.0)))
    return merged.select("query_id", "chunk_id", F.col("score").alias("vector"), F.lit(0.0).alias("lexical"), "rrf", F.lit("disabled").alias("lexical_backend"), relevance.alias("relevance"), "score")


def merge_score_maps(scores: DataFrame) -> DataFrame:
    """(query_id, chunk_id, best): for each chunk a map of the best score of every variant, of rows (query_id, chunk_id, variant, score) of any number of routes."""
    one = scores.groupBy("query_id", "chunk_id", "variant").agg(F.max("score").alias("score"))
    return one.groupBy("query_id", "chunk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "score")))).alias("best"))


MODES = {"cloud": ["cloud"], "local": ["local"], "hybrid": ["cloud", "local"]}


def by_routes(results: DataFrame, status: DataFrame, mode: str = "hybrid", top_k: int = 5) -> DataFrame:
    """One ranking of the routes that a mode asks; (query_id, key, score, routes, rank, degraded).

    ``results``: query_id, route, chunk_id, doc_id, idx, score, rank; ``status``: query_id, route, ok. A single route's
    ranking stays as it is; several are fused, and ``degraded`` names a query's routes that failed.
    """
    routes = MODES[mode]
    own = results.filter(F.col("route").isin(routes))
    if len(routes) == 1:
        key = F.coalesce(F.col("chunk_id").cast("string"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("idx").cast("string")))
        ranked = own.select("query_id", key.alias("key"), "score", F.array("route").alias("routes"), F.col("rank").cast("long").alias("rank"))
        return ranked.filter(F.col("rank") <= top_k).withColumn("degraded", F.lit(None).cast("array<string>"))
    failed = status.filter(F.col("route").isin(routes) & ~F.col("ok")).groupBy("query_id").agg(F.sort_array(F.collect_set("route")).alias("degraded"))
    return across_routes(own).filter(F.col("rank") <= top_k).join(failed, "query_id", "left").select("query_id", "key", "score", "routes", "rank", "degraded")


def hybrid(results: DataFrame, status: DataFrame, scores: DataFrame, variants: int = 1, top_k: int = 5, limit: int = 20, per_doc: int = 3, k: int = RRF_K) -> DataFrame:
    """(query_id, seat, key, doc_id, score, rrf, routes, route_scores, degraded): routes fused, reranked and seated in one plan.

    ``results``: query_id, route, chunk_id, doc_id, idx, score, rank, relevance (for each of the query's ``variants``; shorter or null: 0);
    ``status``: query_id, route, ok; ``scores``: query_id, key, rerank_score, for some or all. The first ``limit`` by reciprocal ranks
    (``top_k`` at least) take their rerank score, or else the sum of reciprocal ranks; each variant of several seats its best, the rest goes by score.
    A document has ``per_doc`` seats, or as many as there are variants. Equal scores keep the order of the fusion, which is by key in turn.
    """
    key = F.coalesce(F.col("chunk_id").cast("string"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("idx").cast("string")))
    zeros = F.array_repeat(F.lit(0.0), variants)
    wide = F.slice(F.zip_with(F.coalesce("relevance", zeros), zeros, lambda x, y: F.coalesce(x, y)), 1, variants)
    one = results.withColumn("key", key).withColumn("wide", wide).groupBy("query_id", "key", "route").agg(
        F.min("rank").alias("rank"), F.max("score").alias("score"), F.min("doc_id").alias("doc_id"), *[F.max(F.element_at("wide", i + 1)).alias(f"v{i}") for i in range(variants)]
    )
    fused = one.groupBy("query_id", "key").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS).alias("rrf"), F.min("doc_id").alias("doc_id"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("route", "score")))).alias("route_scores"),
        F.array(*[F.max(f"v{i}") for i in range(variants)]).alias("facets"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "key")).cast("long")
    first = fused.withColumn("place", place).filter(F.col("place") <= max(limit, top_k))
    judged = first.join(scores.select("query_id", "key", "rerank_score").dropDuplicates(["query_id", "key"]), ["query_id", "key"], "left").withColumn("score", F.coalesce("rerank_score", "rrf"))
    facets = F.col("facets") if variants > 1 else F.array().cast("array<double>")
    seats = facet_seats(judged.select("query_id", F.col("place").alias("chunk_id"), "doc_id", "score", facets.alias("facets")), top_k, max(min(variants, top_k), per_doc))
    failed = status.filter(~F.col("ok")).groupBy("query_id").agg(F.sort_array(F.collect_set("route")).alias("degraded"))
    out = judged.join(seats.withColumnRenamed("chunk_id", "place"), ["query_id", "place"]).join(failed, "query_id", "left")
    return out.select("query_id", "seat", "key", "doc_id", "score", "rrf", F.map_keys("route_scores").alias("routes"), "route_scores", "degraded")
