"""A stored exact vector index: pivots with radii, and cosine top-k by the triangle bound.

Every unit vector goes to the nearest of some pivots; a part is a pivot's vectors, cut into rows of at most ``ROW``, each with the largest angle
between the pivot and its vectors. A query at angle a from a pivot is at least a - radius from every vector of the row, so a row is
opened only if that angle is within the k-th best found so far. The first bound comes from the rows nearest to a query. What is
skipped is proven to be worse, so results equal a comparison with all; how much is skipped depends on the data, and
``Found`` tells it. Random vectors of many dimensions are nearly at right angles and little is skipped; clustered ones are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch, settle
from .dense import SCORE_DIGITS

PIVOTS = 4096  # at most; else the root of the number of vectors
ROW = 4096  # vectors of a row
QUERIES = 1024  # queries of a pass, which each task is sent
NEAREST = 2  # rows that a query opens first
_SLACK = 2 * 10.0**-SCORE_DIGITS
_ROW = "dim int, part long, piece int, n long, centre binary, radius double, ids binary, vectors binary"


def _units(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _known(rows: DataFrame, id_: str) -> DataFrame:
    """(id, dim, embedding); dim is null where a vector is empty, zero or holds a null or no finite number; null vectors are left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    good = finite & F.exists(x, lambda c: c != 0)
    return rows.filter(x.isNotNull()).select(F.col(id_).alias("id"), F.when(good, F.size(x)).alias("dim"), F.transform(x, lambda c: c.cast("double")).alias("embedding"))


class Index:
    """``rows`` of vectors and ``ids`` (id, dim) of all of them, read from ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.rows, self.ids = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/ids")


def build(vectors: DataFrame, path: str | None = None, id_: str = "chunk_id", pivots: int | None = None, row: int = ROW) -> Index:
    """Writes the index of (chunk_id, embedding) to ``path``, by default to a new folder that the cluster shares."""
    spark, path = vectors.sparkSession, path or scratch(vectors.sparkSession, "dense-index")
    own = settle(_known(vectors, id_), "vectors")
    own.select("id", "dim").write.mode("overwrite").parquet(f"{path}/ids")
    good = own.filter("dim is not null")
    sizes = {r["dim"]: r["count"] for r in good.groupBy("dim").count().collect()}  # one for each length
    chosen = {}
    for dim, n in sizes.items():
        most = min(PIVOTS, pivots or math.isqrt(n) + 1)
        picked = good.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(most).select("embedding").collect()  # PIVOTS at most
        chosen[dim] = np.unique(_units([r[0] for r in picked]), axis=0)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for dim, some in pdf.groupby("dim"):
                yield some.assign(part=np.argmax(_units(some["embedding"]) @ chosen[dim].T, axis=1))

    dealt = settle(good.mapInPandas(assign, "id long, dim int, embedding array<double>, part long"), "parts")
    pieces = dealt.groupBy("dim", "part").agg(F.ceil(F.count("*") / row).cast("int").alias("pieces"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m, centre = _units(pdf["embedding"]), chosen[pdf["dim"].iloc[0]][pdf["part"].iloc[0]]
        first = {c: pdf[c].iloc[0] for c in ("dim", "part", "piece")}
        return pd.DataFrame([first | {"n": len(m), "centre": centre.tobytes(), "radius": float(_angle(m @ centre).max()), "ids": pdf["id"].to_numpy(np.int64).tobytes(), "vectors": m.tobytes()}])

    cut = dealt.join(F.broadcast(pieces), ["dim", "part"]).withColumn("piece", F.pmod(F.xxhash64("id", "embedding"), F.col("pieces")).cast("int")).drop("pieces")  # PIVOTS a length
    cut.groupBy("dim", "part", "piece").applyInPandas(pack, _ROW).write.mode("overwrite").parquet(f"{path}/rows")
    return Index(spark, path)


class Found:
    """``rows`` (query_id, chunk_id, score, rank); ``compared`` pairs of vectors out of ``possible``."""

    def __init__(self, rows: DataFrame, compared: int, possible: int):
        self.rows, self.compared, self.possible = rows, compared, possible


def _open(index: Index, visits: DataFrame, asks: dict[int, np.ndarray], ids: dict[int, np.ndarray], k: int) -> DataFrame:
    """(query, chunk_id, score) of the k best of every row for the queries that open it (dim, part, piece, query)."""
    groups = visits.groupBy("dim", "part", "piece").agg(F.sort_array(F.collect_set("query")).alias("queries"))  # of a pass

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                held, own = np.frombuffer(r.vectors).reshape(r.n, r.dim), np.frombuffer(r.ids, np.int64)
                scores = np.round(asks[r.dim][np.asarray(r.queries)] @ held.T, SCORE_DIGITS)
                for q, s in zip(r.queries, scores, strict=True):
                    near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    near = near[np.lexsort((own[near], -s[near]))][:k]
                    yield pd.DataFrame({"query_id": ids[r.dim][q], "dim": r.dim, "query": q, "chunk_id": own[near], "score": s[near]})

    opened = index.rows.select("dim", "part", "piece", "n", "ids", "vectors").join(groups, ["dim", "part", "piece"])
    return opened.mapInPandas(compare, "query_id long, dim int, query long, chunk_id long, score double")


def search(index: Index, queries: DataFrame, k: int = 5, pass_: int = QUERIES) -> Found:
    """The k chunks of the largest cosine for each query (query_id, embedding), ties to the smaller id; scores are those of ``dense.cosine_topk``.

    A query or vector that is empty, zero, of another length or not finite scores 0, null ones take no part. Queries
    are worked off in passes of ``pass_``; each pass reads the rows' pivots twice and opens the rows that a query could need.
    """
    spark = queries.sparkSession
    asked = settle(_known(queries, "query_id"), "queries")
    total, held = asked.count(), index.ids.count()
    order = Window.partitionBy("dim").orderBy("id")
    smallest = {}
    for r in index.ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).collect():  # k of each length
        smallest.setdefault(r["dim"], []).append(r["id"])
    out, compared = [], 0
    for p in range(max(1, -(-total // pass_))):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // pass_)))) == p).orderBy("id").collect()  # of a pass
        asks, ids = {}, {}
        for dim in {r["dim"] for r in rows if r["dim"] is not None}:
            own = [r for r in rows if r["dim"] == dim]
            asks[dim], ids[dim] = _units([r["embedding"] for r in own]), np.array([r["id"] for r in own])
        zeros = [(r["id"], i, 0.0) for r in rows for i in sorted(i for d, some in smallest.items() if d is None or d != r["dim"] for i in some)[:k]]
        if zeros:
            out.append(spark.createDataFrame(zeros, "query_id long, chunk_id long, score double"))
        if not asks:
            continue

        def nearest(parts: Iterator[pd.DataFrame], reach: dict | None = None, asks=asks) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for r in pdf.itertuples(index=False):
                    if r.dim not in asks:
                        continue
                    angle = _angle(asks[r.dim] @ np.frombuffer(r.centre))
                    gap = np.maximum(0.0, angle - r.radius - 1e-7)
                    own = np.arange(len(angle)) if reach is None else np.flatnonzero(np.cos(gap) >= reach[r.dim] - _SLACK)
                    yield pd.DataFrame({"dim": r.dim, "part": r.part, "piece": r.piece, "n": r.n, "query": own, "angle": angle[own]})

        schema = "dim int, part long, piece int, n long, query long, angle double"
        centres = index.rows.select("dim", "part", "piece", "n", "centre", "radius")
        first = Window.partitionBy("dim", "query").orderBy("angle", "part", "piece")
        seen = settle(centres.mapInPandas(nearest, schema).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= NEAREST), "nearest")
        by_score = Window.partitionBy("dim", "query").orderBy(F.desc("score"))
        kth = _open(index, seen, asks, ids, k).withColumn("at", F.row_number().over(by_score)).filter(F.col("at") == k).select("dim", "query", "score").collect()  # of a pass
        reach = {dim: np.full(len(m), -1.0) for dim, m in asks.items()}
        for r in kth:
            reach[r["dim"]][r["query"]] = r["score"]
        alive = settle(centres.mapInPandas(lambda parts, reach=reach, f=nearest: f(parts, reach), schema), "alive")
        compared += (alive.agg(F.sum("n")).first()[0] or 0) + (seen.join(alive, ["dim", "part", "piece", "query"], "left_anti").agg(F.sum("n")).first()[0] or 0)
        out.append(settle(_open(index, alive, asks, ids, k).select("query_id", "chunk_id", "score"), "found"))
    found = out[0] if out else spark.createDataFrame([], "query_id long, chunk_id long, score double")
    for more in out[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return Found(found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k), compared, total * held)
