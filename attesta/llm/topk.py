"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Components are integers. The candidates are indexed once, in blocks: a block is a row with its posting lists, one for
each impact level and dimension, levels from large to small. A posting is a candidate with its entry. Lists are added
to the accumulators level by level, for a batch of queries at once. What is still to come for a candidate is at most
the query's unread mass times the largest entry of the levels below, so every accumulator has a lower and an upper
bound; a query stops only once few candidates' upper bounds reach the k-th best lower bound, and those possible
members are scored again exactly.

Queries pass over the index in blocks of ``QUERY_BLOCK``, which is what a task is sent at once; neither vectors nor
index are ever copied for a pass, and the k best of every meeting are merged. Blocks of candidates and of queries
are smaller where vectors are wide: their bytes have a bound, not their rows alone. A query is known by a number
of its own from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import in_arrow, materialise, read, table_path

K = 5
QUERY_EVERY = 50
SCALE = 256
LEVELS = (64, 32, 16, 8, 4, 1)  # an entry is in the first level that it reaches
BLOCK = 4096  # candidates of a block
QUERY_BLOCK = 8192  # queries of a pass
BLOCK_BYTES = 4 << 20  # of the vectors of a block of either kind
_QUERIES = 64  # queries whose accumulators are held at once
_POSSIBLE = 32  # times k: a query with more possible members reads on


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with v the floors of ``scale`` times the components; without vectors that are null or hold a null, NaN or infinity."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.filter(x.isNotNull() & finite & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long")).alias("v")
    )


class Index:
    """Posting lists of a block of candidates: ``lists`` has the level, dimension, and run of postings of each, in order of level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        row, dim = np.nonzero(vectors)
        size = np.abs(vectors[row, dim])
        level = np.searchsorted(-np.array(LEVELS), -size)  # of the first level that is reached
        order = np.lexsort((row, dim, level))
        self.row, self.value = row[order].astype(np.int32), vectors[row, dim][order]
        level, dim = level[order], dim[order]
        begin = np.flatnonzero(np.r_[True, (np.diff(level) != 0) | (np.diff(dim) != 0)]) if len(level) else np.zeros(0, np.int64)
        self.lists = np.c_[level[begin], dim[begin], begin, np.r_[begin[1:], len(level)]] if len(begin) else np.zeros((0, 4), np.int64)
        self.below = [int(size[size < x].max(initial=0)) for x in LEVELS]  # largest entry of the levels after each

    def pack(self) -> dict:
        """The block as a row."""
        parts = {"ids": self.ids, "vectors": self.vectors, "row": self.row, "value": self.value, "lists": self.lists.astype(np.int64), "below": np.array(self.below)}
        return {"n": len(self.ids), "width": self.vectors.shape[1]} | {k: v.astype(v.dtype.newbyteorder("<")).tobytes() for k, v in parts.items()}

    @staticmethod
    def unpack(row: dict) -> Index:
        out = Index.__new__(Index)
        of = lambda name, kind="<i8": np.frombuffer(row[name], kind)
        out.ids, out.vectors = of("ids"), of("vectors").reshape(row["n"], row["width"])
        out.row, out.value, out.lists, out.below = of("row", "<i4"), of("value"), of("lists").reshape(-1, 4), of("below").tolist()
        return out

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, candidates, scores) of each query's k best, ties to the smaller id."""
        width = max(self.vectors.shape[1], queries.shape[1])
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.value).max(initial=0)) * width
        kind = np.float32 if most < 1 << 24 else np.float64  # sums of integers are exact in either
        if queries.shape[1] < width:
            queries = np.c_[queries, np.zeros((len(queries), width - queries.shape[1]), queries.dtype)]
        n, value = len(self.ids), self.value.astype(kind)
        for at in range(0, len(queries), _QUERIES):
            q, asks = queries[at : at + _QUERIES], query_ids[at : at + _QUERIES]
            f = q.T.astype(kind)
            size = np.abs(f)
            own = self.ids[:, None] == asks[None, :]
            score = np.zeros((n, len(q)), kind)
            unread = np.repeat(size.sum(axis=0)[None, :], n, axis=0)
            possible = ~own
            open_ = np.arange(len(q))  # queries that read on, and the columns of their accumulators
            for level in range(len(LEVELS)):
                for _, dim, begin, end in self.lists[self.lists[:, 0] == level]:
                    row = self.row[begin:end]  # each once
                    score[row] += value[begin:end, None] * f[dim, open_]
                    unread[row] -= size[dim, open_]
                slack = unread * self.below[level]
                low = np.where(own[:, open_], -np.inf, score - slack)
                if n > k:
                    reach = np.partition(low, n - k, axis=0)[n - k]
                    possible[:, open_] = ~own[:, open_] & (score + slack >= reach)
                on = possible[:, open_].sum(axis=0) > _POSSIBLE * k
                if not on.any():
                    break
                if not on.all():
                    open_, score, unread = open_[on], score[:, on], unread[:, on]
            query, column = np.nonzero(possible.T)
            exact = np.einsum("ij,ij->i", q[query, : self.vectors.shape[1]], self.vectors[column])
            order = np.lexsort((self.ids[column], -exact, query))
            first = np.searchsorted(query[order], np.arange(len(q) + 1))
            for i in range(len(q)):
                some = order[first[i] : min(first[i] + k, first[i + 1])]
                yield at + i, self.ids[column[some]], exact[some]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


_BLOCK_ROW = "n long, width long, ids binary, vectors binary, row binary, value binary, lists binary, below binary"
_QUERY_ROW = "qb int, n long, width long, numbers binary, ids binary, vectors binary"


def _blocks(vectors: DataFrame, rows: int) -> int:
    """The number of blocks of at most about ``rows`` rows and ``BLOCK_BYTES`` bytes."""
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    return max(1, -(-n // max(1, min(rows, BLOCK_BYTES // (8 * max(1, width))))))


def _dealt(vectors: DataFrame, blocks: int, *more: str) -> DataFrame:
    return vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v", *more)


def build_index(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """The candidates (vec_id, v) as rows of posting lists of about ``block`` of them each."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["v"]), default=0)
        return pd.DataFrame([Index(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"], width)).pack()])

    candidates = candidates.distinct()
    blocks = _blocks(candidates, block)
    return materialise(_dealt(candidates, blocks).repartition(blocks, "block").groupBy("block").applyInPandas(build, _BLOCK_ROW), "index")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = BLOCK, pass_: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products with candidates of another id.

    Both inputs are (vec_id, v). Fewer than k candidates give fewer rows, none gives none. Vectors of
    different lengths are compared as if the shorter ended in zeros. Ties go to the smaller vec_id.
    Repeated equal rows count once; rows of one id with different vectors are separate rows.
    """
    index = build_index(candidates, block).withColumn("meets", F.lit(1))

    def block_row(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["v"]), default=0)
        parts = {c: pdf[c].to_numpy("<i8").tobytes() for c in ("number", "vec_id")}
        return pd.DataFrame([{"qb": pdf["block"].iloc[0], "n": len(pdf), "width": width, "numbers": parts["number"], "ids": parts["vec_id"], "vectors": _matrix(pdf["v"], width).tobytes()}])

    queries = materialise(queries.distinct().withColumn("number", F.monotonically_increasing_id()), "numbered")
    passes = _blocks(queries, pass_)
    asked = materialise(_dealt(queries, passes, "number").groupBy("block").applyInPandas(block_row, _QUERY_ROW), "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers, ids = np.frombuffer(row["q_numbers"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                vectors = np.frombuffer(row["q_vectors"], "<i8").reshape(row["q_n"], row["q_width"])
                out = [(ids[i], numbers[i], c, s) for i, found, scores in Index.unpack(row).best(ids, vectors, k) for c, s in zip(found, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([int(r[c]) for r in out], pa.int64()) for c in range(4)], ["query_id", "number", "vec_id", "score"])

    path = table_path(queries.sparkSession, "meetings")
    schema = "query_id long, number long, vec_id long, score long"
    for b in range(passes):
        own = asked.filter(F.col("qb") == b).select(F.lit(1).alias("meets"), *[F.col(c).alias(f"q_{c}") for c in ("n", "width", "numbers", "ids", "vectors")])
        met = index.join(F.broadcast(own), "meets").transform(in_arrow, meet, schema)  # one row of BLOCK_BYTES
        met.write.mode("append").parquet(path)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    found = queries.sparkSession.read.schema(schema).parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(integer_vectors(read(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.filter(F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0), vectors)


OP8_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
