"""Vector operators: exact cosine top-k, audit, pairwise similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_DIGITS = 9
BLOCK = 8192  # rows of a block of vectors
CELLS = 1 << 22  # scores that are held at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, unequal or zero vectors."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n), F.lit(0.0))


def cosine_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k most similar chunks, ties to the smaller id.

    Both inputs have an id and ``embedding``. Every block of queries meets every block of chunks in one
    matrix product for each length of vectors; the k best of each meeting are merged. Vectors of different lengths,
    empty ones, zero vectors and those with a component that is null or not finite score 0; null vectors take no part.
    """
    nq, nc = max(1, -(-queries.count() // block)), max(1, -(-chunks.count() // block))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = queries.select(deal("query_id", nq).alias("qb"), every(nc).alias("cb"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "embedding").unionByName(
        chunks.select(every(nq).alias("qb"), deal("chunk_id", nc).alias("cb"), F.lit(False).alias("asks"), F.col("chunk_id").alias("id"), "embedding")
    ).filter("embedding is not null")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, held = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(asks) or not len(held):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})

        def unit(vectors: list) -> np.ndarray:
            m = np.array([np.asarray(v, np.float64) for v in vectors])
            m[~np.isfinite(m).all(axis=1)] = 0
            return m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)

        scores = np.zeros((len(asks), len(held)))
        lengths = [np.array([len(v) for v in x["embedding"]]) for x in (asks, held)]
        for n in set(lengths[0]) & set(lengths[1]) - {0}:
            i, j = (np.flatnonzero(x == n) for x in lengths)
            scores[np.ix_(i, j)] = unit([asks["embedding"].iloc[k] for k in i]) @ unit([held["embedding"].iloc[k] for k in j]).T
        ids = held["id"].to_numpy()
        out = []
        for i, s in enumerate(np.round(scores, SCORE_DIGITS)):
            near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
            near = near[np.lexsort((ids[near], -s[near]))][:k]
            out.append(pd.DataFrame({"query_id": asks["id"].iloc[i], "chunk_id": ids[near], "score": s[near]}))
        return pd.concat(out)

    best = rows.groupBy("qb", "cb").applyInPandas(meet, "query_id long, chunk_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, zero ones as they are, and the length of each: 0 for one that is empty or has a null."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    m = np.zeros((len(size), size.max(initial=0)))
    m[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    without = np.bincount(row, flat.is_null().to_numpy(zero_copy_only=False), len(size)) > 0
    size[without], m[without] = 0, 0
    with np.errstate(invalid="ignore"):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n), size


def _nearest(asks: pa.Table, held: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """(query_id, user_id, id, score) of the k best rows of its user for each row of ``asks``."""
    if not len(asks) or not len(held):
        return schema.empty_table()
    held = held.take(pc.sort_indices(held, sort_keys=[("user_id", "ascending"), ("id", "ascending")]))
    users = pc.unique(held.column("user_id"))
    own = pc.index_in(held.column("user_id"), value_set=users).to_numpy()
    asked = pc.fill_null(pc.index_in(asks.column("user_id"), value_set=users), -1).to_numpy()
    (a, la), (b, lb) = (_matrix(t.column("embedding").combine_chunks()) for t in (asks, held))
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    first = np.searchsorted(own, np.arange(len(users) + 1))
    order = np.argsort(asked, kind="stable")
    rows, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for u, mine in enumerate(np.split(order, np.searchsorted(asked[order], np.arange(len(users) + 1)))[1:-1]):
        lo, hi = first[u], first[u + 1]
        step = max(1, CELLS // (hi - lo))
        for x in range(0, len(mine), step):  # some queries at a time against all rows of the user
            at = mine[x : x + step]
            with np.errstate(invalid="ignore"):
                s = a[at] @ b[lo:hi].T
            s = np.round(np.where((la[at, None] == lb[None, lo:hi]) & (la[at, None] > 0), s, 0.0), SCORE_DIGITS) + 0.0
            falling = np.where(np.isnan(s), -np.inf, -s)  # NaN is the largest in Spark's order
            for i, f in enumerate(falling):
                near = np.flatnonzero(f <= np.partition(f, k - 1)[k - 1]) if len(f) > k else np.arange(len(f))
                near = near[np.argsort(f[near], kind="stable")][:k]
                rows.append(np.full(len(near), at[i]))
                places.append(lo + near)
                scores.append(s[i, near])
    row, place = np.concatenate(rows), np.concatenate(places)
    return pa.table([asks.column("id").take(pa.array(row)), asks.column("user_id").take(pa.array(row)), held.column("id").take(pa.array(place)), pa.array(np.concatenate(scores))], names=schema.names)


def cosine_topk_of_users(queries: DataFrame, rows: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, user_id, id, score, rank) of the k rows (id, user_id, embedding) of its user that are most similar to each query (query_id, user_id, embedding), ties to the smaller id.

    Scores are those of ``cosine``; rows without a user or a vector take no part. Small users are dealt into tasks of about ``block`` rows,
    a larger one into blocks: each block of its queries meets each block of its rows. A task's products are of bounded size.
    """
    asks, held = (df.filter("user_id is not null and embedding is not null").select(F.col(c).alias("id"), *[F.col(x).alias(x) for x in ("user_id", "embedding")]) for df, c in ((queries, "query_id"), (rows, "id")))
    sizes = held.groupBy("user_id").agg(F.count("*").alias("n")).join(asks.groupBy("user_id").agg(F.count("*").alias("asking")), "user_id")
    all_ = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("asking"), F.lit(0))).first()
    tasks = max(1, -(-max(all_) // block))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int").alias(c)
    large = F.broadcast(sizes.filter((F.col("n") > block) | (F.col("asking") > block)).select("user_id", blocks("n"), blocks("asking")))  # as many as there are blocks at most

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one block of its own side, for each block of the other; a task of small users is one block."""
        of = {own: F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int"), other: F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))}
        owner = F.when(F.col("n").isNotNull(), F.col("user_id").cast("string")).otherwise("").alias("owner")
        task = F.when(F.col("n").isNotNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(tasks))).cast("int").alias("task")
        return df.join(large, "user_id", "left").select(owner, task, of["asking"].alias("qb"), of["n"].alias("cb"), *[F.col(c).alias(c) for c in ("id", "user_id", "embedding")])  # both sides may be one table: columns of their own

    types = [queries.schema["query_id"].dataType, queries.schema["user_id"].dataType, rows.schema["id"].dataType, T.DoubleType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "user_id", "id", "score"), types, strict=True)])
    keys, arrow = ("owner", "task", "qb", "cb"), queries.sparkSession.createDataFrame([], schema).toArrow().schema

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return _nearest(a, b, k, arrow)

    met = dealt(asks, "asking", "n").groupBy(*keys).cogroup(dealt(held, "n", "asking").groupBy(*keys))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.applyInArrow(meet, schema).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def audit(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: vectors, wrong dimensions, vectors with a component that is null, NaN or infinite, zero vectors."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.agg(
        F.count("*").alias("n"), F.count_if(v.isNull() | (F.size(v) != dim)).alias("bad_dim"),
        F.count_if(v.isNotNull() & ~finite).alias("not_finite"), F.count_if(v.isNotNull() & finite & (norm(v) == 0)).alias("zero_norm"),
    )


def mean_cosine(vectors: DataFrame, by: str) -> DataFrame:
    """Mean cosine of all pairs within each group, from sums alone: the squared length of the summed unit
    vectors holds every pair twice and each vector once, so no pair is ever formed."""
    unit = vectors.filter(norm(F.col("embedding")) > 0).select(by, F.posexplode(F.transform("embedding", lambda x: x.cast("double") / norm(F.col("embedding")))).alias("d", "x"))
    sums = unit.groupBy(by, "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n")).filter("n > 1").select(
        by, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.round((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine")
    )
