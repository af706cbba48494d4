"""Whitening of embeddings from a bit-sliced scatter.

Entries are integers. Every dimension is shifted by its smallest entry, so that few bits are left, and its bit planes
are packed across rows into 64-bit words. The number of ones of the AND of two planes, weighted by both planes' places, is
their share of a cross-product: sums of products are exact integers without a multiplication. A plane of ones stands
for the rows themselves, so counts and sums come out of the same table. A task adds up its rows, Spark adds up the tasks; what reaches
the driver has one figure for each two dimensions, whatever the number of rows. There the scatter is centred in
integers, n * sum(xy) - sum(x) * sum(y), before it becomes a double for the eigenvectors.

Cross-products leave a task in limbs of 16 bits, so that sums of 64-bit limbs stay exact up to 2^40 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_arrow, materialise, read

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
MOST = 1 << 61  # a scaled entry beyond it is held at it
LEAST_VARIANCE = 1e-11  # of the largest eigenvalue: a component with less is rounding error, not a direction of the data
_LIMB = 16
_ROWS = 1 << 15  # rows whose planes are held at once
_PLANE_BYTES = 1 << 23  # of the planes that meet one plane at once


def integer_rows(rows: DataFrame, column: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``rows`` with ``x``, the floors of ``scale`` times the entries plus ``offset``; without rows whose vector is null or holds a null, NaN or infinity."""
    v = F.col(f"`{column}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(scale * c.cast("double")).cast("double")))
    exact = lambda c: F.when(F.abs(c.cast("double")) < 2.0**46, F.floor(scale * c.cast("double"))).otherwise(held(c).cast("long"))
    return rows.filter(v.isNotNull() & finite).withColumn("x", F.transform(v, lambda c: (exact(c) + F.lit(offset)).cast("long")))


def _matrix(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """A list column as a matrix; a shorter vector ends in ``fill``."""
    out = np.full((len(column), width), fill, np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat) == out.size:
        return flat.reshape(out.shape).astype(np.int64)
    row = np.repeat(np.arange(len(out)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Slices:
    """How the dimensions are sliced: the shift of each, and its planes (dimension, bit); the last dimension is the plane of ones."""

    def __init__(self, low: list[int], high: list[int]):
        self.low = np.array(low, np.int64)
        bits = [(h - b).bit_length() for b, h in zip(low, high, strict=True)]
        self.dims = len(low) + 1
        self.dim = np.array([d for d, n in enumerate(bits) for _ in range(n)] + [len(low)], np.int64)
        self.bit = np.array([p for n in bits for p in range(n)] + [0], np.int64)
        self.first = np.searchsorted(self.dim, np.arange(self.dims + 1))
        self.limbs = max(1, -(-(2 * max([*bits, 1]) - 1) // _LIMB))

    def planes(self, x: np.ndarray) -> np.ndarray:
        """The planes of rows ``x`` as 64-bit words, a row of words for each plane."""
        y = (x - self.low).astype(np.uint64)
        packed = np.zeros((len(self.dim), -(-len(x) // 64) * 8), np.uint8)
        for k, (d, p) in enumerate(zip(self.dim, self.bit, strict=True)):
            ones = (y[:, d] >> np.uint64(p)) & np.uint64(1) if d < self.dims - 1 else np.ones(len(x), np.uint8)
            bytes_ = np.packbits(ones.astype(bool))
            packed[k, : len(bytes_)] = bytes_
        return packed.view(np.uint64)

    def scatter(self, x: np.ndarray) -> np.ndarray:
        """limbs[i, j, l] of the sums of products of shifted dimensions i <= j over rows ``x``."""
        words = self.planes(x)
        out = np.zeros((self.dims, self.dims, self.limbs), np.int64)
        step = max(1, _PLANE_BYTES // max(1, words.shape[1] * 8))
        for k in range(len(words)):
            i = self.dim[k]
            for at in range(self.first[i], len(words), step):
                ones = np.bitwise_count(words[at : at + step] & words[k]).sum(axis=1, dtype=np.int64)
                weight = self.bit[at : at + step] + self.bit[k]
                np.add.at(out, (i, self.dim[at : at + step], weight // _LIMB), ones << (weight % _LIMB))
        return out


def _ranges(rows: DataFrame, fill: int) -> tuple[list[int], list[int]]:
    """The smallest and largest entry of every dimension; a dimension that some vector lacks holds ``fill`` there."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.iinfo(np.int64).max
        for batch in batches:
            if not len(batch):
                continue
            width = max(int(np.diff(batch.column(0).offsets.to_numpy()).max()), 0)
            least = min(least, int(np.diff(batch.column(0).offsets.to_numpy()).min()))
            m = _matrix(batch.column(0), width, fill)
            a, b = m.min(axis=0), m.max(axis=0)
            if width < len(low):
                a, b = (np.concatenate([x, np.full(len(low) - width, fill)]) for x in (a, b))
            elif len(low) and width > len(low):
                low, high = (np.concatenate([x, np.full(width - len(low), fill)]) for x in (low, high))
            low, high = (np.minimum(low, a), np.maximum(high, b)) if len(low) else (a, b)
        if least <= len(low):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high), pa.array(np.full(len(low), least))], ["dim", "low", "high", "least"])

    found = rows.select("x").transform(in_arrow, span, "dim long, low long, high long, least long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least")).orderBy("dim").collect()  # a row a dimension
    least = min((r["least"] for r in found), default=0)
    short = [r["dim"] >= least for r in found]
    return [min(r["low"], fill) if s else r["low"] for r, s in zip(found, short, strict=True)], [max(r["high"], fill) if s else r["high"] for r, s in zip(found, short, strict=True)]


class Scatter:
    """Exact sums over all rows: their number ``n``, ``sums`` of the entries, and the covariance times n squared, as Python integers."""

    def __init__(self, low: list[int], products: dict[tuple[int, int], int]):
        d = len(low)
        self.n = products.get((d, d), 0)
        shifted = [products.get((i, d), 0) for i in range(d)]
        self.sums = [s + self.n * b for s, b in zip(shifted, low, strict=True)]
        self.centred = [[0] * d for _ in range(d)]
        for i in range(d):
            for j in range(i, d):  # a shift does not change the centred product
                self.centred[i][j] = self.centred[j][i] = self.n * products.get((i, j), 0) - shifted[i] * shifted[j]

    def covariance(self) -> np.ndarray:
        return np.array([[c / (self.n * self.n) for c in row] for row in self.centred], np.float64).reshape(len(self.sums), len(self.sums))


def scatter(rows: DataFrame, fill: int = OFFSET) -> Scatter:
    """The exact scatter of the vectors ``x`` of ``rows``, by bit planes."""
    low, high = _ranges(rows, fill)
    slices = Slices(low, high)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((slices.dims, slices.dims, slices.limbs), np.int64)
        for batch in batches:
            m = _matrix(batch.column(0), slices.dims - 1, fill)
            for at in range(0, len(m), _ROWS):
                total += slices.scatter(m[at : at + _ROWS])
        i, j, limb = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (i, j, limb, total[i, j, limb])], ["i", "j", "limb", "part"])

    summed = rows.select("x").transform(in_arrow, count, "i long, j long, limb long, part long").groupBy("i", "j", "limb").agg(F.sum("part").alias("part")).collect()  # some for each two dimensions
    products: dict[tuple[int, int], int] = {}
    for r in summed:
        products[r["i"], r["j"]] = products.get((r["i"], r["j"]), 0) + (r["part"] << (_LIMB * r["limb"]))
    return Scatter(low, products)


class Whitening:
    """Directions of falling variance: ``components`` (a row each), their eigenvalues, and each one's share of all variance."""

    def __init__(self, found: Scatter, most: int):
        v = found.covariance()
        self.n, self.sums, self.width = found.n, found.sums, len(found.sums)
        if not self.n or not self.width or not np.trace(v) > 0:
            self.components, self.values, self.explained = np.zeros((0, self.width)), np.zeros(0), np.zeros(0)
            return
        scale = float(np.abs(np.diag(v)).max())  # keeps very large entries within a double's range
        values, vectors = np.linalg.eigh(v / scale)
        order = np.argsort(-values, kind="stable")
        order = order[values[order] > LEAST_VARIANCE * values.max()][:most]
        self.components, self.values, self.explained = vectors[:, order].T, values[order] * scale, values[order] / np.trace(v / scale)

    def apply(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """deviation (sum of (n x - S)^2, exact) and the whitened components of rows ``x``."""
        most = self.n * (int(np.abs(x).max(initial=0)) + 1) + max([abs(s) for s in self.sums], default=0)
        if most * most * max(1, self.width) < 1 << 63:  # 64-bit integers hold it
            centred = self.n * x - np.array(self.sums, np.int64)
            deviation = (centred * centred).sum(axis=1).tolist()
        else:
            centred = x.astype(object) * self.n - np.array(self.sums, object)
            deviation = [sum(c * c for c in row) for row in centred.tolist()]
        if not len(self.values):
            return deviation, np.zeros((len(x), 0))
        return deviation, (centred.astype(np.float64) / self.n) @ self.components.T / np.sqrt(self.values)


def fit(rows: DataFrame, most: int = COMPONENTS, fill: int = OFFSET) -> Whitening:
    return Whitening(scatter(rows, fill), most)


def _identity_error(whitened: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity: means first, then centred products, both added up by Spark."""

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy().reshape(-1, k)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(k)
        for m in map(rows, batches):
            n, total = n + len(m), total + m.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(np.full(k, n)), pa.array(total)], ["j", "n", "part"])

    first = whitened.select("whitened").transform(in_arrow, means, "j long, n long, part double").groupBy("j").agg(F.sum("n").alias("n"), (F.sum("part") / F.sum("n")).alias("mean")).orderBy("j").collect()
    n, mean = first[0]["n"], np.array([r["mean"] for r in first])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for m in map(rows, batches):
            total += (m - mean).T @ (m - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["cell", "part"])

    same = F.when(F.col("cell") % (k + 1) == 0, 1.0).otherwise(0.0)
    cells = whitened.select("whitened").transform(in_arrow, products, "cell long, part double").groupBy("cell").agg((F.sum("part") / n).alias("c"))
    return cells.agg(F.max(F.abs(F.col("c") - same))).first()[0]


def whiten(rows: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> tuple[DataFrame, Whitening, float | None]:
    """``rows`` with n, deviation (decimal) and whitened (array of up to ``most`` components), the fitted whitening, and the identity error.

    Only the vector column is read; the others come through. Rows whose vector is null or holds a null, NaN or
    infinity are dropped; a shorter vector is as if it ended in zeros, an empty one too. Repeated rows count as
    often as they occur, rows without an id as any other. Components whose variance is rounding error are left out: equal
    vectors, a single row or an empty table have none, and ``whitened`` is empty. Entries beyond 2^61 / 64 are held at
    that. Existing columns named n, deviation, whitened or x are replaced.
    """
    own = integer_rows(rows.drop("n", "deviation", "whitened", "x"), column)
    found = fit(own, most)
    schema = own.drop("x").schema.add("n", T.LongType()).add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own_columns.index("x")
        for batch in batches:
            deviation, w = found.apply(_matrix(batch.column(at), found.width, OFFSET))
            held = [d if d < 10**38 else None for d in deviation]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            own_ = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own_, pa.array(np.full(len(w), found.n)), pa.array(held, pa.decimal128(38, 0)), lists], [f.name for f in schema.fields])

    own_columns = own.columns
    out = materialise(own.transform(in_arrow, apply, schema), "whitened")
    return out, found, _identity_error(out, len(found.values)) if len(found.values) else None


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; a deviation over 64 bits is null."""
    out, found, error = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(float(e)) for e in found.explained]).cast("array<double>")
    rows = out.select("vec_id", F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("at", "c"), "n", "deviation")
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


#: The rule without the method, for tests: n and the exact deviations.
OP13_SUMS_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT + {OFFSET}) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM v),
s AS (SELECT d, sum(x)::BIGINT AS s, count(*) AS n FROM e GROUP BY d)
SELECT vec_id, n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM e JOIN s USING (d) GROUP BY vec_id, n
"""
