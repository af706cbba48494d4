"""A keyed store of Parquet files that changes in place: rows of a key are replaced or deleted without the rest being written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import settle

BUCKETS = 64


class KeyedStore:
    """Rows of ``schema`` under ``path``, in ``buckets`` partitions by the hash of ``key``.

    A change rewrites the partitions of its keys by a dynamic overwrite; files of others keep their names and times. A change that
    failed is done by running it again: what it leaves depends on its input alone. Keys are not null; one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        empty = spark.createDataFrame([], self.schema).withColumn("bucket", self.bucket(F.col(key)))
        empty.write.mode("append").partitionBy("bucket").parquet(self.path)  # makes the folder

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().filter(F.col(self.key).isNotNull()).drop("bucket")

    def of(self, *keys) -> DataFrame:
        """Rows of some keys; only their partitions are read."""
        kind = self.schema[self.key].dataType
        own = None
        for k in keys:
            one = (F.col("bucket") == self.bucket(F.lit(k).cast(kind))) & (F.col(self.key) == F.lit(k).cast(kind))
            own = one if own is None else own | one
        return self._stored().filter(own if own is not None else F.lit(False)).drop("bucket")

    def replace(self, rows: DataFrame, gone: DataFrame | None = None, settled: bool = False) -> int:
        """Puts ``rows`` in place of all rows of their keys and of the keys ``gone`` (key); gives the number of partitions that were written.

        ``settled``: the caller has written ``rows``, and they are not written a second time.
        """
        new = rows.select(*[F.col(c).cast(f.dataType).alias(c) for c, f in ((f.name, f) for f in self.schema)]).filter(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket(F.col(self.key)))
        new = new if settled else settle(new, "new")
        keys = new.select(self.key, "bucket")
        if gone is not None:
            kind = self.schema[self.key].dataType
            keys = keys.unionByName(gone.select(F.col(self.key).cast(kind).alias(self.key)).filter(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket(F.col(self.key))))
        keys = settle(keys.distinct(), "keys")
        touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # as many as there are partitions at most
        if not touched:
            return 0
        kept = self._stored().filter(F.col("bucket").isin(touched) & F.col(self.key).isNotNull()).join(keys.select(self.key), self.key, "left_anti")
        # a row without a key stands in every touched partition, so that one that loses all its rows is written too
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], "bucket")
        merged = kept.select(*self.schema.names, "bucket").unionByName(new).unionByName(marks)
        # old files are read until all new ones are staged; a partition that is large for one task is dealt to several
        merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return len(touched)

    def upsert(self, rows: DataFrame, order: str) -> int:
        """The last of the rows of each key by ``order`` replaces what is stored of it."""
        last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
        return self.replace(last)

    def delete(self, keys: DataFrame) -> int:
        return self.replace(self.spark.createDataFrame([], self.schema), keys)
