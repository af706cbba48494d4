"""Helpers every training-data operator uses: durable intermediate tables and table reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Only a local session may leave it unset; driver and executors are then one process and a
    temporary folder is made once per session.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("attesta.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-attesta-")
    spark.conf.set("attesta.shared.dir", made)
    return made


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ordered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows``, written in a global order, with ``part``, their range of it, and ``place``, from 0; no task has more than a range."""
    cut = materialise(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33))
    within = cut.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("at")).cast("long") - 1)
    return carried(within, "place", F.lit(1).cast("long")).drop("at")


def carried(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """``column``, a running figure within each ``part``, with the sums of ``value`` of the parts before added; there are as many parts as partitions."""
    per = rows.groupBy("part").agg(F.sum(value).alias("sum"))
    before = per.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn(column, F.col(column) + F.col("before")).drop("before")


BATCH_BYTES = 4 << 20  # of an Arrow batch on its way to a Python worker


def in_arrow(rows: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """``rows.mapInArrow``, with the session's bound on a batch's bytes lowered to ``BATCH_BYTES``: a batch of long texts else takes
    tens of MB on either side of every task. A worker gives back what Arrow holds when a task is over, as it may stay idle after it."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) != f"{BATCH_BYTES}b":
        conf.set(key, f"{BATCH_BYTES}b")
    return rows.mapInArrow(lean, schema)


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that clashing or extra columns never reach an operator."""
    return docs.select(*[F.col(c) for c in columns])
