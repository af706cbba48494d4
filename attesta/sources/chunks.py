"""A table of chunks that look-ups read without moving it: partitioned by knowledge base, bucketed and sorted by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import scratch

BUCKETS = 16


class ChunkTable:
    """Chunks (kb_id, doc_id, idx, content and others) as a catalogue table.

    A filter on kb_id reads that base's folders alone; a join on it prunes them at run time by what the other side holds. A look-up by
    document or place deals out its own few rows to the table's buckets; the chunks stay where they are.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def write(self, chunks: DataFrame) -> ChunkTable:
        """Replaces the table, in a new folder that the cluster shares. One task writes a bucket, so that a base has as many files as buckets;
        a bucket that is large for one task is dealt to several. The writer sorts each file."""
        bucket = F.pmod(F.hash("doc_id"), F.lit(self.buckets))
        dealt = chunks.withColumn("_bucket", bucket).hint("rebalance", "_bucket").drop("_bucket")
        dealt.write.mode("overwrite").partitionBy("kb_id").bucketBy(self.buckets, "doc_id").sortBy("doc_id", "idx").format("parquet").option("path", scratch(self.spark, self.name)).saveAsTable(self.name)
        return self

    def read(self, *bases) -> DataFrame:
        """The chunks of some knowledge bases, of all without any."""
        rows = self.spark.table(self.name)
        return rows.filter(F.col("kb_id").isin(*bases)) if bases else rows

    def _met(self, rows: DataFrame, *keys: str) -> DataFrame:
        """``rows`` with the columns of the chunks of equal keys. The join is on doc_id alone, which both sides are dealt out by; other keys
        are compared as bounds, which the planner does not take for keys that the chunks would have to be dealt out by anew."""
        held = self.read()
        renamed = {c: f"_{c}" for c in ("doc_id", *keys)}
        own = rows.withColumnsRenamed(renamed).repartition(self.buckets, "_doc_id")
        same = F.col("_doc_id") == F.col("doc_id")
        for k in keys:
            same = same & (F.col(f"_{k}") >= F.col(k)) & (F.col(f"_{k}") <= F.col(k))
        return own.join(held.hint("merge"), same).drop(*renamed.values())

    def of_documents(self, documents: DataFrame) -> DataFrame:
        """Chunks of documents (kb_id, doc_id, and others), with their columns."""
        return self._met(documents, "kb_id")

    def at(self, places: DataFrame) -> DataFrame:
        """Chunks at places (kb_id, doc_id, idx, and others), with their columns."""
        return self._met(places, "kb_id", "idx")

    def neighbours(self, seeds: DataFrame, window: int = 1, most: int = 4, damp: float = 0.95) -> DataFrame:
        """(query_id, kb_id, doc_id, idx, score, kind): seeds (query_id, kb_id, doc_id, idx, score) and up to ``most`` chunks next to them, best first.

        A neighbour is at most ``window`` places away in the same document and no seed itself; of several seeds it takes the best score, damped.
        """
        keys = ["query_id", "kb_id", "doc_id", "idx"]
        offsets = F.explode(F.array(*[F.lit(o) for o in range(-window, window + 1) if o]))
        near = seeds.select(*keys, "score", offsets.alias("o")).select("query_id", "kb_id", "doc_id", (F.col("idx") + F.col("o")).alias("idx"), (F.col("score") * damp).alias("score"))
        near = near.groupBy(*keys).agg(F.max("score").alias("score")).join(seeds.select(*keys), keys, "left_anti")
        held = self.at(near).select(*keys, "score")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "kb_id", "doc_id", "idx")
        kept = held.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")
        return seeds.select(*keys, "score", F.lit("seed").alias("kind")).unionByName(kept.withColumn("kind", F.lit("neighbour")))
