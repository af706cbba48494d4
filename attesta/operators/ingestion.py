"""Change-driven ingestion: only documents that are new or changed are cut and given vectors, and no chunk outlives its text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.store import BUCKETS, KeyedStore
from ..sources.tables import settle
from . import chunking

CHUNK = "doc_id long, id string, idx long, content string, content_hash string, embedding array<float>"
STATE = "doc_id long, filename string, content_hash string, chunks long"


class Ingestion:
    """Stored documents under ``path``: their chunks, and the content hash that each was cut from.

    ``embed`` is a function from a table and the name of its text column to the table with ``embedding``.
    A run compares hashes with the stored state, replaces the chunks of documents that differ, then the state, and notes its batch id
    last: a run that failed is repeated as a whole and ends in the same state, one that is noted is not run again.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame, str], DataFrame], how: str = "text", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, buckets: int = BUCKETS):
        self.embed, self.cut = embed, (how, size, overlap)
        self.chunks = KeyedStore(spark, f"{path}/chunks", "doc_id", CHUNK, buckets)
        self.state = KeyedStore(spark, f"{path}/state", "doc_id", STATE, buckets)
        self.batches = KeyedStore(spark, f"{path}/batches", "batch_id", "batch_id long", 1)

    def changes(self, docs: DataFrame, complete: bool = False) -> DataFrame:
        """(doc_id, filename, text, content_hash, change) of documents (doc_id, filename, text).

        change: added, changed (another text or file name), unchanged, or deleted: a null text in ``docs``, or, where ``docs``
        is ``complete``, a stored document that it lacks. Of several rows of a doc_id the largest (filename, text) counts; rows without one are left out.
        """
        one = docs.filter("doc_id is not null").select("doc_id", "filename", "text")
        if one.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # texts are sorted only where ids are repeated
            one = one.groupBy("doc_id").agg(F.max(F.struct("filename", "text")).alias("d")).select("doc_id", "d.filename", "d.text")
        new = one.withColumn("content_hash", F.sha2("text", 256))
        old = self.state.read().select("doc_id", F.col("filename").alias("old_name"), F.col("content_hash").alias("old"))
        both = new.withColumn("given", F.lit(True)).join(old, "doc_id", "full_outer" if complete else "left")
        gone = F.col("content_hash").isNull() & F.col("old").isNotNull()
        same = F.col("content_hash").eqNullSafe(F.col("old")) & F.col("filename").eqNullSafe(F.col("old_name"))
        change = F.when(gone, "deleted").when(F.col("old").isNull(), "added").when(same, "unchanged").otherwise("changed")
        known = both.filter("old is not null or content_hash is not null")
        return known.select("doc_id", "filename", "text", "content_hash", change.alias("change"))

    def run(self, docs: DataFrame, batch_id: int | None = None, complete: bool = False) -> dict[str, int] | None:
        """Brings the stored chunks up to ``docs``; the number of documents of each change, and of chunks that were given vectors. None: the batch was run before."""
        if batch_id is not None and self.batches.of(batch_id).limit(1).count():
            return None
        found = settle(self.changes(docs, complete), "changes")
        fresh = found.filter(F.col("change").isin("added", "changed"))
        pieces = chunking.chunks(fresh.select(F.struct("doc_id", "filename").alias("doc_id"), "text"), *self.cut).select("doc_id.*", "idx", "content")
        rows = pieces.select("doc_id", text.chunk_id(F.col("filename"), F.col("idx"), F.col("content")).alias("id"), F.col("idx").cast("long").alias("idx"), "content", F.sha2("content", 256).alias("content_hash"))
        rows = settle(self.embed(rows, "content"), "chunks")
        touched = found.filter("change != 'unchanged'").select("doc_id")
        self.chunks.replace(rows, touched, settled=True)
        counts = rows.groupBy("doc_id").agg(F.count("*").alias("chunks"))
        self.state.replace(fresh.join(counts, "doc_id", "left").select("doc_id", "filename", "content_hash", F.coalesce("chunks", F.lit(0)).alias("chunks")), touched)
        if batch_id is not None:
            self.batches.replace(docs.sparkSession.createDataFrame([(batch_id,)], "batch_id long"))
        out = dict.fromkeys(("added", "changed", "unchanged", "deleted"), 0) | {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
        return out | {"embedded": rows.count()}

    def stream(self, docs: DataFrame, checkpoint: str):
        """Runs every micro-batch of a stream of documents once."""
        return docs.writeStream.foreachBatch(lambda batch, number: self.run(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
