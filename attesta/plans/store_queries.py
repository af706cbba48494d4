"""Registered queries over stored structures: duplicate filters, indexes, stores and streams kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, dense_index, firstwins, ingest, lexical
from ..operators.ingestion import Ingestion
from ..sources.chunks import ChunkTable
from ..sources.store import KeyedStore
from ..sources.tables import scratch, settle, table
from ..streaming import tasks


def first_wins_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no kept document before them equals in four fifths of their words."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return firstwins.first_wins(docs).rows.select(F.col("id").alias("doc_id"), "kept")


def first_wins_turns(spark: SparkSession, d: str) -> DataFrame:
    """The same over the texts of conversations, at half of their words: many short texts, and chains of them."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return firstwins.first_wins(turns, 0.5).rows


def dense_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every hundredth, by the stored index."""
    v = table(spark, d, "embeddings")
    index = dense_index.build(v.select(F.col("vec_id").alias("chunk_id"), "embedding"))
    return dense_index.search(index, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).rows


def stored_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders in a keyed store: those that are not open are replaced by rows with their priority, then those of the lowest priority are deleted."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("priority"), "o_totalprice")
    full = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    store = KeyedStore(spark, scratch(spark, "orders"), "o_orderkey", o.schema, 16)
    store.upsert(o, "o_totalprice")
    store.upsert(full.filter("status <> 'O'"), "o_totalprice")
    store.delete(full.filter("priority = '5-LOW'").select("o_orderkey"))
    return store.read().select("o_orderkey", "status", "priority")


def latest_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """The last turn of each conversation, in a store of one row a session that is written turn by turn, users' turns first."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.md5("text").alias("state"))
    store = KeyedStore(spark, scratch(spark, "sessions"), "session_id", c.schema, 8)
    store.upsert(c.filter("role = 'user'"), "turn")
    stored = store.read().select("session_id", F.col("turn").alias("known"))
    newer = c.join(stored, "session_id", "left").filter("known is null or turn > known").drop("known")
    store.upsert(newer, "turn")
    return store.read()


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and a later state of them: English ones are revised, those of one source are gone."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"), "text", "lang", "source")
    later = docs.filter("source <> 'src0'").withColumn("text", F.when(F.col("lang") == "en", F.concat(F.lit("revised. "), "text")).otherwise(F.col("text")))
    return docs.drop("lang", "source"), later.drop("lang", "source")


def ingestion_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a second run over the documents finds, and the chunks that are stored after it."""
    first, second = _snapshots(spark, d)
    store = Ingestion(spark, scratch(spark, "ingestion"), lambda rows, column: ingest.with_digest_vectors(rows, column, 16), "fixed", buckets=8)
    store.run(first, 0, complete=True)
    counts = store.changes(second, complete=True).select("doc_id", "change")
    noted = scratch(spark, "changes")
    counts.write.parquet(noted)
    store.run(second, 1, complete=True)
    held = store.chunks.read().groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters"), F.min("content_hash").alias("least_hash"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spark.read.schema("doc_id long, change string").parquet(noted).join(held, "doc_id", "left").select("doc_id", "change", zero("chunks"), zero("characters"), "least_hash")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def task_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as the lives of tasks: a signup is another start, a purchase a success, an error a failure, a click a cancellation once its value is over 90."""
    e = _events(spark, d)
    event = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").when((F.col("event_type") == "click") & (F.col("value") > 90), "cancel").otherwise("start")
    rows = e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("task_id"), "ts", event.alias("event"))
    return tasks.transitions(rows, 1, 3600.0, 7200.0).withColumn("at", F.col("at").cast("timestamp_ntz"))


def lease_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as claims of their user's rows, purchases as acknowledgements within twelve hours, those under 10 not ok."""
    e = _events(spark, d)
    claims = e.filter("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("ts").alias("claimed_at"))
    acks = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.col("ts").alias("acked_at"), (F.col("value") >= 10).alias("ok"))
    found = tasks.lease_outcomes(claims, acks, "12 hours")
    return found.groupBy("id", "outcome").agg(F.count("*").alias("n"), F.min("claimed_at").cast("timestamp_ntz").alias("first"))


def rate_runs(spark: SparkSession, d: str) -> DataFrame:
    """The independent runs of each user's events, at windows of six hours."""
    own = _events(spark, d).select("event_id", F.col("user_id").alias("key"), "ts")
    return tasks.runs(own, 21600.0).select("event_id", "key", "run")


def rate_limit_hour(spark: SparkSession, d: str) -> DataFrame:
    """One accepted event of a user in any hour."""
    from ..streaming import events as streams

    own = _events(spark, d).select("event_id", F.col("user_id").alias("key"), "ts")
    return streams.rate_limit(own, 1, 3600.0).select("event_id", "key", "accepted")


def chunk_table_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """For each passage the English document that covers most of it, its first window, and the windows next to that, from a table of all windows by language."""
    docs = table(spark, d, "documents")
    chunks = docs.select("doc_id", F.col("lang").alias("kb_id"), F.posexplode(chunking.fixed_windows(F.col("text"))).alias("idx", "content")).withColumn("idx", F.col("idx").cast("long"))
    windows = ChunkTable(spark, "attesta_chunks", 8).write(chunks)
    english = docs.filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    asks = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    best = settle(lexical.coverage_topk(asks, english, 1), "best")
    first = windows.at(best.select("query_id", F.lit("en").alias("kb_id"), F.col("chunk_id").alias("doc_id"), F.lit(0).cast("long").alias("idx"), "score")).select("query_id", "kb_id", "doc_id", "idx", "score")
    return windows.neighbours(first).select("query_id", "doc_id", "idx", F.round("score", 6).alias("score"), "kind")


_TOKENS = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:[._/-][a-z0-9]+)*')"


def _first_wins_sql(source: str, num: int, den: int, id_: str) -> str:
    words = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT id, {words} AS w, len({words}) AS n FROM ({source})),
u AS (SELECT id, n, unnest(w) AS word FROM w),
x AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM u a JOIN u b ON a.word = b.word AND a.id < b.id AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT b AS id, list(a) AS before FROM x WHERE {den} * shared >= {num} * (na + nb - shared) GROUP BY b),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS n FROM e),
f AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone UNION ALL
      SELECT o.n, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, o.id) ELSE gone END FROM f JOIN o ON o.n = f.n + 1)
SELECT id AS {id_}, NOT list_contains((SELECT arg_max(gone, n) FROM f), id) AS kept FROM w
"""


QUERIES = {f.__name__: f for f in (first_wins_documents, first_wins_turns, dense_index_topk, stored_orders, latest_checkpoints, ingestion_changes, task_transitions, lease_outcomes, rate_runs, rate_limit_hour, chunk_table_neighbours)}

ORACLES = {
    "chunk_table_neighbours": f"""WITH q AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format('text')}) AS t FROM benchmark), qt AS (SELECT query_id, len(t) AS wanted, unnest(t) AS term FROM q),
        dt AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM documents WHERE lang = 'en'),
        s AS (SELECT query_id, doc_id, round(count(*) / wanted, 9) AS score FROM dt JOIN qt USING (term) GROUP BY query_id, doc_id, wanted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1)
        SELECT query_id, doc_id, 0::BIGINT AS idx, round(score, 6) AS score, 'seed' AS kind FROM s
        UNION ALL SELECT query_id, doc_id, 1, round(score * 0.95, 6), 'neighbour' FROM s JOIN documents USING (doc_id) WHERE length(text) > 500""",
    "lease_outcomes": """WITH c AS (SELECT user_id AS id, ts AS claimed_at FROM events WHERE event_type = 'click'), a AS (SELECT user_id AS id, ts AS acked_at, value >= 10 AS ok FROM events WHERE event_type = 'purchase'),
        m AS (SELECT c.id, claimed_at, CASE WHEN a.id IS NULL THEN 'expired' WHEN ok THEN 'published' ELSE 'retry' END AS outcome
              FROM c LEFT JOIN a ON c.id = a.id AND acked_at BETWEEN claimed_at AND claimed_at + INTERVAL 12 HOUR)
        SELECT id, outcome, count(*) AS n, min(claimed_at) AS first FROM m GROUP BY id, outcome""",
    "rate_runs": """WITH g AS (SELECT event_id, user_id AS key, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, false)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, key, sum(new) OVER (PARTITION BY key ORDER BY ts, event_id)::BIGINT AS run FROM g""",
    "rate_limit_hour": """WITH RECURSIVE o AS (SELECT event_id, user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT event_id, key, n, true AS accepted, ts AS last FROM o WHERE n = 1 UNION ALL
              SELECT o.event_id, o.key, o.n, f.last <= o.ts - INTERVAL 1 HOUR, CASE WHEN f.last <= o.ts - INTERVAL 1 HOUR THEN o.ts ELSE f.last END FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)
        SELECT event_id, key, accepted FROM f""",
    "stored_orders": "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS priority FROM orders WHERE o_orderpriority <> '5-LOW'",
    "latest_checkpoints": "SELECT conv_id AS session_id, turn, role, md5(text) AS state FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "ingestion_changes": """WITH l AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'deleted' WHEN lang = 'en' THEN 'changed' ELSE 'unchanged' END AS change,
          CASE WHEN source = 'src0' THEN NULL WHEN lang = 'en' THEN 'revised. ' || text ELSE text END AS text FROM documents),
        w AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 500) / 450))::BIGINT + 1)) AS idx FROM l WHERE length(text) > 0),
        c AS (SELECT doc_id, substr(text, idx * 450 + 1, 500) AS content FROM w),
        k AS (SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS characters, min(sha256(content)) AS least_hash FROM c GROUP BY doc_id)
        SELECT doc_id, change, coalesce(chunks, 0) AS chunks, coalesce(characters, 0) AS characters, least_hash FROM l LEFT JOIN k USING (doc_id)""",
    "dense_index_topk": """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score
        FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5""",
    "first_wins_documents": _first_wins_sql("SELECT doc_id AS id, text FROM documents", 4, 5, "doc_id"),
    "first_wins_turns": _first_wins_sql("SELECT conv_id * 1000 + turn AS id, text FROM conversations", 1, 2, "id"),
}
