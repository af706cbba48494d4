"""Registered queries over the relational, event and evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import analyzer, critic, evaluation, evidence, feeds, governance
from ..sources import tables
from ..sources.tables import table
from ..streaming import events as streams
from . import sqlguard

NOW = "2024-01-30 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def news_stats(spark: SparkSession, d: str) -> DataFrame:
    return feeds.category_counts(table(spark, d, "events"), "event_type", "ts", _now())


def notice_family(spark: SparkSession, d: str) -> DataFrame:
    """Event types by family: the result family is tested before the tender family."""
    families = [("outcome", ["purchase", "refund"]), ("visit", ["view", "click", "u"])]
    rows = table(spark, d, "events").select(F.coalesce(feeds.family(F.col("event_type"), families), F.col("event_type")).alias("family"))
    return rows.groupBy("family").agg(F.count("*").alias("n"))


def top_users(spark: SparkSession, d: str) -> DataFrame:
    return feeds.top_groups(table(spark, d, "events").withColumn("user", F.col("user_id").cast("string")), "user", 10)


def paged_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return tables.page(rows.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20, 40)


def messages_per_session(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return feeds.children_count(rows.select("conv_id").distinct(), rows.filter("role = 'system'"), "conv_id")


def latest_order(spark: SparkSession, d: str) -> DataFrame:
    return feeds.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return analyzer.profile(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_linenumber"))


def trend(spark: SparkSession, d: str) -> DataFrame:
    monthly = table(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return analyzer.trend(monthly, ["o_orderpriority"], "month", "total")


def distribution_outliers(spark: SparkSession, d: str) -> DataFrame:
    return analyzer.distribution(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice")


def comparison_share(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return analyzer.comparison(lines, "p_brand", "l_extendedprice")


def chart_series(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return analyzer.chart(daily, "line", "day", "n", "event_type").select("series", F.length("payload").cast("long").alias("size"))


def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])


def evaluator_p95(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.answer_latency(table(spark, d, "events"), ["event_type"], "value")


def load_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("value is not null").select((F.col("event_type") != "error").alias("ok"), (F.col("value") > 50).alias("good"), F.col("value").alias("latency"))
    return evaluation.load_summary(rows, F.lit(3600.0)).withColumns({c: F.round(c, 6) for c in ("throughput", "mean")})


def pass_rate_by_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("passed"))
    return evaluation.pass_rates(rows, ["source"])


def sql_row_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    e = evidence.from_rows(rows, "nation").unionByName(evidence.from_rows(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "customer"))
    return e.select("evidence_id", "content", "content_hash", F.col("locator.row_id").alias("row_id"), F.col("locator.table_name").alias("table_name"))


def _document_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(
        F.concat(F.lit("doc "), "doc_id").alias("document_name"), F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7).alias("chunk_index"),
        F.lit(None).cast("int").alias("page"), F.col("source").alias("kb_name"), F.when(F.col("lang") == "en", "IEEE").otherwise("").alias("publisher"), F.col("text").alias("content"),
    )
    return evidence.from_chunks(rows)


def evidence_validate(spark: SparkSession, d: str) -> DataFrame:
    return evidence.issues(_document_evidence(spark, d)).select("evidence_id", "quality_tier", F.array_join("issues", ",").alias("issues"))


def evidence_validity(spark: SparkSession, d: str) -> DataFrame:
    return evidence.validity(_document_evidence(spark, d))


def evidence_citation(spark: SparkSession, d: str) -> DataFrame:
    return evidence.citation(_document_evidence(spark, d)).select("evidence_id", "anchor")


def _order_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders as evidence whose content states the customer's amount in words with a unit."""
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    content = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma", "delta")]), (F.col("o_custkey") % 4 + 1).cast("int")), F.lit(" revenue "), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("元"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("evidence_id"), F.concat(F.lit("order "), "o_orderkey").alias("title"), F.lit("sql_row").alias("source_kind"), content.alias("content"),
        day.alias("published_at"), day.alias("as_of"), F.lit(None).cast("string").alias("retrieved_at"),
    )


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def critic_freshness(spark: SparkSession, d: str) -> DataFrame:
    return critic.freshness(_order_evidence(spark, d), F.lit("1998-08-01 00:00:00")).select("subject", F.get("evidence_ids", 0).alias("evidence_id"), F.col("detail").cast("long").alias("days"))


def critic_conflict(spark: SparkSession, d: str) -> DataFrame:
    return critic.conflicts(_order_evidence(spark, d)).select("subject", F.size("evidence_ids").cast("long").alias("rows"), F.col("detail").cast("double").alias("spread"))


def critic_time_anchor(spark: SparkSession, d: str) -> DataFrame:
    found = critic.time_anchor(_order_evidence(spark, d))
    return found.groupBy("subject").agg(F.count("*").alias("rows"), F.max(F.col("detail").cast("long")).alias("most"))


def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents without a French document, or without one in German or Spanish."""
    docs = table(spark, d, "documents").select(F.concat_ws(":", "source", (F.col("doc_id") % 40).cast("string")).alias("case_id"), F.col("lang").alias("source_kind"))
    cases = docs.select("case_id").distinct().select("case_id", F.explode(F.array(F.array(F.lit("fr")), F.array(F.lit("de"), F.lit("es")))).alias("kinds"))
    return critic.missing_sources(cases, docs).select("subject", "detail", "severity")


def cross_source_inference(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every tenth word run that cite two sources: marks are made from the documents' ids."""
    drafts = table(spark, d, "documents").select(F.col("doc_id").alias("draft_id"), F.concat(F.lit("A [[E1]] and [[E"), (F.col("doc_id") % 3).cast("string"), F.lit("]] agree. B [[E1]] is alone.")).alias("text"))
    found = critic.cross_source_inference(drafts)
    return found.select(F.col("detail").cast("long").alias("draft_id"), F.array_join("evidence_ids", ",").alias("ids"))


def entity_resolver(spark: SparkSession, d: str) -> DataFrame:
    """The longest word pair of benchmark passages' openings that occurs anywhere in each document, both in lower case with levelled spaces."""
    names = table(spark, d, "benchmark").select(F.array_join(F.slice(F.split(text.normalise_lower(F.col("text")), " "), 1, 2), " ").alias("name")).distinct()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return governance.longest_entity(docs, names, text.normalise_lower)


def source_dedup_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(
        "page_id", F.col("url").alias("source_url"), F.lit("").alias("doi"), F.lit(None).cast("string").alias("fulltext_url"), F.lit(None).cast("string").alias("external_id"),
        F.element_at(F.array(F.lit("official"), F.lit("media"), F.lit("academic")), (F.col("page_id") % 3 + 1).cast("int")).alias("authority_level"),
        F.when(F.col("page_id") % 2 == 0, "2024-01-01").alias("published_at"), F.lit(None).cast("string").alias("document_version"), F.lit("https://license").alias("license_url"),
        F.when(F.col("page_id") % 5 == 0, "fulltext_allowed").otherwise("metadata_only").alias("ingestion_policy"), F.lit("news").alias("claim_type"),
    )
    same_host = governance.with_quality(rows).withColumn("source_url", text.url_host(F.col("source_url")))
    return governance.dedupe_sources(same_host, "page_id").select("page_id", F.col("quality").cast("long").alias("quality"))


def lifecycle_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("bid_id"), F.col("text").alias("title"), F.col("source").alias("buyer"))
    return governance.lifecycle_clusters(rows)


def repeated_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), F.col("text").alias("content"), F.col("source").alias("url"))
    return governance.repeated_facts(rows).select("fact_id", "fingerprint", "repeated")


def full_outer_reconcile(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 7 + 1).alias("n"))
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n"))
    return governance.reconcile(o, l, "key")


def new_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last week with a user, type and hour that no earlier event had."""
    e = table(spark, d, "events").select("event_id", "ts", F.concat_ws(":", "user_id", "event_type", F.hour("ts")).alias("user_type"), "props")
    cut = F.lit("2024-01-23").cast("timestamp_ntz")
    return governance.new_rows(e.filter(F.col("ts") >= cut), e.filter(F.col("ts") < cut), ["user_type"], "event_id").select("event_id", "user_type")


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.rate_limit(e, 1, 86400.0).select("event_id", "key", "accepted")


def task_states(spark: SparkSession, d: str) -> DataFrame:
    steps = F.element_at(F.array(*[F.lit(x) for x in ("start", "failure", "start", "success", "cancel")]), (F.col("event_id") % 5 + 1).cast("int"))
    return streams.task_states(table(spark, d, "events").select(F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), steps.alias("event")))


def outbox_claim(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "dispatching").otherwise("published").alias("status"), F.col("ts").alias("available_at"), (F.col("ts") + F.expr("interval 1 day")).alias("locked_until"))
    return feeds.claimable(rows, F.lit("2024-01-15").cast("timestamp_ntz")).select("id", "status")


def metric_histogram(spark: SparkSession, d: str) -> DataFrame:
    return feeds.histogram(table(spark, d, "events"), "event_type", "value", [1, 5, 10, 50, 100]).filter("le < 1000")


def enqueue_once(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat_ws("-", "user_id", "event_type").alias("task_id"), "ts", F.col("event_id").alias("payload"))
    return streams.enqueue_once(e).select("task_id", "payload")


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.tumbling_counts(table(spark, d, "events"), "event_type", "value")


def tumbling_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same counts from a stream of the table in complete mode: equal to the table's."""
    stream = streams.read_events(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    return streams.complete_table(streams.tumbling_counts(stream, "event_type", "value"), tables.scratch(spark, "tumbling"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id")


_ALLOWED = {"customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"], "region": ["r_regionkey", "r_name"]}
_STAR = """SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c_mktsegment <> 'x' GROUP BY n_name, c_mktsegment LIMIT 1000"""


def guarded_star_join(spark: SparkSession, d: str) -> DataFrame:
    for t in _ALLOWED:
        table(spark, d, t).createOrReplaceTempView(t)
    return sqlguard.query(spark, _STAR, _ALLOWED)


def guarded_union(spark: SparkSession, d: str) -> DataFrame:
    for t in _ALLOWED:
        table(spark, d, t).createOrReplaceTempView(t)
    return sqlguard.query(spark, _UNION, _ALLOWED)


_UNION = "WITH a AS (SELECT n_name AS name FROM nation WHERE n_regionkey = 1) SELECT name, 'nation' AS kind FROM a UNION ALL SELECT r_name, 'region' FROM region"


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    buyers = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("buyers"))
    others = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("others"))
    return buyers.join(others, "c_mktsegment", "full_outer")


def table_listing(spark: SparkSession, d: str) -> DataFrame:
    names = ["region", "nation", "customer", "orders"]
    for t in names:
        table(spark, d, t).createOrReplaceTempView(t)
    return tables.describe(spark, names).select("name", F.col("columns").cast("long").alias("columns"), "rows")


QUERIES = {f.__name__: f for f in (
    news_stats, notice_family, top_users, paged_list, messages_per_session, latest_order, profile_columns, trend, distribution_outliers, comparison_share, chart_series, nearest_rank_percentiles,
    evaluator_p95, load_summary, pass_rate_by_label, sql_row_evidence, evidence_validate, evidence_validity, evidence_citation, critic_freshness, critic_conflict, critic_time_anchor, missing_sources,
    cross_source_inference, entity_resolver, source_dedup_quality, lifecycle_clusters, repeated_facts, full_outer_reconcile, new_events, rate_limit, task_states, outbox_claim, metric_histogram,
    enqueue_once, tumbling_counts, tumbling_stream, event_sessions, guarded_star_join, guarded_union, semi_anti, table_listing,
)}

_EV = f"""o AS (SELECT o_orderkey::VARCHAR AS evidence_id, 'order ' || o_orderkey AS title, ['alpha','beta','gamma','delta'][o_custkey % 4 + 1] AS metric, floor(o_totalprice / 1000) AS v, {_DAY} AS day FROM orders)"""
_DOC_EV = """e AS (SELECT CASE WHEN lang = 'en' THEN 'IEEE' ELSE source END AS publisher, 'doc ' || doc_id AS title, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 END AS idx, sha256(text) AS h, lang, text FROM documents),
ev AS (SELECT substr(sha256('document|' || publisher || '|' || title || '|' || h), 1, 24) AS evidence_id, * FROM e)"""
_TUMBLE = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

ORACLES = {
    "news_stats": f"SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS recent FROM events WHERE event_type <> '' GROUP BY event_type",
    "notice_family": """SELECT CASE WHEN event_type LIKE '%purchase%' OR event_type LIKE '%refund%' THEN 'outcome' WHEN event_type LIKE '%view%' OR event_type LIKE '%click%' OR event_type LIKE '%u%' THEN 'visit' ELSE event_type END AS family,
        count(*) AS n FROM events GROUP BY 1""",
    "top_users": 'SELECT user_id::VARCHAR AS "user", count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10',
    "paged_list": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "messages_per_session": "SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS n FROM conversations GROUP BY conv_id",
    "latest_order": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "profile_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, min({v})::DOUBLE AS least, max({v})::DOUBLE AS most, round(sum({v}), 4)::DOUBLE AS total, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS deviation FROM lineitem"
        for c, v in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_returnflag", "NULL::DOUBLE"), ("l_linenumber", "l_linenumber"))
    ),
    "trend": """WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2),
        g AS (SELECT *, lag(total) OVER (PARTITION BY o_orderpriority ORDER BY month) AS before FROM m),
        a AS (SELECT o_orderpriority, count(*) AS points, min_by(total, month) AS f, max_by(total, month) AS l, avg(CASE WHEN before <> 0 THEN (total - before) / before * 100 END) AS g FROM g GROUP BY 1)
        SELECT o_orderpriority, points, round(f, 2) AS first, round(l, 2) AS last, round(l - f, 2) AS change, round((l - f) / f * 100, 4) AS change_percent, round(g, 4) AS mean_growth FROM a""",
    "distribution_outliers": """WITH s AS (SELECT o_orderstatus, count(o_totalprice) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most, avg(o_totalprice) AS mean, sum(o_totalprice) AS total, median(o_totalprice) AS median, stddev_samp(o_totalprice) AS deviation FROM orders GROUP BY 1),
        x AS (SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > mean + 2 * deviation) AS outliers FROM orders JOIN s USING (o_orderstatus) GROUP BY 1)
        SELECT o_orderstatus, n, least, most, round(mean, 4) AS mean, round(total, 2) AS total, round(median, 4) AS median, round(deviation, 4) AS deviation, outliers FROM s JOIN x USING (o_orderstatus)""",
    "comparison_share": """WITH t AS (SELECT p_brand, sum(l_extendedprice) AS total, avg(l_extendedprice) AS mean, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT p_brand, round(total, 2) AS total, round(mean, 4) AS mean, n, round(total / sum(total) OVER (), 6) AS share, row_number() OVER (ORDER BY total DESC, p_brand) AS place, CASE WHEN count(*) OVER () <= 6 THEN 'pie' ELSE 'bar' END AS chart FROM t""",
    "nearest_rank_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL)
        SELECT event_type, q::DOUBLE AS q, value FROM r, (VALUES (0.5), (0.95), (0.99)) t(q) WHERE r = greatest(1, ceil(q::DOUBLE * c))""",
    "evaluator_p95": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value NULLS FIRST) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events)
        SELECT event_type, count(*) AS n, max(value) FILTER (WHERE r = (c - 1) // 2) AS p50, max(value) FILTER (WHERE r = greatest(0, floor(c * 0.95 + 0.999) - 1)) AS p95 FROM r GROUP BY 1""",
    "load_summary": """WITH r AS (SELECT event_type <> 'error' AS ok, value > 50 AS good, value AS latency FROM events WHERE value IS NOT NULL)
        SELECT count(*) AS n, round(avg((NOT ok)::INT), 9) AS error_rate, round(avg(good::INT), 9) AS quality_rate, round(count(*) / 3600.0, 6)::DOUBLE AS throughput, round(avg(latency), 6) AS mean,
               quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99 FROM r""",
    "pass_rate_by_label": "SELECT source, count(*) AS cases, count(*) FILTER (WHERE quality = 1) AS passed, round(avg((quality = 1)::INT), 9) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "sql_row_evidence": """WITH r AS (
        SELECT 'nation' AS t, 'n_nationkey=' || n_nationkey || '; n_name=' || n_name || '; n_regionkey=' || n_regionkey AS c, 'n_name=' || n_name || '|n_nationkey=' || n_nationkey || '|n_regionkey=' || n_regionkey AS k FROM nation
        UNION ALL SELECT 'customer', 'c_custkey=' || c_custkey || '; c_name=' || c_name || '; c_nationkey=' || c_nationkey, 'c_custkey=' || c_custkey || '|c_name=' || c_name || '|c_nationkey=' || c_nationkey FROM customer)
        SELECT substr(sha256('sql_row|database|' || t || '|' || sha256(c)), 1, 24) AS evidence_id, c AS content, sha256(c) AS content_hash, substr(sha256(k), 1, 16) AS row_id, t AS table_name FROM r""",
    "evidence_validate": f"WITH {_DOC_EV} SELECT evidence_id, CASE WHEN publisher = 'IEEE' THEN 'official' ELSE 'primary' END AS quality_tier, concat_ws(',', CASE WHEN trim(text) = '' THEN 'content_empty' END, CASE WHEN idx IS NULL THEN 'document_place_missing' END) AS issues FROM ev",
    "evidence_validity": f"WITH {_DOC_EV} SELECT 'document' AS source_kind, count(*) AS n, count(*) FILTER (WHERE idx IS NOT NULL AND trim(text) <> '') AS valid FROM ev",
    "evidence_citation": f"WITH {_DOC_EV} SELECT evidence_id, CASE WHEN idx IS NULL THEN title ELSE 'chunk ' || idx END AS anchor FROM ev",
    "critic_freshness": f"WITH {_EV} SELECT title AS subject, evidence_id, date_diff('day', day::DATE, DATE '1998-08-01') AS days FROM o WHERE date_diff('day', day::DATE, DATE '1998-08-01') > 730",
    "critic_conflict": f"WITH {_EV} SELECT 'revenue' AS subject, count(*) AS rows, round((max(v) - min(v)) / max(v), 6)::DOUBLE AS spread FROM o HAVING count(*) >= 2 AND (max(v) - min(v)) / max(v) > 0.2",
    "critic_time_anchor": f"""WITH {_EV}, m AS (SELECT unnest(['revenue', metric]) AS metric, day::DATE AS day FROM o), l AS (SELECT *, max(day) OVER (PARTITION BY metric) AS last FROM m)
        SELECT metric AS subject, count(*) AS rows, max(date_diff('day', day, last)) AS most FROM l WHERE date_diff('day', day, last) > 90 GROUP BY 1""",
    "missing_sources": """WITH d AS (SELECT source || ':' || doc_id % 40 AS case_id, lang FROM documents), g AS (SELECT case_id, bool_or(lang = 'fr') AS fr, bool_or(lang IN ('de', 'es')) AS x FROM d GROUP BY 1)
        SELECT case_id AS subject, 'fr' AS detail, 'block' AS severity FROM g WHERE NOT fr UNION ALL SELECT case_id, 'de|es', 'block' FROM g WHERE NOT x""",
    "cross_source_inference": "SELECT doc_id AS draft_id, array_to_string(list_sort(['E1', 'E' || doc_id % 3]), ',') AS ids FROM documents WHERE doc_id % 3 <> 1",
    "entity_resolver": r"""WITH n AS (SELECT DISTINCT array_to_string(list_slice(string_split(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), ' '), 1, 2), ' ') AS name FROM benchmark),
        t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents)
        SELECT doc_id AS text_id, name AS entity FROM t JOIN n ON contains(t, name) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) = 1""",
    "source_dedup_quality": r"""WITH q AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
          least(100, [30, 8, 24][page_id % 3 + 1] + CASE WHEN page_id % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 25 ELSE 5 END + CASE WHEN url LIKE 'https://%' THEN 5 ELSE 0 END)::BIGINT AS quality FROM pages)
        SELECT page_id, quality FROM q QUALIFY row_number() OVER (PARTITION BY host ORDER BY quality DESC, page_id) = 1""",
    "repeated_facts": r"""WITH f AS (SELECT doc_id AS fact_id, source AS url, substr(md5(array_to_string(list_slice(regexp_extract_all(text, '\d+\.?\d*'), 1, 3), '_') || '|' ||
          array_to_string(list_slice(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,4}'), 1, 5), '_')), 1, 16) AS fingerprint FROM documents)
        SELECT fact_id, fingerprint, url <> first_value(url) OVER (PARTITION BY fingerprint ORDER BY fact_id) AS repeated FROM f""",
    "full_outer_reconcile": """WITH o AS (SELECT o_orderkey AS key, o_orderkey % 7 + 1 AS n FROM orders), l AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT key, o.n AS left_n, l.n AS right_n, CASE WHEN o.n IS NULL THEN 'missing_left' WHEN l.n IS NULL THEN 'missing_right' ELSE 'count_differs' END AS issue
        FROM o FULL JOIN l USING (key) WHERE o.n IS DISTINCT FROM l.n""",
    "new_events": """WITH e AS (SELECT event_id, ts, user_id || ':' || event_type || ':' || hour(ts) AS user_type, props FROM events), n AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-23'), k AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-23'),
        a AS (SELECT * FROM n WHERE user_type NOT IN (SELECT user_type FROM k) QUALIFY row_number() OVER (PARTITION BY user_type ORDER BY event_id) = 1)
        SELECT event_id, user_type FROM a""",
    "outbox_claim": """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'pending' ELSE 'dispatching' END AS status FROM events
        WHERE (event_id % 3 = 0 AND ts <= TIMESTAMP '2024-01-15') OR (event_id % 3 = 1 AND ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15') ORDER BY ts, event_id LIMIT 20""",
    "metric_histogram": "SELECT event_type, le::DOUBLE AS le, count(*) FILTER (WHERE value <= le) AS n FROM events, (VALUES (1), (5), (10), (50), (100)) t(le) GROUP BY ALL",
    "enqueue_once": "SELECT user_id || '-' || event_type AS task_id, event_id AS payload FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "tumbling_counts": _TUMBLE,
    "tumbling_stream": _TUMBLE,
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
    "guarded_star_join": _STAR,
    "guarded_union": _UNION,
    "semi_anti": """SELECT c_mktsegment, nullif(count(*) FILTER (WHERE b), 0) AS buyers, nullif(count(*) FILTER (WHERE NOT b), 0) AS others FROM (SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS b FROM customer) GROUP BY 1""",
    "table_listing": "SELECT 'region' AS name, 2::BIGINT AS columns, count(*) AS rows FROM region UNION ALL SELECT 'nation', 3, count(*) FROM nation UNION ALL SELECT 'customer', 5, count(*) FROM customer UNION ALL SELECT 'orders', 6, count(*) FROM orders",
}
