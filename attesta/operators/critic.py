"""Deterministic consistency checks over evidence; each gives findings (check_name, severity, subject, evidence_ids, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import settle

# fixed values
SCALES = {"万": 1, "万元": 1, "百万元": 3, "千万元": 3, "亿元": 5, "千亿元": 7, "万亿元": 9, "%": 0, "个百分点": 0, "个": 0, "件": 0, "人": 0, "台": 0, "套": 0, "元": 0}
CHECKS = ["freshness", "unit_mismatch", "time_anchor", "conflict", "missing_source", "cross_source_inference"]
STALE_DAYS, ANCHOR_DAYS, TOLERANCE = 730, 90, 0.20


def _finding(df: DataFrame, check: str, severity: str, subject, ids, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), subject.alias("subject"), ids.alias("evidence_ids"), detail.cast("string").alias("detail"))


def evidence_time() -> Column:
    """The first of published_at, as_of and retrieved_at that can be read."""
    return F.coalesce(*[text.parse_iso(F.col(c)) for c in ("published_at", "as_of", "retrieved_at")])


def freshness(e: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Evidence older than ``days`` at ``now``; one finding on its own if no row has a time."""
    dated = e.withColumn("t", evidence_time())
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("t")) / 86400
    old = _finding(dated.filter(age > days), "freshness", "warn", F.col("title"), F.array("evidence_id"), F.floor(age))
    none = dated.agg(F.count("*").alias("n"), F.count("t").alias("k")).filter("n > 0 and k = 0")
    return old.unionByName(_finding(none, "freshness", "warn", F.lit("no timestamps"), F.array().cast("array<string>"), F.col("n")))


def _numbers(e: DataFrame) -> DataFrame:
    """(evidence_id, bucket, value, unit) of every number with a unit."""
    rows = e.select("evidence_id", "content", F.explode(text.numeric_units(F.col("content"))).alias("x"))
    return rows.select("evidence_id", text.bucket_key(F.col("content"), F.col("x.raw")).alias("bucket"), "x.value", "x.unit").filter("bucket != ''")


def _ids() -> Column:
    return F.sort_array(F.collect_set("evidence_id"))


def unit_mismatch(e: DataFrame) -> DataFrame:
    """Buckets whose numbers' scales are four steps apart or more."""
    scale = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])[F.col("unit")]
    met = _numbers(e).withColumn("scale", scale).filter("scale is not null").groupBy("bucket").agg(F.min("scale").alias("a"), F.max("scale").alias("b"), _ids().alias("ids"))
    return _finding(met.filter("b - a >= 4"), "unit_mismatch", "warn", F.col("bucket"), F.col("ids"), F.concat_ws("..", "a", "b"))


def time_anchor(e: DataFrame, days: int = ANCHOR_DAYS) -> DataFrame:
    """Rows of a metric more than ``days`` whole days before the metric's latest row."""
    at = F.coalesce(text.parse_iso(F.coalesce(F.nullif("as_of", F.lit("")), F.col("published_at"))))
    rows = e.withColumn("t", at).filter("t is not null").select("evidence_id", "t", F.explode(text.metric_tokens(F.col("content"))).alias("metric"))
    last = settle(rows.groupBy("metric").agg(F.max(F.struct("t", "evidence_id")).alias("last")), "newest")
    met = rows.join(last, "metric").withColumn("gap", F.floor((F.unix_timestamp("last.t") - F.unix_timestamp("t")) / 86400)).filter(F.col("gap") > days)
    return _finding(met, "time_anchor", "warn", F.col("metric"), F.sort_array(F.array_distinct(F.array("last.evidence_id", "evidence_id"))), F.col("gap"))


def conflicts(e: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Buckets whose values of one unit differ by more than the tolerance of the largest."""
    met = _numbers(e).groupBy("bucket", "unit").agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"), _ids().alias("ids"))
    spread = (F.col("b") - F.col("a")) / F.col("b")
    return _finding(met.filter((F.col("n") >= 2) & (F.col("b") > 0) & (spread > tolerance)), "conflict", "warn", F.col("bucket"), F.col("ids"), F.round(spread, 6))


def missing_sources(cases: DataFrame, e: DataFrame) -> DataFrame:
    """Requirements (case_id, kinds: any of them) that no evidence (case_id, source_kind) of the case meets; they block."""
    need = cases.select("case_id", "kinds", F.explode("kinds").alias("source_kind"))
    met = need.join(e.select("case_id", "source_kind").distinct(), ["case_id", "source_kind"], "left_semi").select("case_id", "kinds").distinct()
    lost = cases.select("case_id", "kinds").distinct().join(met, ["case_id", "kinds"], "left_anti")
    return _finding(lost, "missing_source", "block", F.col("case_id").cast("string"), F.array().cast("array<string>"), F.array_join("kinds", "|"))


def cross_source_inference(drafts: DataFrame) -> DataFrame:
    """Sentences of drafts (draft_id, text) that cite two different sources or more."""
    s = drafts.select("draft_id", F.explode(text.sentences(F.col("text"))).alias("s")).withColumn("ids", F.array_sort(F.array_distinct(text.citation_markers(F.col("s")))))
    return _finding(s.filter(F.size("ids") >= 2), "cross_source_inference", "info", F.col("s"), F.col("ids"), F.col("draft_id"))


def report(findings: DataFrame) -> DataFrame:
    """(check_name, severity, n, ordinal) in the checks' fixed order."""
    place = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check_name"))
    return findings.groupBy("check_name", "severity").agg(F.count("*").alias("n")).withColumn("ordinal", place)


def should_refuse(findings: DataFrame, required: tuple[str, ...] = (), sources: DataFrame | None = None) -> DataFrame:
    """(blocks, warns, infos, missing, should_refuse): one row; ``missing`` are the required kinds that no row of ``sources`` (source_kind) has."""
    n = lambda severity: F.count_if(F.col("severity") == severity)
    counts = findings.agg(n("block").alias("blocks"), n("warn").alias("warns"), n("info").alias("infos"))
    wanted = F.array(*map(F.lit, required)).cast("array<string>")
    if sources is None:
        out = counts.withColumn("missing", wanted)
    else:
        held = sources.filter(F.col("source_kind").isin(*required)).agg(F.collect_set("source_kind").alias("held"))
        out = counts.join(F.broadcast(held)).withColumn("missing", F.array_except(wanted, F.col("held"))).drop("held")  # one row each
    return out.withColumn("should_refuse", (F.col("blocks") > 0) | (F.size("missing") > 0))


def normalise_review(reviews: DataFrame) -> DataFrame:
    """Caps a review's score by its worst issue and its verdict by its score (severities: array)."""
    score = F.when(F.array_contains("severities", "critical"), F.least("score", F.lit(4.0))).when(F.array_contains("severities", "major"), F.least("score", F.lit(6.0))).otherwise(F.col("score"))
    return reviews.withColumn("score", score).withColumn("verdict", F.when((F.col("score") < 7) & (F.col("verdict") == "pass"), "needs_revision").otherwise(F.col("verdict")))


# fixed values: tools by words of the question
TOOLS = [
    ("news_search", ["政策", "国务院", "工信部", "产业化进展", "技术进展"]), ("bidding_search", ["招投标", "招标", "中标", "采购", "采购预算"]),
    ("text2sql", ["营收", "净利润", "毛利率", "财务", "业绩", "出货量", "估值"]), ("stock_query", ["股价", "行情", "估值"]),
]
LIMITS = {"knowledge_search": 2, "news_search": 2, "bidding_search": 2, "text2sql": 4, "stock_query": 1}


def plan_tools(question: Column, tools: list = TOOLS) -> Column:
    """Knowledge search, then every tool one of whose words the question has."""
    chosen = [F.lit("knowledge_search")]
    for name, words in tools:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(question, F.lit(w))
        chosen.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*chosen), lambda t: t.isNotNull())


def retrieve_by_tool(questions: DataFrame, sources: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """(question_id, tool, source_id, score, rank) of each planned tool's best sources with a score above 0.

    ``sources``: source_id, channel, haystack, source_kind. Questions meet only sources of a planned channel that share
    a term. A question about policy takes policies alone from the news, if there are any.
    """
    asks = questions.select("question_id", "question", F.explode(plan_tools(F.col("question"))).alias("tool"))
    q = asks.select("question_id", "question", "tool", F.explode(text.source_terms(F.col("question"))).alias("term"))
    s = sources.select("source_id", F.col("channel").alias("tool"), F.explode(text.source_terms(F.col("haystack"))).alias("term"))
    met = q.join(s, ["tool", "term"]).select("question_id", "question", "tool", "source_id").distinct().join(sources.select("source_id", "haystack"), "source_id")
    policies = sources.filter((F.col("channel") == "news_search") & (F.col("source_kind") == "policy")).select("source_id").distinct()
    about = (F.col("tool") == "news_search") & F.contains("question", F.lit("政策"))
    if policies.limit(1).count():
        met = met.join(policies.withColumn("policy", F.lit(True)), "source_id", "left").filter(~about | F.coalesce("policy", F.lit(False))).drop("policy")
    scored = met.withColumn("score", F.round(text.source_score(F.col("question"), F.col("haystack")), 9)).filter("score > 0")
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("tool")]
    w = Window.partitionBy("question_id", "tool").orderBy(F.desc("score"), "source_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most).select("question_id", "tool", "source_id", "score", "rank")


# fixed values
SEARCHABLE = ["missing_source", "incomplete", "outdated"]
SEVERE = ["critical", "major"]
INFERENCE = ["分析", "是否", "差距", "趋势", "一致", "反映", "受益"]
CONFLICT = ["是否一致", "趋势", "支持力度", "估值"]
RISK = ["股价", "估值"]
METRICS = [("单台成本", "单台成本"), ("价差百分比", "价差"), ("出货量", "出货量")]


def route_review(issues: DataFrame, missing: DataFrame, most: int = 5) -> DataFrame:
    """(review_id, should_research, search_queries) of reviews with an issue or a missing aspect.

    ``issues``: review_id, n, issue_type, severity, requires_new_search, search_query; ``missing``: review_id, n, aspect. Severe
    issues that a search can mend and the first three missing aspects give the queries, each once, in their order. It
    is researched if there is a query and over 30 % of the severe issues can be mended so.
    """
    severe = F.col("severity").isin(SEVERE)
    mends = severe & F.col("issue_type").isin(SEARCHABLE)
    query = F.when(mends & F.col("requires_new_search") & (F.col("search_query") != ""), F.struct(F.lit(0).alias("k"), "n", F.col("search_query").alias("q")))
    a = issues.groupBy("review_id").agg(F.count_if(severe).alias("severe"), F.count_if(mends).alias("mends"), F.collect_list(query).alias("asked"))
    first = missing.withColumn("r", F.row_number().over(Window.partitionBy("review_id").orderBy("n"))).filter("r <= 3")
    b = first.groupBy("review_id").agg(F.collect_list(F.struct(F.lit(1).alias("k"), "n", F.col("aspect").alias("q"))).alias("lost"))
    both = a.join(b, "review_id", "full_outer")
    none = F.array().cast("array<struct<k:int,n:bigint,q:string>>")
    every = F.concat(F.coalesce(F.col("asked").cast("array<struct<k:int,n:bigint,q:string>>"), none), F.coalesce(F.col("lost").cast("array<struct<k:int,n:bigint,q:string>>"), none))
    queries = F.slice(F.array_distinct(F.transform(F.array_sort(every), lambda x: x["q"])), 1, most)
    mended, heavy = F.coalesce("mends", F.lit(0)), F.coalesce("severe", F.lit(0))
    go = (F.size(queries) > 0) & ((mended > 0) | F.col("lost").isNotNull()) & ((heavy == 0) | (mended / F.greatest(heavy, F.lit(1)) > 0.3))
    return both.select("review_id", go.alias("should_research"), queries.alias("search_queries"))


def graph_nodes(entities: DataFrame) -> DataFrame:
    """(name, type, n): each named entity (n, name, type, relations) once, as it is first met."""
    own = entities.filter(text.blank(F.col("name")) != "")
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("n"))).filter("_r = 1").drop("_r").select("name", F.coalesce("type", F.lit("unknown")).alias("type"), "n", "relations")


def graph_edges(entities: DataFrame) -> DataFrame:
    """(source, relation) of every node's relations, as it is first met."""
    return graph_nodes(entities).select(F.col("name").alias("source"), F.explode("relations").alias("relation"))


def _asks(question: Column, words: list[str]) -> Column:
    return text.blank(question).rlike("|".join(words))


def answer_labels(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question_id, refused, inference, conflict, risk): what an answer has to say of itself.

    ``questions``: question_id, question; ``retrieved``: question_id, content. Refused: nothing was retrieved, or the
    question asks for a figure of which the contents do not speak. A refusal needs no other label.
    """
    corpus = retrieved.groupBy("question_id").agg(F.concat_ws(" ", F.collect_list(text.blank(F.col("content")))).alias("corpus"))
    lacks = F.lit(False)
    for asked, wanted in METRICS:
        lacks = lacks | (F.contains("question", F.lit(asked)) & ~F.contains("corpus", F.lit(wanted)))
    met = questions.join(corpus, "question_id", "left").withColumn("refused", F.col("corpus").isNull() | lacks)
    label = lambda words: (~F.col("refused") & _asks(F.col("question"), words))
    return met.select("question_id", "refused", label(INFERENCE).alias("inference"), label(CONFLICT).alias("conflict"), label(RISK).alias("risk"))
