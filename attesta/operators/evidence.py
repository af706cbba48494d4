"""Evidence rows: adapters from documents, news, notices, SQL rows and quotes; validation; citation locators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# fixed values
KINDS = ["document", "news", "policy", "bidding", "sql_row", "market_quote", "web_search"]
TIERS = ["official", "primary", "secondary", "unknown"]
STANDARD_BODIES = ["IEEE", "JEDEC", "NIST", "ISO", "IEC", "SEMI"]
GOVERNMENT = ["国务院", "工信部", "发改委", "科技部", "财政部", "住建部", "公安部", "交通运输部", "自然资源部", "工业和信息化部", "国家发展改革委", "交通运输厅", "政府", "部委", "中共中央"]
LOCATOR = [
    ("page", "int"), ("chunk_index", "int"), ("doc_id", "string"), ("kb_name", "string"), ("news_id", "string"), ("notice_id", "string"), ("notice_type", "string"),
    ("province", "string"), ("city", "string"), ("row_id", "string"), ("table_name", "string"), ("columns", "array<string>"), ("sql_hash", "string"),
    ("stock_code", "string"), ("data_provider", "string"), ("data_type", "string"), ("search_engine", "string"),
]


def locator(**values: Column) -> Column:
    return F.struct(*[(values[n].cast(t) if n in values else F.lit(None).cast(t)).alias(n) for n, t in LOCATOR])


def evidence_id(kind: Column, publisher: Column, title: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", text.blank(kind), text.blank(publisher), text.blank(title), F.sha2(text.blank(content), 256)), 256), 1, 24)


def _any(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text.blank(c), F.lit(w))
    return hit


def make(rows: DataFrame, kind: Column, title: Column, publisher: Column, content: Column, tier: Column, where: Column, **more: Column) -> DataFrame:
    """Evidence of any kind; ``more``: url, published_at, retrieved_at, as_of, license_or_terms."""
    optional = [(more.get(n, F.lit(None)).cast("string")).alias(n) for n in ("url", "published_at", "retrieved_at", "as_of", "license_or_terms")]
    return rows.select(
        evidence_id(kind, publisher, title, content).alias("evidence_id"), kind.alias("source_kind"), text.blank(title).alias("title"), text.blank(publisher).alias("publisher"),
        *optional, where.alias("locator"), text.blank(content).alias("content"), F.sha2(text.blank(content), 256).alias("content_hash"), tier.alias("quality_tier"),
    )


def from_chunks(rows: DataFrame) -> DataFrame:
    """Chunks (document_name, doc_id, chunk_index, page, kb_name, publisher, content); standards bodies are official."""
    publisher = F.coalesce(F.nullif("publisher", F.lit("")), F.nullif("kb_name", F.lit("")), F.lit("unknown"))
    tier = F.when(_any(publisher, STANDARD_BODIES), "official").otherwise("primary")
    where = locator(page=F.col("page"), chunk_index=F.col("chunk_index"), doc_id=F.col("doc_id"), kb_name=F.col("kb_name"))
    return make(rows, F.lit("document"), F.col("document_name"), publisher, F.col("content"), tier, where)


def from_news(rows: DataFrame) -> DataFrame:
    """News (id, title, content, source, source_url, category, department, publish_time, collected_at)."""
    kind = F.when(F.col("category").isin("政策", "纪要"), "policy").otherwise("news")
    publisher = F.coalesce(F.nullif("department", F.lit("")), F.nullif("source", F.lit("")), F.lit("unknown"))
    tier = F.when(F.col("category") == "政策", "official").when(_any(publisher, GOVERNMENT), "official").when(F.col("category") == "研报", "secondary").otherwise("unknown")
    return make(rows, kind, F.col("title"), publisher, F.coalesce("content", "title"), tier, locator(news_id=F.col("id")), url=F.col("source_url"), published_at=F.col("publish_time"), retrieved_at=F.col("collected_at"))


def from_notices(rows: DataFrame) -> DataFrame:
    """Notices (bid_id, title, notice_type, province, city, content, publish_time, source, collected_at); always primary."""
    where = locator(notice_id=F.col("bid_id"), notice_type=F.col("notice_type"), province=F.col("province"), city=F.col("city"))
    return make(rows, F.lit("bidding"), F.col("title"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")), F.coalesce("content", "title"), F.lit("primary"), where, published_at=F.col("publish_time"), retrieved_at=F.col("collected_at"))


def from_rows(rows: DataFrame, table: str, title: Column | None = None, publisher: Column | None = None) -> DataFrame:
    """Rows of a table: content ``column=value; …`` of columns that are not null, in the table's order.

    The row id is 16 digits of the SHA-256 of the pairs in order of column name, joined by a pipe.
    """
    pair = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    names = rows.columns
    row_id = F.substring(F.sha2(F.concat_ws("|", *[pair(c) for c in sorted(names)]), 256), 1, 16)
    when = [c for c in names if any(w in c.lower() for w in ("year", "quarter", "month", "period", "date", "as_of"))]
    as_of = F.nullif(F.concat_ws("; ", *[pair(c) for c in when]), F.lit("")) if when else F.lit(None)
    where = locator(row_id=row_id, table_name=F.lit(table), columns=F.array(*map(F.lit, names)))
    return make(rows, F.lit("sql_row"), F.lit(table) if title is None else title, F.lit("database") if publisher is None else publisher, F.concat_ws("; ", *[pair(c) for c in names]), F.lit("primary"), where, as_of=as_of)


def from_quotes(rows: DataFrame) -> DataFrame:
    """Quotes (name, gid, nowPri, increPer, as_of, provider): of a third party, so secondary."""
    content = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in ("name", "nowPri", "increPer")])
    where = locator(stock_code=F.col("gid"), data_provider=F.col("provider"), data_type=F.lit("quote"))
    return make(rows, F.lit("market_quote"), F.col("name"), F.coalesce("provider", F.lit("unknown")), content, F.lit("secondary"), where, as_of=F.col("as_of"))


def from_data_points(rows: DataFrame, now: Column) -> DataFrame:
    """Market figures (name, value, unit, source) as of ``now``; a figure without name, value and unit is left out."""
    content = F.concat(text.blank(F.col("name")), F.lit(": "), text.blank(F.col("value").cast("string")), F.lit(" "), text.blank(F.col("unit")))
    own = rows.filter(F.concat_ws("", "name", F.col("value").cast("string"), "unit") != "")
    return make(own, F.lit("market_quote"), F.coalesce(F.nullif("name", F.lit("")), F.lit("market data")), F.coalesce("source", F.lit("unknown")), content, F.lit("secondary"), locator(data_type=F.lit("data_point")), as_of=now.cast("string"))


def from_web(rows: DataFrame, engine: str) -> DataFrame:
    """Web results (title, url, summary, snippet, site, date); nothing is known of their quality."""
    return make(
        rows, F.lit("web_search"), F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")), F.coalesce(F.nullif("site", F.lit("")), F.lit("unknown")),
        F.coalesce(F.nullif("summary", F.lit("")), F.col("snippet")), F.lit("unknown"), locator(search_engine=F.lit(engine)), url=F.nullif("url", F.lit("")), published_at=F.nullif("date", F.lit("")),
    )


def usability(e: DataFrame) -> DataFrame:
    """(evidence_id, timely, can_locate, short_ref): has a time; its place is a page, chunk or notice; a reference for a report."""
    l = F.col("locator")
    place = F.coalesce(l["page"] != 0, F.lit(False)) | l["chunk_index"].isNotNull() | (text.blank(l["notice_id"]) != "")
    year, link = F.substring("published_at", 1, 4), F.substring("url", 1, 60)
    parts = [F.when(F.col("publisher") != "", F.col("publisher")).otherwise(F.col("title")), F.when(text.blank(F.col("published_at")) != "", year), F.when(text.blank(F.col("url")) != "", link)]
    return e.select("evidence_id", (F.col("published_at").isNotNull() | F.col("as_of").isNotNull()).alias("timely"), F.coalesce(place, F.lit(False)).alias("can_locate"), F.concat_ws(" | ", *parts).alias("short_ref"))


def issues(e: DataFrame) -> DataFrame:
    """Adds ``issues``: codes of the rules a row breaks, in a fixed order."""
    empty = lambda c: F.trim(text.blank(F.col(c))) == ""
    l = F.col("locator")
    rules = [
        (empty("evidence_id"), "evidence_id_empty"), (~F.col("source_kind").isin(KINDS), "kind_invalid"), (empty("title"), "title_empty"), (empty("publisher"), "publisher_empty"),
        (empty("content"), "content_empty"), (~F.col("quality_tier").isin(TIERS), "tier_invalid"), (~F.col("content_hash").eqNullSafe(F.sha2(text.blank(F.col("content")), 256)), "hash_differs"),
        (l.isNull(), "locator_missing"), ((F.col("source_kind") == "document") & l.isNotNull() & l["page"].isNull() & l["chunk_index"].isNull(), "document_place_missing"),
        ((F.col("source_kind") == "bidding") & (text.blank(l["notice_id"]) == ""), "notice_id_missing"), ((F.col("source_kind") == "market_quote") & empty("as_of"), "as_of_missing"),
    ]
    return e.withColumn("issues", F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), lambda x: x.isNotNull()))


def validity(e: DataFrame) -> DataFrame:
    return issues(e).groupBy("source_kind").agg(F.count("*").alias("n"), F.count_if(F.size("issues") == 0).alias("valid"))


def citation(e: DataFrame) -> DataFrame:
    """(evidence_id, anchor, reference_url, source_kind) for display."""
    l, kind, title = F.col("locator"), F.col("source_kind"), F.substring("title", 1, 50)
    linked = F.concat(text.url_host(F.col("url")), F.lit(" — "), F.substring("title", 1, 40))
    anchor = (
        F.when((kind == "document") & l["page"].isNotNull(), F.concat(F.lit("p. "), l["page"].cast("string")))
        .when((kind == "document") & l["chunk_index"].isNotNull(), F.concat(F.lit("chunk "), l["chunk_index"].cast("string")))
        .when(kind.isin("news", "policy", "web_search") & (text.blank(F.col("url")) != ""), linked)
        .when((kind == "bidding") & (text.blank(l["notice_id"]) != ""), F.concat(F.lit("notice "), l["notice_id"]))
        .when((kind == "sql_row") & (text.blank(l["row_id"]) != ""), F.concat(F.lit("row "), F.substring(l["row_id"], 1, 12)))
        .when(kind == "sql_row", F.concat(F.lit("table "), text.blank(l["table_name"])))
        .when((kind == "market_quote") & (text.blank(l["stock_code"]) != ""), l["stock_code"]).otherwise(title)
    )
    url = F.when(~kind.isin("bidding", "sql_row", "market_quote"), F.col("url"))
    return e.select("evidence_id", anchor.alias("anchor"), url.alias("reference_url"), "source_kind")


def first_by_url(rows: DataFrame, order: str) -> DataFrame:
    """Rows in order, each url once; rows without a url all stay."""
    n = F.row_number().over(Window.partitionBy("url").orderBy(order))
    return rows.withColumn("_n", F.when(text.blank(F.col("url")) == "", 1).otherwise(n)).filter("_n = 1").drop("_n")


def ground_facts(facts: DataFrame, results: DataFrame) -> DataFrame:
    """Facts (fact_id, query_id, url, credibility) tied to the results (query_id, url) of their query.

    A fact whose url was not returned takes the query's only url if there is just one; else it has no url,
    is to be verified, and its credibility is 0.3 at most.
    """
    known = results.select("query_id", "url").distinct()
    only = known.groupBy("query_id").agg(F.min("url").alias("only"), F.count("*").alias("n"))
    met = facts.join(known.withColumn("known", F.lit(True)), ["query_id", "url"], "left").join(only, "query_id", "left")
    url = F.when(F.col("known"), F.col("url")).when(F.col("n") == 1, F.col("only")).otherwise("")
    return met.withColumn("url", url).withColumn("needs_verification", F.col("url") == "").withColumn(
        "credibility", F.when(F.col("needs_verification"), F.least("credibility", F.lit(0.3))).otherwise(F.col("credibility"))
    ).drop("known", "only", "n")
