"""Ingestion: page text to markdown, uploads, manifests, lenient JSON, offline embeddings, splits."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.tables import settle, small_batches
from . import chunking, dense

# page text

# fixed values: a hyphen after these stays
KEEP_HYPHEN = ["cross", "end", "full", "high", "in", "low", "multi", "next", "non", "real", "self", "state", "well"]
MARGIN, SHORT, FULL_PAGE = 2, 120, 7  # lines at each margin, longest repeated line, lines of a full page
_BREAK = "\r\n|[\n\r\u000b\u001c-\u001e\u0085\u2028\u2029]"


def page_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pages, page, at, line, edge) of every line of documents (doc_id, text) whose pages are parted by form feeds; white space is levelled, blank
    pages are left out. ``pages``: their number in the document; ``edge``: whether a line is at a full page's margin, told from its page alone."""
    bodies = F.filter(F.transform(F.split(text.blank(F.col("text")), r"\f+"), lambda x, i: F.struct(i.alias("page"), x.alias("body"))), lambda p: p["body"].rlike(r"\S"))
    pages = docs.select("doc_id", bodies.alias("p")).select("doc_id", F.size("p").alias("pages"), F.explode("p").alias("p")).select("doc_id", "pages", "p.page", "p.body")
    levelled = F.transform(F.split("body", _BREAK), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    own = pages.select("doc_id", "pages", "page", levelled.alias("l"))
    filled = F.filter(F.transform("l", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    full = own.withColumn("filled", filled).withColumn("n", F.size("filled"))
    ends = [F.when(F.col("n") >= FULL_PAGE, F.get("filled", at)) for at in (F.lit(MARGIN - 1), F.col("n") - MARGIN)]
    lines = full.select("doc_id", "pages", "page", ends[0].alias("head"), ends[1].alias("foot"), F.posexplode("l").alias("at", "line"))
    edge = F.coalesce((F.col("line") != "") & ((F.col("at") <= F.col("head")) | (F.col("at") >= F.col("foot"))), F.lit(False))
    return lines.select("doc_id", "pages", "page", "at", "line", edge.alias("edge"))


def running_lines(lines: DataFrame) -> DataFrame:
    """Adds ``often``, whether a line's shape stands at the margins of half the document's pages, three at least.

    A line's shape has its numbers levelled, so that a page number does not make a header another line. Shapes that stand often are one list a
    document, so that lines are dealt out by documents alone, once for all that follows.
    """
    shape = F.regexp_replace(F.lower("line"), r"\b\d+\b", "#")
    margins = lines.filter((F.col("pages") >= 3) & F.col("edge") & (F.length("line") <= SHORT)).select("doc_id", "pages", "page", shape.alias("shape")).distinct()
    least = F.greatest(F.lit(3), F.floor((F.col("pages") + 1) / 2))
    often = margins.groupBy("doc_id", "pages", "shape").agg(F.count("*").alias("n")).filter(F.col("n") >= least).groupBy("doc_id").agg(F.collect_set("shape").alias("shapes"))
    met = F.when(F.col("shapes").isNull(), False).otherwise(F.array_contains("shapes", shape))
    return lines.join(often.hint("merge"), "doc_id", "left").withColumn("often", met).drop("shapes")


def line_kind(line: Column) -> Column:
    """blank, item, heading or plain."""
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    titled = line.rlike(r"^[A-Z][.)]\s+\S") | ((letters >= 4) & ~line.rlike(r"\p{Ll}"))
    heading = (F.length(line) <= 140) & ~line.rlike(r"[.;,]$") & titled
    return F.when(line == "", "blank").when(line.rlike(r"^([-*•]|\d+[.)])\s+"), "item").when(heading, "heading").otherwise("plain")


def _joined(lines: Column) -> Column:
    """A block's lines as one text; a word that a line's end broke is whole again. The text so far is searched only where it ends in a hyphen."""
    broken = lambda a, b: a.endswith("-") & a.rlike("[A-Za-z]-$") & b.rlike(r"^\p{Ll}")
    stem = lambda a: F.lower(F.regexp_extract(a, "([A-Za-z]+)-$", 1))
    bare = lambda a: F.when(stem(a).isin(KEEP_HYPHEN), a).otherwise(F.regexp_replace(a, "-$", ""))
    rest = F.slice(lines, 2, F.size(lines))
    return F.aggregate(rest, F.get(lines, F.lit(0)), lambda a, b: F.when(broken(a, b), F.concat(bare(a), b)).otherwise(F.concat(a, F.lit(" "), b)))


def pages_to_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown) of documents (doc_id, text): repeated page margins, page numbers and lines of contents go, broken words
    are joined, likely titles become headings. A document without lines has an empty text; ids are taken to be distinct.

    Lines are dealt into blocks by a running count of the lines that start one: an item, a plain line that follows no
    open item or paragraph of its page, and a heading unless it goes on from the heading before it.
    """
    lines = running_lines(page_lines(docs)).withColumn("kind", line_kind(F.col("line")))
    number, contents = F.col("line").rlike(r"(?i)^(page\s+)?\d+$"), F.col("line").rlike(r"(?:\.\s*){4,}\d+$")
    kept = lines.filter(~((F.col("edge") & (F.col("often") | number)) | contents))
    order = Window.partitionBy("doc_id").orderBy("page", "at")
    held = kept.withColumn("open", (F.lag("page").over(order) == F.col("page")) & F.lag("kind").over(order).isin("item", "plain")).filter("kind != 'blank'")
    goes_on = (F.lag("kind").over(order) == "heading") & ~F.lag("line").over(order).startswith("CHAPTER") & ~F.col("line").rlike(r"^(CHAPTER\b|[A-Z][.)]\s)")
    starts = F.when(F.col("kind") == "item", True).when(F.col("kind") == "plain", ~F.coalesce("open", F.lit(False))).otherwise(~F.coalesce(goes_on, F.lit(False)))
    dealt = held.withColumn("block", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.when(F.col("kind") == "item", F.regexp_replace("line", r"^•\s*", "- ")).otherwise(F.col("line"))
    blocks = dealt.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("page", "at", line.alias("line")))).alias("l"), F.min_by("kind", F.struct("page", "at")).alias("kind"))
    lined = F.transform("l", lambda x: x["line"])
    body = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), F.array_join(lined, " "))).otherwise(F.regexp_replace(_joined(lined), r"^# (?=\S)", r"\\# "))
    texts = blocks.select("doc_id", "block", body.alias("body")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "body"))), lambda x: x["body"]), "\n\n").alias("markdown"))
    return docs.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("markdown", F.lit("")).alias("markdown"))


# uploads


def upload_verdicts(files: DataFrame, most: int = 50 << 20) -> DataFrame:
    """path and verdict of files (path, length, content): too large, empty, too many control bytes in the first 4 KiB, or pass."""
    head = F.hex(F.substring("content", 1, 4096))
    suspicious = F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)"), 1), lambda b: b.rlike("^(0[1-8F]|1[0-9A-F])$")))
    verdict = (
        F.when(F.col("length") > most, "TOO_LARGE").when(F.col("length") == 0, "EMPTY")
        .when(suspicious > 0.15 * F.least(F.col("length"), F.lit(4096)), "HIGH_CTRL_CHARS").otherwise("PASS")
    )
    return files.select("path", verdict.alias("verdict"))


# manifests


def manifest_issues(candidates: DataFrame, least_approved: int = 1, require_raw: bool = False) -> DataFrame:
    """(candidate_id, code) of a manifest's faults; the manifest's own has a null id.

    Columns: candidate_id, review_status, license_name, license_url, content_hash, local_path; optionally ``local_raw_path``, held to the
    same rules and asked for by ``require_raw``, and ``invalid``, whether the candidate breaks a rule of its own (see governance.candidate_error).
    """
    raw = F.col("local_raw_path") if "local_raw_path" in candidates.columns else F.lit(None).cast("string")
    paths = [F.col("local_path"), raw]
    either = lambda test: test(text.blank(paths[0])) | test(text.blank(paths[1]))
    blank = lambda c: text.blank(F.col(c)) == ""
    approved = F.col("review_status") == "approved"
    valid_hash = text.blank(F.col("content_hash")).rlike("^[0-9a-f]{64}$")
    rows = candidates.withColumns({
        "_n": F.row_number().over(Window.partitionBy("review_status", "content_hash").orderBy("candidate_id")), "_copies": F.count("*").over(Window.partitionBy("candidate_id")),
    })
    rules = F.array(
        F.when(F.col("_copies") > 1, "duplicate_candidate"),
        F.when(either(lambda p: p.startswith("/")), "absolute_path"),
        F.when(either(lambda p: p.rlike(r"(^|/)\.\.(/|$)")), "path_escape"),
        F.when(~approved & either(lambda p: p != ""), "unapproved_local_file"),
        F.when(approved & (blank("license_name") | blank("license_url")), "missing_license"),
        F.when(approved & ~valid_hash, "invalid_hash"), F.when(approved & valid_hash & (F.col("_n") > 1), "duplicate_content"),
        F.when(approved & blank("local_path"), "missing_path"), F.when(approved & ~blank("local_path") & (text.blank(raw) == "") & F.lit(require_raw), "missing_raw_path"),
        F.when(F.col("invalid"), "invalid_candidate") if "invalid" in candidates.columns else F.lit(None).cast("string"),
    )
    own = rows.select("candidate_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("code")).distinct()
    few = candidates.agg(F.count_if(approved).alias("n")).filter(F.col("n") < least_approved).select(F.lit(None).cast("string").alias("candidate_id"), F.lit("approved_count").alias("code"))
    return own.unionByName(few)


def metadata_issues(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(candidate_id, code) of approved candidates whose file (path, meta: map of its front matter) is absent, has no front matter, or another id, hash or address than the candidate, or says that it is synthetic or not whether it is."""
    own = candidates.filter((F.col("review_status") == "approved") & (text.blank(F.col("local_path")) != ""))
    met = own.join(files.select(F.col("path").alias("local_path"), "meta", F.lit(True).alias("found")), "local_path", "left")
    other = lambda c: ~F.try_element_at("meta", F.lit(c)).eqNullSafe(F.col(c))
    code = F.when(F.col("found").isNull(), "missing_normalized_file").when(F.coalesce(F.size("meta"), F.lit(0)) < 1, "invalid_frontmatter").when(other("candidate_id") | other("content_hash") | other("source_url") | other("license_url") | ~F.lower(F.try_element_at("meta", F.lit("is_synthetic"))).eqNullSafe(F.lit("false")), "metadata_mismatch")
    return met.select("candidate_id", code.alias("code")).filter("code is not null")


def raw_file_issues(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """(candidate_id, code) of approved candidates with a document whose raw file is not among ``paths`` (path)."""
    own = candidates.filter((F.col("review_status") == "approved") & (text.blank(F.col("local_path")) != "") & (text.blank(F.col("local_raw_path")) != ""))
    absent = own.join(paths.select(F.col("path").alias("local_raw_path")).distinct(), "local_raw_path", "left_anti")
    return absent.select("candidate_id", F.lit("missing_raw_file").alias("code")).distinct()


def admissible(candidates: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Approved candidates with a local file that are not done (candidate_id), or all of them by force."""
    ready = candidates.filter((F.col("review_status") == "approved") & (text.blank(F.col("local_path")) != ""))
    return ready if force else ready.join(done.select("candidate_id").distinct(), "candidate_id", "left_anti")


def status_counts(candidates: DataFrame) -> DataFrame:
    """(kind, name, n): candidates by review status and by domain."""
    status = candidates.groupBy(F.col("review_status").alias("name")).agg(F.count("*").alias("n")).select(F.lit("status").alias("kind"), "name", "n")
    domain = candidates.select(F.explode("domains").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("domain").alias("kind"), "name", "n")
    return status.unionByName(domain)


def public_split(rows: DataFrame, public: list[str], split: str) -> DataFrame:
    """A split without private columns, with the SHA-256 of each row's public values."""
    own = rows.filter(F.col("split") == split).select(*public)
    return own.withColumn("row_hash", F.sha2(F.to_json(F.struct(*sorted(public))), 256))


# lenient JSON

_PIECES = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|[^"/]+|/', re.S)


def repair_json(source: str | None) -> dict | list | None:
    """The object in a model's answer: as it is, in a code fence, or between the outermost braces; comments, bare
    keys, trailing commas and wrong escapes are mended, outside string literals only."""

    def parse(s: str):
        for candidate in (s.strip().lstrip("\ufeff"), mend(s)):
            try:
                out = json.loads(candidate)
            except ValueError:
                continue
            if isinstance(out, (dict, list)):
                return out
        return None

    def mend(s: str) -> str:
        out = []
        for p in _PIECES.findall(s.strip().lstrip("\ufeff")):
            if p[0] == '"':
                out.append(re.sub(r'\\(?!["\\/bfnrtu])', "", p))
            elif not p.startswith(("//", "/*")):
                out.append(re.sub(r"([{,]\s*)(\w+)(\s*:)", r'\1"\2"\3', p))
        joined = "".join(out)
        return re.sub(r",(\s*[}\]])", r"\1", joined)

    source = source or ""
    fence = re.search(r"```(?:json)?\s*(.*?)\s*```", source, re.S)
    inner = source[source.find("{") : source.rfind("}") + 1]
    for s in (source, fence[1] if fence else "", inner):
        if s and (out := parse(s)) is not None:
            return out
    return None


@F.pandas_udf(T.StringType())
def mended_json(source: pd.Series) -> pd.Series:
    """Canonical JSON of what ``repair_json`` finds; null where it finds nothing."""
    return source.map(lambda x: None if (v := repair_json(x)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True))


# offline embeddings


def digest_vector(source: str | None, dim: int) -> np.ndarray:
    """A unit vector from SHA-256 digests of the text: the same text has the same vector, and that is all it means."""
    data = b"".join(hashlib.sha256(f"{i}:{source or ''}".encode()).digest() for i in range(-(-dim // 32)))[:dim]
    v = np.frombuffer(data, np.uint8).astype(np.float64) - 127.5
    return v / np.linalg.norm(v)


def with_digest_vectors(rows: DataFrame, column: str, dim: int = 64) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(c: pd.Series) -> pd.Series:
        return c.map(lambda x: digest_vector(x, dim).astype(np.float32))

    return small_batches(rows).withColumn("embedding", embed(column))


# markdown


def safe_markdown(body: Column, urls: Column, charts: Column) -> Column:
    """Removes links outside ``urls`` (their labels stay) and images outside ``charts``."""
    none = F.array().cast("array<string>")
    target = lambda x: F.trim(F.regexp_extract(x, r"\(([^)]+)\)$", 1))
    image, link = r"(!\[[^\]]*\]\([^)]+\))", r"(?<!!)(\[[^\]]+\]\([^)]+\))"
    label = lambda x: F.regexp_extract(x, r"^!?\[([^\]]*)\]", 1)
    images = F.filter(F.regexp_extract_all(text.blank(body), F.lit(image), 1), lambda x: ~F.array_contains(F.coalesce(charts, none), target(x)))
    out = text.replace_each(body, images, lambda x: F.when(label(x) != "", F.concat(F.lit("["), label(x), F.lit("]"))).otherwise(""))
    links = F.filter(F.regexp_extract_all(out, F.lit(link), 1), lambda x: ~F.array_contains(F.coalesce(urls, none), target(x)))
    escaped = lambda x: F.regexp_replace(label(x), r"([\\$])", r"\\$1")
    return F.aggregate(F.array_distinct(links), out, lambda o, x: F.regexp_replace(o, F.concat(F.lit(r"(?<!!)\Q"), x, F.lit(r"\E")), escaped(x)))


def cell(column: Column, kind: T.DataType) -> Column:
    """A value as text for display: bytes by their number, times in ISO form."""
    if isinstance(kind, T.BinaryType):
        return F.when(column.isNotNull(), F.format_string("<binary %d bytes>", F.octet_length(column)))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return column.cast("string")


def rendered(rows: DataFrame) -> DataFrame:
    return rows.select(*[cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema])


# search trees


def bounded_search(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(query, depth) of all queries within ``depth`` follow-ups (parent, query) of the seeds (query), each at its least depth."""
    out = front = seeds.select("query").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = edges.join(front.select(F.col("query").alias("parent")), "parent", "left_semi").select("query").distinct().withColumn("depth", F.lit(d))
        out = out.unionByName(front)
    return out.groupBy("query").agg(F.min("depth").alias("depth"))


def planned_queries(plans: DataFrame, rounds: int = 3, priority: int = 2) -> DataFrame:
    """Sub-queries (session_id, round, priority, query, additional) to run: urgent ones in round 1, additional ones later."""
    first = (F.col("round") == 1) & (F.col("priority") <= priority)
    return plans.filter(first | ((F.col("round") > 1) & (F.col("round") <= rounds) & F.col("additional")))


# per-document ingestion and plans


def ingest_documents(docs: DataFrame, embed, how: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, doc_id, idx, content, content_hash, embedding) of documents (doc_id, filename, text), ready for tables.upsert().

    ``embed``: a function from a table and the name of its text column to the table with ``embedding``, such as
    with_digest_vectors(). An id follows from file name, place and beginning, so that a second run replaces the first.
    """
    cut = chunking.chunks(docs.select("doc_id", "text"), how, size, overlap).join(docs.select("doc_id", "filename"), "doc_id")
    rows = cut.select(text.chunk_id(F.col("filename"), F.col("idx"), F.col("content")).alias("id"), "doc_id", "idx", "content", F.sha2("content", 256).alias("content_hash"))
    return embed(rows, "content")


def registry_duplicates(sources: DataFrame) -> DataFrame:
    """(source_id, copies) of source ids that a registry holds more than once."""
    return sources.groupBy("source_id").agg(F.count("*").alias("copies")).filter("copies > 1")


def outline(plans: DataFrame, most: int = 9) -> DataFrame:
    """(plan_id, section, title, description, query) of flat plans (plan_id, fields: map of strings): the sections before the first without a title."""
    field = lambda i, name: F.try_element_at("fields", F.lit(f"sec_{i}_{name}"))
    rows = F.array(*[F.struct(F.lit(i).alias("section"), field(i, "title").alias("title"), text.blank(field(i, "description")).alias("description"), F.coalesce(field(i, "query"), field(i, "title")).alias("query")) for i in range(1, most + 1)])
    titled = F.filter(rows, lambda r: F.forall(F.slice(rows, 1, r["section"]), lambda x: x["title"].isNotNull()))
    return plans.select("plan_id", F.inline(titled))


def route_observations(observations: DataFrame) -> DataFrame:
    """(run_id, n, kind) of successful observations (run_id, n, tool, success): searches are data, analyses insights, charts charts; others are of no kind."""
    kind = F.when(F.col("tool").isin("web_search", "knowledge_search"), "data").when(F.col("tool") == "data_analyzer", "insights").when(F.col("tool") == "chart_generator", "charts")
    return observations.filter("success").select("run_id", "n", kind.alias("kind")).filter("kind is not null")


# memories


def memory_rows(summaries: DataFrame) -> DataFrame:
    """(id, user_id, session_id, memory_type, content) of summaries (memory_id, user_id, session_id, summary, key_insights, topics): the summary, each insight, and the topics in one row."""
    own = summaries.select("memory_id", "user_id", "session_id", F.array(
        F.struct(F.lit("_summary").alias("suffix"), F.lit("summary").alias("memory_type"), F.col("summary").alias("content")),
        F.struct(F.lit("_topics").alias("suffix"), F.lit("topics").alias("memory_type"), F.concat(F.lit("用户关注的主题: "), F.nullif(F.array_join("topics", ", "), F.lit(""))).alias("content")),
    ).alias("a"), F.transform("key_insights", lambda x, i: F.struct(F.concat(F.lit("_insight_"), i.cast("string")).alias("suffix"), F.lit("insight").alias("memory_type"), x.alias("content"))).alias("b"))
    rows = own.select("memory_id", "user_id", "session_id", F.inline(F.concat("a", F.coalesce("b", F.slice("a", 1, 0)))))
    return rows.filter("content != ''").select(F.concat("memory_id", "suffix").alias("id"), "user_id", "session_id", "memory_type", "content")


def search_memories(queries: DataFrame, memories: DataFrame, k: int = 5, block: int = dense.BLOCK) -> DataFrame:
    """(query_id, user_id, rank, score) and the columns of ``memories`` (id, user_id, embedding, …) of each query's k most similar ones of its own user.

    ``queries``: query_id, user_id, embedding. Only rows of one user meet; ties go to the smaller id; a query without a user or
    a vector finds nothing, a memory without a vector is not found. Vectors alone meet, in blocks of ``block`` rows; what is found is then
    looked up for its other columns.
    """
    found = dense.cosine_topk_of_users(queries, memories, k, block)
    others = [c for c in memories.columns if c not in ("query_id", "user_id", "rank", "score", "embedding")]
    if others == ["id"]:
        return found.select("query_id", "user_id", "rank", "score", "id")
    found = settle(found, "nearest")
    own = memories.filter("embedding is not null").drop("embedding", "query_id", "rank", "score").join(found.select("user_id", "id").distinct(), ["user_id", "id"], "left_semi")
    # rows that share an id are found once each: the n-th place of an id is its n-th row's
    nth = lambda df, *of, by: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*of).orderBy(by)))
    met = nth(found, "query_id", "user_id", "id", by="rank").join(nth(own, "user_id", "id", by="id"), ["user_id", "id", "_nth"])
    return met.select("query_id", "user_id", "rank", "score", *others)


def memory_context(hits: DataFrame) -> DataFrame:
    """(user_id, context): a user's memories (user_id, rank, memory_type, content) of distinct contents in order of rank, a line each."""
    line = F.when(F.col("memory_type") == "summary", F.concat(F.lit("- 历史对话摘要: "), "content")).when(F.col("memory_type") == "insight", F.concat(F.lit("- 相关知识点: "), "content")).when(F.col("memory_type") == "topics", F.concat(F.lit("- "), "content"))
    one = hits.groupBy("user_id", "content").agg(F.min(F.struct("rank", line.alias("line"))).alias("m")).filter("m.line is not null")
    return one.groupBy("user_id").agg(F.concat(F.lit("[相关历史记忆]\n"), F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["line"]), "\n")).alias("context"))
