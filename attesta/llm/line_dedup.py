"""Line dedup by site-relative frequency, in DataFrame functions only.

Within a host, a line is boilerplate if it repeats, on two pages at least, and stands on more than ``RATIO`` of the host's
pages, however many or few these are. A caller who does not trust the ratio of small hosts may count a host as one of
``least_host`` pages; that is off by default and no query uses it.
Pages are counted by content: exact copies of a page are one page, so a much-copied page does not turn its
own lines into boilerplate. Every boilerplate line goes, whatever it leaves of its page. With ``passages``, as
in the pipeline and ``op1_line_dedup_full``, lines over ``LONG_WORDS`` words, which pages share by copying
rather than by chance, go from ``LONG_RATIO`` on, and from ``LONG_PAGES`` pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, read, slim

RATIO = 5  # percent of a host's pages
REPEATED = 2  # pages that a line is on at least; a line of one page repeats nowhere
LONG_WORDS, LONG_RATIO, LONG_PAGES = 50, 5, 5  # words; in 10,000 of a host's pages; pages
LINES_TO_BROADCAST = 200_000  # boilerplate lines of all hosts, 12 bytes each; beyond it they are joined
_BUCKET = 4  # boilerplate lines of a host that share a bucket of its look-up table


def _key(line: Column) -> Column:
    """96 bits of a line without its outer spaces."""
    return F.struct(F.xxhash64(F.trim(line)).alias("h"), F.hash(F.trim(line)).alias("g"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _long(line: Column) -> Column:
    return (F.length(line) > 2 * LONG_WORDS) & (F.size(F.split(F.trim(line), " +")) > LONG_WORDS)


def _host_and_page(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text",
        F.struct(F.xxhash64("text").alias("p"), F.length("text").alias("n")).alias("page"),
    ).filter("text is not null")


def boilerplate(docs: DataFrame, host: str = "source", passages: bool = False, least_host: int = 0) -> DataFrame:
    """(host, key) of every boilerplate line; with ``passages`` the ratio is lower for long lines; a host counts as ``least_host`` pages at least."""
    pages = _host_and_page(docs, host)
    long = _long if passages else lambda x: F.lit(False)
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.struct(_key(x).alias("key"), long(x).alias("long"))))
    holding = (
        pages.select("host", "page", F.explode(own).alias("line")).select("host", "page", "line.key", "line.long").distinct()
        .groupBy("host", "key", "long").agg(F.count("*").alias("holding")).filter(F.col("holding") >= REPEATED)
    )
    total = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    short = 100 * F.col("holding") > RATIO * F.greatest("total", F.lit(least_host))
    passage = (F.col("holding") >= LONG_PAGES) & (10_000 * F.col("holding") > LONG_RATIO * F.col("total"))
    return holding.join(total, "host").filter(short | (F.col("long") & passage)).select("host", "key")


def _look_up(lines: DataFrame) -> DataFrame:
    """(host, drop): a host's boilerplate keys in buckets by their hash, about ``_BUCKET`` to each, so that a line is compared with few of them."""
    size = lines.groupBy("host").agg(F.ceil(F.count("*") / _BUCKET).cast("int").alias("size"))
    every = size.select("host", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("bucket"))
    held = lines.join(size, "host").groupBy("host", F.pmod(F.col("key.h"), F.col("size")).cast("int").alias("bucket")).agg(F.collect_list("key").alias("keys"))
    full = every.join(held, ["host", "bucket"], "left").select("host", F.struct("bucket", F.coalesce("keys", F.array().cast("array<struct<h:bigint,g:int>>")).alias("keys")).alias("b"))
    return full.groupBy("host").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["keys"]).alias("drop"))


def _cut(docs: DataFrame, host: str, passages: bool, least_host: int = 0) -> DataFrame:
    """row (the columns but text), text, lines, kept: the lines of every row and those of them that stay."""
    lines = materialise(boilerplate(docs, host, passages, least_host), "boilerplate")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"),
    )
    if lines.count() <= LINES_TO_BROADCAST:
        rows = rows.join(F.broadcast(_look_up(lines)), "host", "left")
        gone = lambda key: F.array_contains(F.get(F.col("drop"), F.pmod(key["h"], F.size("drop")).cast("int")), key)
    else:
        held = _host_and_page(docs, host).select("host", "page", F.explode(F.transform(_lines(F.col("text")), _key)).alias("key")).distinct()
        drops = held.join(lines, ["host", "key"]).groupBy("host", "page").agg(F.collect_list("key").alias("drop"))
        rows = rows.withColumn("page", F.struct(F.xxhash64("text").alias("p"), F.length("text").alias("n"))).join(drops, ["host", "page"], "left")
        gone = lambda key: F.array_contains(F.col("drop"), key)
    split = rows.withColumn("lines", _lines(F.col("text")))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~gone(_key(x))))
    return split.select("row", "text", "lines", kept.alias("kept"))


def _text() -> Column:
    return F.when(F.size("kept") == F.size("lines"), F.col("text")).otherwise(F.array_join("kept", "\n"))


def drop_boilerplate(docs: DataFrame, host: str = "source", passages: bool = False, least_host: int = 0) -> DataFrame:
    """``docs`` with boilerplate lines out of text; adds n_lines and n_dropped. ``passages``, ``least_host``: as in boilerplate().

    Only ``text`` and the host column are read. A null text stays null with 0 lines; an empty text is
    one blank line; blank lines are never dropped; a page of boilerplate alone becomes an empty text; rows
    without a host are one host of their own. Repeated rows are judged alike. An empty table gives an empty
    result. Lines are compared whole, without the spaces around them. Existing columns named n_lines or
    n_dropped are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    cut = _cut(docs.select(*[F.col(f"`{c}`") for c in keep]), host, passages, least_host)
    counts = {"n_lines": F.size("lines"), "n_dropped": F.size("lines") - F.size("kept")}
    return cut.select(
        *[(_text() if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in keep],
        *[F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias(c) for c, n in counts.items()],
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents with every boilerplate line out, in the columns they came with; n_chars, if there, is of the text that is left."""
    out = _cut(docs, "source", True).select(*[(_text() if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = slim(read(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op1_line_dedup_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = slim(read(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return drop_boilerplate(docs, passages=True).select("doc_id", "n_lines", "n_dropped", "text")


def _sql(over: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT host, text, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM d),
c AS (SELECT host, line, count(DISTINCT text) AS holding FROM l WHERE line <> '' GROUP BY host, line),
p AS (SELECT host, count(DISTINCT text) AS total FROM d GROUP BY host),
b AS (SELECT c.host, list(c.line) AS drops FROM c JOIN p ON c.host = p.host WHERE {over} GROUP BY c.host),
k AS (SELECT d.doc_id, d.text, d.lines,
             CASE WHEN b.drops IS NULL THEN d.lines
                  ELSE list_filter(d.lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(b.drops, trim(x, ' '))) END AS kept
      FROM d LEFT JOIN b ON d.host = b.host)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM k
"""


_SHORT = f"holding >= {REPEATED} AND 100 * holding > {RATIO} * total"
_LONG = f"holding >= {LONG_PAGES} AND 10000 * holding > {LONG_RATIO} * total"
OP1_SQL = _sql(_SHORT)
OP1_FULL_SQL = _sql(f"({_SHORT}) OR (len(regexp_split_to_array(c.line, ' +')) > {LONG_WORDS} AND {_LONG})")
