"""Reads and writes of evidence tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_SUFFIXES = ["txt", "md", "csv", "json", "yaml", "yml", "xml", "html", "py", "js", "ts"]
SIGNATURES = [("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("zip", "504B0304"), ("ole", "D0CF11E0A1B11AE1"), ("gzip", "1F8B"), ("rar", "52617221"), ("7z", "377ABCAF271C")]

BATCH_BYTES = 4 << 20

CANDIDATE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("candidate_id", "source_id", "source_name", "title")],
    T.StructField("domains", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.StringType()) for n in (
        "document_type", "source_url", "fulltext_url", "content_format", "published_at", "document_version", "authority_level", "claim_type",
        "doi", "external_id", "license_name", "license_url", "ingestion_policy", "review_status", "local_path", "content_hash",
    )],
    T.StructField("is_open_access", T.BooleanType()), T.StructField("is_synthetic", T.BooleanType()), T.StructField("quality_score", T.IntegerType()),
    T.StructField("quality_reasons", T.ArrayType(T.StringType())),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that the cluster shares (spark.checkpoint.dir); only a local session may leave it unset and uses its warehouse."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that its uses share one run and a lost executor costs no more than it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on the session hands Arrow functions 4 MB of rows at a time, so that a worker's memory does not hang on how long texts are."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) != f"{BATCH_BYTES}b":
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, text of every file with a text suffix; bytes that are not UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(TEXT_SUFFIXES) + "}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.decode("content", "UTF-8").alias("text"))


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and the family that each file's first 16 bytes tell."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 16))
    kind = None
    for name, start in SIGNATURES:
        kind = F.when(head.startswith(start), F.lit(name)) if kind is None else kind.when(head.startswith(start), F.lit(name))
    return files.select("path", F.col("length").alias("bytes"), kind.otherwise(F.lit("unknown")).alias("kind"))


def safe_name(name):
    """The last part of a path with either slash."""
    return F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CANDIDATE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def front_matter(files: DataFrame) -> DataFrame:
    """Adds ``meta`` (map of the scalar lines between the two ``---`` lines) and ``body``."""
    head = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_]+):", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(x, r"^[A-Za-z_]+:(.*)$", 1), "^ *[\"']|[\"'] *$", "")).alias("v")))
    return files.withColumn("meta", F.map_from_entries(pairs)).withColumn("body", F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", ""))


def sse_events(bodies: DataFrame) -> DataFrame:
    """(id, n, event, data) of the blocks of server-sent event bodies (id, body)."""
    blocks = bodies.select("id", F.posexplode(F.split("body", r"\r?\n\r?\n")).alias("n", "block")).filter(F.trim("block") != "")
    lines = lambda key: F.array_join(F.regexp_extract_all("block", F.lit(rf"(?m)^{key}: ?(.*)$"), 1), "\n")
    return blocks.select("id", "n", lines("event").alias("event"), lines("data").alias("data"))


def flatten_results(results: DataFrame) -> DataFrame:
    """(query, kind, title, url, snippet) of nested web results: knowledge graph, organic, questions, related searches."""
    part = lambda kind, items, title, url, snippet: results.select("query", F.explode(items).alias("r")).select(
        "query", F.lit(kind).alias("kind"), F.col(f"r.{title}").alias("title"), (F.col(f"r.{url}") if url else F.lit(None).cast("string")).alias("url"),
        (F.col(f"r.{snippet}") if snippet else F.lit(None).cast("string")).alias("snippet"),
    )
    graph = results.filter("knowledgeGraph is not null").select("query", F.lit("knowledge_graph").alias("kind"), "knowledgeGraph.title", F.col("knowledgeGraph.website").alias("url"), F.col("knowledgeGraph.description").alias("snippet"))
    return (
        graph.unionByName(part("organic", "organic", "title", "link", "snippet"))
        .unionByName(part("question", "peopleAlsoAsk", "question", "link", "snippet")).unionByName(part("related", "relatedSearches", "query", None, None))
    )


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of rows of the same key; of several new rows the last by ``order``."""
    from pyspark.sql import Window

    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    return old.join(last.select(*key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(*key).distinct(), key, "left_anti")


def describe(spark: SparkSession, names: list[str]) -> DataFrame:
    """name, columns and rows of the session's tables or views."""
    out = None
    for n in names:
        df = spark.table(n)
        one = df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), F.lit(len(df.columns)).alias("columns"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def page(df: DataFrame, by: list, limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order that the caller makes total; a limit over the cap is the cap."""
    return df.orderBy(*by).offset(max(0, offset)).limit(min(limit, most))


def columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, place, column, type, nullable) of the session's tables or views."""
    rows = [F.struct(F.lit(n).alias("name"), F.lit(i).alias("place"), F.lit(c.name).alias("column"), F.lit(c.dataType.simpleString()).alias("type"), F.lit(c.nullable).alias("nullable")) for n in names for i, c in enumerate(spark.table(n).schema)]
    return spark.range(1).select(F.inline(F.array(*rows)))  # a row for each column of a table


def of_file(chunks: DataFrame, name: str) -> DataFrame:
    """A file's chunks (filename, idx, …) in order."""
    return chunks.filter(F.col("filename") == name).orderBy("idx")


def read_fixture(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """(kind, row) of a JSON file that has a list of objects under each key of ``kinds`` (key to kind); row is the object as JSON."""
    body = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    parts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.try_variant_get("v", f"$.{key}", "array<variant>").alias("rows")) for key, kind in kinds.items()])
    return body.select(F.inline(parts)).select("kind", F.explode("rows").alias("row")).select("kind", F.to_json("row").alias("row"))


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in one order of keys, in as many files as there are partitions."""
    write_jsonl(rows, path)
