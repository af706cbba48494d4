"""Query planning: glossary expansion and balanced sub-queries, as Column expressions over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# fixed values, in order: a term that an earlier matched term contains is passed over
GLOSSARY = [
    ("命令行", ["command line"]),
    ("覆盖默认值", ["command line", "environment variable"]),
    ("默认值", ["default value"]),
    ("时序报告", ["timing report"]),
    ("布线问题", ["DRC Viewer", "detailed routing"]),
    ("检查布局", ["heat map"]),
    ("时序", ["timing report"]),
    ("时钟周期", ["clock period"]),
    ("时钟树", ["clock tree synthesis"]),
    ("布图规划", ["floorplan"]),
    ("详细布线", ["detailed routing"]),
    ("全局布线", ["global routing"]),
    ("地址匹配", ["Address Matching"]),
    ("锁定机制", ["Locking", "Privilege Mode"]),
    ("锁定", ["Locking"]),
    ("供应链", ["supply chain"]),
    ("地理集中", ["geographic concentration"]),
    ("基础设施", ["infrastructure"]),
    ("运营能力", ["workforce", "cybersecurity"]),
    ("人才", ["workforce"]),
    ("劳动力", ["workforce"]),
    ("网络安全", ["cybersecurity"]),
    ("运营安全", ["operational security"]),
    ("安全能力", ["cybersecurity", "operational security"]),
    ("参考材料", ["reference materials"]),
    ("材料纯度", ["material purity"]),
    ("纯度", ["purity"]),
    ("颗粒", ["particles"]),
    ("痕量杂质", ["trace impurities"]),
    ("供应商", ["suppliers"]),
    ("可追溯", ["traceability", "provenance"]),
    ("计量", ["metrology"]),
    ("内部缺陷", ["internal defects", "voids"]),
    ("缺陷", ["defects"]),
    ("污染物", ["contaminants"]),
    ("材料性能", ["material properties"]),
    ("在线计量", ["in-line metrology"]),
    ("在线量测", ["in-line metrology"]),
    ("吞吐量", ["throughput"]),
    ("灵敏度", ["sensitivity"]),
    ("准确度", ["accuracy"]),
    ("建模", ["modeling"]),
    ("仿真", ["simulation"]),
    ("验证", ["validation"]),
    ("反馈", ["feedback"]),
    ("高吞吐量", ["high-throughput"]),
    ("过程控制", ["process control"]),
    ("质量保证", ["quality assurance"]),
    ("互操作", ["interoperable equipment and software"]),
    ("数据交换", ["data exchange"]),
    ("制造自动化", ["manufacturing automation"]),
    ("三维", ["3D structures"]),
    ("界面", ["interfaces"]),
    ("低翘曲", ["low warpage"]),
    ("翘曲", ["warpage"]),
    ("供电", ["power delivery"]),
    ("热管理", ["thermal management"]),
    ("空洞", ["voids"]),
    ("应力", ["stresses"]),
    ("粘附", ["adhesion"]),
    ("内建测试", ["built-in test"]),
    ("保护芯片", ["mechanically", "thermally", "environmentally"]),
    ("连接系统", ["inter-chip communication", "power delivery"]),
    ("芯片间通信", ["inter-chip communication"]),
    ("机械", ["mechanically"]),
    ("装配", ["assembly"]),
]
LIMIT = 6


def _settled(rows: DataFrame) -> DataFrame:
    """The same rows; their columns are computed once, where the optimiser would else repeat them in every use."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def with_phrases(rows: DataFrame, question: str, pairs: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Adds ``phrases``: those of the glossary terms that a question holds, each once however it is written."""
    table = F.array(*[F.struct(F.lit(t.lower()).alias("term"), F.array(*map(F.lit, ps)).alias("phrases")) for t, ps in (GLOSSARY if pairs is None else pairs)])
    held = rows.withColumn("_low", F.lower(question)).transform(_settled).withColumn("_held", F.filter(table, lambda g: F.contains("_low", g["term"]))).transform(_settled)
    own = F.filter("_held", lambda g, i: ~F.exists(F.slice("_held", 1, i), lambda before: F.contains(before["term"], g["term"])))
    every = held.withColumn("_every", F.flatten(F.transform(own, lambda g: g["phrases"]))).transform(_settled)
    named = every.withColumn("_names", F.transform("_every", F.lower)).transform(_settled)
    return named.withColumn("phrases", F.filter("_every", lambda p, i: F.array_position("_names", F.lower(p)) == i + 1)).drop("_low", "_held", "_every", "_names")


def anchor(question: Column) -> Column:
    """What every sub-query starts with: the question's technical tokens, else its words before the first comma."""
    tokens = F.array_distinct(F.filter(text.raw_tokens(question), lambda t: F.length(t) > 1))
    return F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(F.trim(F.regexp_extract(question, "^([^，,;；、]*)", 1)))


def query_plans(questions: DataFrame, limit: int = LIMIT, pairs: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(query_id, variant, query, focus) of a table of questions (query_id, question).

    Variant 0 is the question; then its phrases are dealt in order over the free seats, the first seats taking one
    more where they do not come out even; a seat that is left takes the question with all phrases. One phrase is
    split off only beside an identifier. Queries that differ in case alone count once.
    """
    limit = max(1, limit)
    own = questions.select("query_id", F.trim(text.blank(F.col("question"))).alias("q"))
    own = with_phrases(own, "q", pairs).withColumn("n", F.size("phrases"))
    own = own.withColumn("seats", F.least(F.lit(limit - 1), F.col("n"))).withColumn("anchor", anchor(F.col("q"))).transform(_settled)
    size, more = F.floor(F.col("n") / F.col("seats")).cast("int"), (F.col("n") % F.col("seats")).cast("int")

    def seat(g: Column) -> Column:
        own = F.slice("phrases", g * size + F.least(g, more) + 1, size + (g < more).cast("int"))
        return F.struct(F.trim(F.concat_ws(" ", "anchor", F.array_join(own, " "))).alias("query"), own.alias("focus"))

    strong = F.contains("q", F.lit("_")) | F.exists(text.raw_tokens(F.col("q")), lambda t: t.rlike("[_-]") | ((F.length(t) > 1) & (F.upper(t) == t)))
    none = F.array().cast("array<struct<query:string,focus:array<string>>>")
    split = (F.col("seats") > 0) & ((F.col("n") > 1) | strong)
    seats = F.when(split, F.transform(F.sequence(F.lit(0), F.col("seats") - 1), seat)).otherwise(none)
    whole = F.struct(F.concat("q", F.lit(" Technical terms: "), F.array_join("phrases", "; ")).alias("query"), F.col("phrases").alias("focus"))
    rest = F.when(split & (F.col("seats") + 1 < limit), F.array(whole)).otherwise(none)
    first = F.array(F.struct(F.col("q").alias("query"), F.array().cast("array<string>").alias("focus")))
    named = own.select("query_id", F.filter(F.concat(first, seats, rest), lambda p: p["query"] != "").alias("all")).transform(_settled)
    named = named.withColumn("names", F.transform("all", lambda p: F.lower(p["query"]))).transform(_settled)
    once = F.filter("all", lambda p, i: F.array_position("names", F.lower(p["query"])) == i + 1)
    plan = named.select("query_id", F.slice(once, 1, limit).alias("plan"))
    return plan.select("query_id", F.posexplode("plan").alias("variant", "p")).select("query_id", "variant", "p.query", "p.focus")


def explain_identifier(question, template: str = "Explain what the identifier %s stands for in the documents."):
    """A question that is an identifier alone becomes a request to explain it."""
    bare = F.trim(question)
    return F.when(bare.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]{2,}$"), F.format_string(template, bare)).otherwise(question)
