"""Chat formatting of reply trees, in DataFrame functions only.

A tree's nodes point at their parents. Iterative self-joins double every node's pointer, so that
after log2(depth) rounds each node knows its root, its depth and the score of its path; leaves are
ranked by that score within their tree, the chosen leaves' paths are enumerated by the same pointers,
and each is formatted as one conversation. Rows of ids only are joined; texts are joined once.

A turn is ``### role``, a newline, the escaped text, a newline and ``</turn>``, and a newline. In
texts a backslash goes before every backslash, before the slash of ``</turn>`` and inside ``###``,
so neither mark can occur in one and a backslash always means that the next character is itself.
Roles are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, read, slim

START, END = "### ", "\n</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    marks = F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(marks, "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chosen_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(tree, node, leaf, rank, depth) of every node on the ``paths`` best root-to-leaf paths of each tree.

    ``nodes``: tree, node, parent (null: root), score. A path's score is the sum over its nodes (null: 0);
    ties go to the longer path, then to the smaller leaf. A parent that is absent makes its child a root. Of
    repeated rows of a node the one with the least parent counts (null first), then the one with the largest
    score. Nodes whose way up never ends, because parents run in a cycle, are on no path. Without nodes there
    are no paths.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    own = nodes.groupBy("tree", "node").agg(F.min(F.struct(F.col("parent").isNotNull().alias("has"), "parent", (-score).alias("less"))).alias("m")).select(
        "tree", "node", F.col("m.parent").alias("parent"), (-F.col("m.less")).alias("score")
    )
    real = own.select("tree", F.col("node").alias("parent"))
    up = own.join(real.withColumn("real", F.lit(True)), ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("real"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("depth")
    )
    jumps = [up := materialise(up, "jumps")]
    parents = up.filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    most = up.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range((most - 1).bit_length() if most else 0):  # no way up within a tree of so many nodes is longer
        if not up.filter("up is not null").limit(1).count():
            break
        above = up.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("s"), F.col("depth").alias("d"))
        met = up.filter("up is not null").join(above, ["tree", "up"], "left")  # a node that has reached its root is done
        up = materialise(
            up.filter("up is null").unionByName(met.select("tree", "node", F.col("next").alias("up"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"))),
            "jumps",
        )
        jumps.append(up)
    up = up.filter("up is null")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "node")
    leaves = up.join(parents, ["tree", "node"], "left_anti").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= paths)
    path = leaves.select("tree", "node", F.col("node").alias("leaf"), "rank")
    for jump in jumps[:-1]:
        above = path.join(jump.filter("up is not null").select("tree", "node", "up"), ["tree", "node"])
        path = path.unionByName(above.select("tree", F.col("up").alias("node"), "leaf", "rank"))
        path = materialise(path, "paths")
    return path.join(up.select("tree", "node", "depth"), ["tree", "node"])


def format_turns(turns: DataFrame, key: list[str]) -> DataFrame:
    """One row for each ``key``: formatted, loss (spans of code points under the mask, in order).

    ``turns``: the key's columns, depth (order), role, text. A null role or text is empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))
    piece = turns.select(*key, "depth", (role == LOSS_ROLE).alias("loss"), F.length(head).alias("head"), F.concat(head, escape(text), F.lit(END)).alias("piece"))
    before = Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = piece.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    span = F.when(F.col("loss"), F.struct((F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.length("piece") - len(END)).alias("end")))
    return placed.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: role and unescaped text of each, in order."""
    pieces = F.filter(F.split(formatted, "\n</turn>\n"), lambda x: x != "")

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        return F.struct(
            F.url_decode(F.substring(head, len(START) + 1, 1 << 30)).alias("role"), unescape(F.substr(x, F.length(head) + 2)).alias("text")
        )

    return F.transform(pieces, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss for a flat table (conv_id, turn, role, text): a tree of one path each.

    Rows go by turn (nulls first), then role and text; every row is one turn, repeated rows too. Rows
    without a conv_id are one conversation whose conv_id is null. An empty table gives an empty result.
    """
    own = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    flat = slim(rows, "conv_id", "turn", "role", "text").withColumn("tree", own)
    flat = materialise(flat.select("tree", F.row_number().over(order).cast("long").alias("node"), "role", "text"), "turns")
    nodes = flat.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))
    on_path = chosen_paths(nodes).select("tree", "node", "depth")
    out = format_turns(flat.join(on_path, ["tree", "node"]), ["tree"])
    return out.select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"), "formatted", "loss")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slim(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    back = format_conversations(rows.unionByName(probe)).select("conv_id", "formatted", "loss", parse(F.col("formatted")).alias("turns"))
    said_back = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_back, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
         + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x: greatest(length(x) - 2, 0))), 0) AS escaped FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 1 + escaped + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
