"""Token and item budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

CONTEXT_TOKENS, MOST_DOCS, MEMORY_TOKENS, SUFFIX_TOKENS, LAST = 6000, 10, 10_000, 5000, 20


def suffix(messages: DataFrame, tokens: int = SUFFIX_TOKENS) -> DataFrame:
    """The newest messages (conv_id, turn, text) of each conversation whose running total stays within the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    est = messages.withColumn("tokens", text.token_estimate(F.col("text")))
    return est.withColumn("total", F.sum("tokens").over(w)).filter(F.col("total") <= tokens)


def last_messages(messages: DataFrame, most: int = LAST) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def memory_due(messages: DataFrame, tokens: int = MEMORY_TOKENS) -> DataFrame:
    """(conv_id, tokens, due): a third of each message's characters, summed; due strictly above the limit."""
    total = F.sum(F.floor(F.length(text.blank(F.col("text"))) / 3)).cast("long")
    return messages.groupBy("conv_id").agg(total.alias("tokens")).withColumn("due", F.col("tokens") > tokens)


def pack(candidates: DataFrame, tokens: int = CONTEXT_TOKENS, most: int = MOST_DOCS) -> DataFrame:
    """Greedy packing in order of weight: a document that does not fit is passed over and smaller ones still count.

    ``candidates``: group_id, doc_id, weight, tokens (0 or more); (group_id, doc_id, position) comes back. The choice
    is a fold over each group's candidates of at most ``tokens``, of each number of tokens the first ``most``. That is
    exact: had a later one fitted, so had those before it of the same size, and the places would have been full. A
    group is thus folded over ``most`` rows for each number of tokens up to the budget, however many candidates it has.
    """
    order = Window.partitionBy("group_id").orderBy(F.desc("weight"), "doc_id")
    alike = Window.partitionBy("group_id", "tokens").orderBy(F.desc("weight"), "doc_id")
    fitting = candidates.select("group_id", "doc_id", "weight", F.col("tokens").cast("long").alias("tokens")).filter(F.col("tokens") <= tokens)
    first = fitting.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= most).withColumn("n", F.row_number().over(order))
    rows = first.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("n", "doc_id", "tokens"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(s, r):
        fits = (F.size(s["ids"]) < most) & (s["used"] + r["tokens"] <= tokens)
        return F.when(fits, F.struct((s["used"] + r["tokens"]).alias("used"), F.concat(s["ids"], F.array(r["doc_id"])).alias("ids"))).otherwise(s)

    return rows.select("group_id", F.posexplode(F.aggregate("rows", start, step, lambda s: s["ids"])).alias("p", "doc_id")).select("group_id", "doc_id", (F.col("p") + 1).cast("long").alias("position"))


def context_budget(requests: DataFrame, window: int = 8192, reserve: int = 1024, minimum: int = 256) -> DataFrame:
    """Adds used, remaining, reserve_output and rejected to requests (…, input_tokens, requested_output).

    The output gets what is left of the window, up to what is asked for; a request is rejected if that is
    less than the smaller of what it asks for and the minimum.
    """
    asked = F.coalesce("requested_output", F.lit(reserve))
    left = F.lit(window) - F.col("input_tokens")
    return requests.withColumn("used", F.col("input_tokens")).withColumn("remaining", left).withColumn("reserve_output", F.greatest(F.lit(0), F.least(asked, left))).withColumn(
        "rejected", F.col("reserve_output") < F.least(asked, F.lit(minimum))
    )
