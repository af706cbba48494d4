"""Feeds: counts, type families, sessions, task and outbox tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the result families come before the tender families
FAMILIES = [("中标", ["中标", "结果"]), ("招标", ["招标", "采购", "询价"])]


def family(kind: Column, families: list = FAMILIES) -> Column:
    """The first family one of whose words the kind contains; else null."""
    out = None
    for name, words in families:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(kind, F.lit(w))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def in_family(kind: Column, wanted: str, families: list = FAMILIES) -> Column:
    words = dict(families).get(wanted)
    if words is None:
        return kind == wanted
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(kind, F.lit(w))
    return hit


def category_counts(rows: DataFrame, category: str, time: str, now: Column, hours: int = 24) -> DataFrame:
    """Rows and recent rows of every category that is neither null nor empty."""
    recent = F.count_if(F.col(time) >= now - F.expr(f"interval {hours} hours"))
    return rows.filter((F.col(category) != "")).groupBy(category).agg(F.count("*").alias("n"), recent.alias("recent"))


def top_groups(rows: DataFrame, by: str, k: int = 10) -> DataFrame:
    return rows.filter(F.col(by) != "").groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def children_count(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with the number of their children, 0 where there are none."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The row of each key that comes first in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


# tasks


def claimable(outbox: DataFrame, now: Column, batch: int = 20) -> DataFrame:
    """The oldest rows that may be sent: pending and due, or dispatching with a lease that has run out."""
    due = ((F.col("status") == "pending") & (F.col("available_at") <= now)) | ((F.col("status") == "dispatching") & (F.col("locked_until") <= now))
    return outbox.filter(due).orderBy("available_at", "id").limit(batch)


def backoff(base: Column, attempt: Column, most: float | None = None) -> Column:
    wait = base * F.pow(F.lit(2.0), attempt - 1)
    return F.least(wait, F.lit(most)) if most else wait


def after_attempt(outbox: DataFrame, now: Column, most: int = 8, base: float = 5.0) -> DataFrame:
    """Rows (…, status, delivery_attempts, ok) after a delivery: published, failed at the last attempt, or pending at a later time."""
    attempts = F.col("delivery_attempts") + 1
    status = F.when(F.col("ok"), "published").when(attempts >= most, "failed").otherwise("pending")
    later = now + F.make_dt_interval(secs=backoff(F.lit(base), attempts).cast("decimal(18,6)"))
    return outbox.withColumn("available_at", F.when(F.col("ok") | (attempts >= most), F.col("available_at")).otherwise(later)).withColumn("status", status).withColumn("delivery_attempts", attempts)


def expired(outbox: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Published rows that a clean-up removes."""
    return outbox.filter((F.col("status") == "published") & (F.col("available_at") < now - F.expr(f"interval {days} days")))


def depth(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("status").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """(label, le, n): values at or under each bound, cumulative; the last bound is infinite."""
    counts = rows.groupBy(label).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count("*").alias("_all"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return counts.select(label, F.inline(pairs))


def provider_faults(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Outcomes (provider, attempts, ok, code, data) that break a rule: a failure with data, a success with a code, too many attempts."""
    fault = (
        F.when(~F.col("ok") & F.col("data").isNotNull(), "data_of_a_failure").when(F.col("ok") & F.col("code").isNotNull(), "code_of_a_success")
        .when(~F.col("ok") & F.col("code").isNull(), "failure_without_code").when(F.col("attempts") > most, "too_many_attempts")
    )
    return attempts.withColumn("fault", fault).filter("fault is not null")


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose named columns equal the given values; a value of None does not filter."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def linear_backoff(base: Column, attempt: Column) -> Column:
    return base * attempt


def capped_backoff(attempt: Column, most: float = 4.0) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(most))
