"""Column profiles, trends, distributions and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluation import order_statistics

DIGITS = 6
MOMENT_DIGITS = 4


def profile(df: DataFrame) -> DataFrame:
    """(column, non_null, distinct_values, least, most, total, mean, deviation) of every column; moments of numeric ones only. One pass.

    Total, mean and deviation have ``MOMENT_DIGITS`` places: sums of doubles depend on the order of rows in their last digits.
    """
    own, names = [], []
    for c in df.schema:
        names.append((c.name, isinstance(c.dataType, T.NumericType)))
        x = F.col(f"`{c.name}`")
        number = x.cast("double") if names[-1][1] else F.lit(None).cast("double")
        own.append(F.struct(
            F.lit(c.name).alias("column"), F.count(x).alias("non_null"), F.count_distinct(x.cast("string")).alias("distinct_values"),
            F.min(number).alias("least"), F.max(number).alias("most"), F.round(F.sum(number), MOMENT_DIGITS).alias("total"), F.round(F.avg(number), MOMENT_DIGITS).alias("mean"), F.round(F.stddev_samp(number), MOMENT_DIGITS).alias("deviation"),
        ))
    return df.agg(F.array(*own).alias("p")).select(F.inline("p"))


def trend(series: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """First, last, change, change in percent and mean step growth in percent of each series; steps from 0 are left out."""
    w = Window.partitionBy(*by).orderBy(time)
    before = F.lag(value).over(w)
    steps = series.withColumn("growth", F.when(before != 0, (F.col(value) - before) / before * 100))
    out = steps.groupBy(*by).agg(F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"), F.count("*").alias("points"), F.avg("growth").alias("growth"))
    change = F.col("last") - F.col("first")
    return out.select(
        *by, "points", F.round("first", 2).alias("first"), F.round("last", 2).alias("last"), F.round(change, 2).alias("change"),
        F.round(F.when(F.col("first") != 0, change / F.col("first") * 100), 4).alias("change_percent"), F.round("growth", 4).alias("mean_growth"),
    )


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, range, mean, sum, median, deviation and values above mean plus two deviations, for each group."""
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.sum(value).alias("total"),
        F.stddev_samp(value).alias("deviation"),
    )
    middle = {"_a": (0.5, F.floor((F.col("n") + 1) / 2)), "_b": (0.5, F.floor(F.col("n") / 2) + 1)}
    stats = stats.join(order_statistics(df, by, value, middle).select(*by, ((F.col("_a") + F.col("_b")) / 2).alias("median")), by)
    above = df.join(stats.select(*by, "mean", "deviation"), by).groupBy(*by).agg(F.count_if(F.col(value) > F.col("mean") + 2 * F.col("deviation")).alias("outliers"))
    return stats.join(above, by).select(*by, "n", "least", "most", F.round("mean", 4).alias("mean"), F.round("total", 2).alias("total"), F.round("median", 4).alias("median"), F.round("deviation", 4).alias("deviation"), "outliers")


def comparison(df: DataFrame, category: str, value: str) -> DataFrame:
    """Sum, mean, count, share and place of each category, and the chart that suits their number."""
    own = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), category)
    return own.select(
        category, F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "n", F.round(F.col("total") / F.sum("total").over(every), DIGITS).alias("share"),
        F.row_number().over(order).cast("long").alias("place"), F.when(F.count("*").over(every) <= 6, "pie").otherwise("bar").alias("chart"),
    )


def chart(df: DataFrame, kind: str, x: str, y: str, series: str | None = None) -> DataFrame:
    """(series, payload): the points of each series in order of x as the JSON of a line, bar, pie or scatter chart."""
    name = F.coalesce(F.col(series).cast("string"), F.lit("")) if series else F.lit("")
    points = F.transform(F.array_sort(F.collect_list(F.struct(F.col(x).cast("string").alias("x"), F.col(y).cast("double").alias("y")))), lambda p: p)
    return df.groupBy(name.alias("series")).agg(points.alias("p")).select("series", F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("series").alias("name"), F.col("p").alias("points"))).alias("payload"))


def text_facts(texts: DataFrame) -> DataFrame:
    """(text_id, year, value, percent) that a free text states, the first of each."""
    pick = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return texts.select("text_id", pick(r"((?:19|20)\d{2})").cast("int").alias("year"), pick(r"(\d+(?:\.\d+)?)\s*(?:亿|万|元|million|billion)").cast("double").alias("value"), pick(r"(\d+(?:\.\d+)?)\s*%").cast("double").alias("percent"))


def text_statistics(texts: DataFrame, words: list[str], top: int = 5) -> DataFrame:
    """(kind, name, count, mean, least, most) over all texts (text): amounts with a unit, percentages, and the ``top`` most frequent of ``words``."""
    amounts = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?:元|万|亿|人民币|美元)"), 1)).alias("v")).select(F.lit("number").alias("kind"), F.replace("v", F.lit(","), F.lit("")).cast("double").alias("v"))
    shares = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)\s*%"), 1)).alias("v")).select(F.lit("percent").alias("kind"), F.col("v").cast("double").alias("v"))
    numbers = amounts.unionByName(shares).groupBy("kind").agg(F.count("*").alias("count"), F.bround(F.avg("v"), 2).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    held = texts.select(F.explode(F.array(*[F.struct(F.lit(w).alias("name"), F.floor((F.length("text") - F.length(F.replace(F.lower("text"), F.lit(w.lower()), F.lit("")))) / len(w)).alias("n")) for w in words])).alias("x"))
    counts = held.groupBy(F.col("x.name").alias("name")).agg(F.sum("x.n").alias("count")).filter("count > 0").orderBy(F.desc("count"), "name").limit(top)
    none = F.lit(None).cast("double")
    return numbers.select("kind", F.lit("").alias("name"), "count", "mean", "least", "most").unionByName(counts.select(F.lit("keyword").alias("kind"), "name", "count", none.alias("mean"), none.alias("least"), none.alias("most")))


def samples(df: DataFrame, column: str, order: list, most: int = 5) -> DataFrame:
    """(value): the first values of a column, in the order given, that are not null."""
    return df.filter(F.col(column).isNotNull()).orderBy(*order).limit(most).select(F.col(column).cast("string").alias("value"))
