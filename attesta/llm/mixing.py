"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source has a target of words: its share by weight, at most ``REPEATS`` times what it holds; what is over is shared
again by weight. The mix is a row of slots. Slot t has the golden-ratio point frac(t / phi), in 31-bit integers, which
falls into one source's interval of the cumulative targets, so that every stretch of the mix has each source near its share. A slot's rank is
its number among its source's slots. On the other side a source's documents are shuffled by a hash, once for each
time that it is gone through, laid end to end and cut into blocks of ``BLOCK`` words; slot and block of one rank meet in a join.
The last block of a source ends at its target; ranks that the points of the schedule leave over take their even places.

Ranks and places are prefix sums in two steps, within a run of slots or a range of hashes and then over the runs, so
that a source of any share of the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import carried, materialise, ordered, read, slim

WEIGHTS = (3.0, 1.0, 2.0)  # of the sources by code point, repeating
SHARE = 1.5  # of all words: the mix
REPEATS = 2  # times that a document is taken at most
BLOCK = 256  # words
SEED = 12
SOURCES_TO_BROADCAST = 100_000  # sources, under 100 bytes each; beyond it they are joined in a shuffle, salted
_WORD = r"[^\x20\x09-\x0D]+"
_POINTS = 1 << 31
_GOLDEN = 1327217885  # 2^31 / phi, made odd: its multiples go through all points
_RUN = 1 << 12  # slots that are ranked together
_RANGE = 2048  # documents of a source that are laid out together, about
_SALT = 64


def words(text: Column) -> Column:
    """The number of words between ASCII white space; 0 of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _to_source(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """``rows`` (source, ...) with the columns of their source."""
    of = sources.withColumnRenamed("source", "of")
    if count <= SOURCES_TO_BROADCAST:
        return rows.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    salted = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    return rows.withColumn("own", F.pmod(F.monotonically_increasing_id(), F.lit(_SALT)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt"))).drop("of", "own", "salt")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, place, weight, source_size, target, low, high) of the sources (source, source_size).

    The level is what a weight of one gets. It rises from round to round, as what sources cannot take is shared again, until no
    further source is full; a round is one sum over the sources. low and high bound a source's points.
    """
    by_place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    held = materialise(ordered(sizes, F.col("source").asc_nulls_last()).withColumn("weight", by_place).withColumn("most", F.col("source_size") * F.lit(float(repeats))), "sources")
    whole = (held.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        over = F.col("most") < level * F.col("weight")
        n, taken, weight = held.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not weight:
            break
        level, full = max(0.0, (whole - taken) / weight), n
    target = F.least("most", F.lit(level) * F.col("weight"))
    order = Window.partitionBy("part").orderBy("place")
    cut = held.withColumn("target", target).withColumn("end", F.sum("target").over(order))
    cut = carried(cut, "end", F.col("target"))
    total = cut.agg(F.sum("target")).first()[0] or 1.0
    point = lambda c: F.least(F.lit(_POINTS), F.floor(c / total * _POINTS)).cast("long")
    last = F.col("end") >= total * (1 - 1e-12)
    return cut.select("source", "place", "weight", "source_size", "target", point(F.greatest(F.lit(0.0), F.col("end") - F.col("target"))).alias("low"), F.when(last, F.lit(_POINTS)).otherwise(point(F.col("end"))).alias("high"))


def _schedule(spark: SparkSession, sources: DataFrame, count: int, slots: int) -> DataFrame:
    """(place, rank, slot): every block that the mix takes of the sources (place, blocks, low, high), and the slot that it is at."""
    bits = min(31, max(4, count.bit_length() + 2))
    cells = sources.filter("high > low").select("place", "low", "high", "blocks", F.explode(F.sequence(F.shiftright("low", 31 - bits), F.shiftright(F.col("high") - 1, 31 - bits))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") % _POINTS) * _GOLDEN, F.lit(_POINTS)).alias("point")).withColumn("cell", F.shiftright("point", 31 - bits))
    cells = F.broadcast(cells) if count <= SOURCES_TO_BROADCAST else cells
    hit = points.join(cells, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "place", "blocks", F.floor(F.col("slot") / _RUN).alias("run"))
    runs = hit.groupBy("place", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("place", "run", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1
    ranked = hit.withColumn("within", within).join(starts, ["place", "run"]).select("place", (F.col("before") + F.col("within")).alias("rank"), "slot", "blocks").filter("rank < blocks").drop("blocks")
    given = runs.groupBy("place").agg(F.sum("n").alias("given"))
    short = sources.select("place", "blocks").join(given, "place", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("given < blocks")
    missing = short.select("place", "blocks", F.explode(F.sequence("given", F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(missing.select("place", "rank", F.floor((F.col("rank") + 0.5) / F.col("blocks") * slots).alias("slot")))


class Mix:
    """A mix: ``units`` (unit, source, doc_id, size, mark, copies: like rows of documents), ``sources``, and ``pieces`` (slot, place, rank, epoch,
    unit, copy, first, last: words first to last, from 0 and without the last, of a copy of a unit), in the order of slot, place, rank, start."""

    def __init__(self, units: DataFrame, sources: DataFrame, pieces: DataFrame, count: int):
        self.units, self.sources, self.pieces, self.count = units, sources, pieces, count

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken of every row of documents."""
        rows = self.units.select("unit", "source", "doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        got = self.pieces.groupBy("unit", "copy").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
        out = _to_source(rows.join(got, ["unit", "copy"], "left"), self.sources.select("source", "source_size", "target"), self.count)
        return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """(slot, place, rank, source, text) of every block of the mix; ``docs`` are the documents that it was made of. A block's words are joined by single spaces."""
        lists = self.pieces.groupBy("unit", "copy").agg(F.collect_list(F.struct("slot", "place", "rank", "start", "first", "last")).alias("p"))
        whole = docs.select("source", "doc_id", "text", F.xxhash64("text").alias("mark")).filter("text is not null").dropDuplicates(["source", "doc_id", "mark"])
        same = lambda c: F.col(f"u.{c}").eqNullSafe(F.col(f"d.{c}"))
        keyed = self.units.filter("size > 0").alias("u").join(whole.alias("d"), same("source") & same("doc_id") & same("mark")).select("unit", "u.source", F.regexp_extract_all("text", F.lit(_WORD), 0).alias("words"))
        cut = lists.join(keyed, "unit").select("source", "words", F.explode("p").alias("p")).select("source", "p.*", F.slice("words", (F.col("p.first") + 1).cast("int"), (F.col("p.last") - F.col("p.first")).cast("int")).alias("words"))
        blocks = cut.groupBy("slot", "place", "rank", "source").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("parts"))  # of BLOCK words at most
        return blocks.select("slot", "place", "rank", "source", F.array_join(F.flatten(F.transform("parts", lambda p: p["words"])), " ").alias("text"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED) -> Mix:
    """The mix of ``docs`` (doc_id, source, text): ``share`` times all their words, of every source its target to the word.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last one; null ids are ids like others.
    Like rows are laid out one after another and each counts; which of them is taken more often is not told apart. A source without words has
    the target 0, and a table without words an empty mix. Other columns are not read. A very long text is cut over as
    many blocks as it fills. A document is taken ``repeats`` times at most, and as often as its source's target asks for, give or take one.
    """
    spark = docs.sparkSession
    rows = docs.select("source", "doc_id", words(F.col("text")).alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"), F.pmod(F.monotonically_increasing_id(), F.lit(_SALT)).alias("salt"))
    units = materialise(rows.groupBy("source", "doc_id", "size", "mark", "salt").agg(F.count("*").alias("copies")).drop("salt").withColumn("unit", F.monotonically_increasing_id()), "units")
    targets = materialise(source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, repeats), "targets")
    most = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * repeats)
    sources = targets.withColumn("take", most).withColumn("blocks", F.ceil(F.col("take") / block).cast("long"))
    count, slots = sources.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    schedule = _schedule(spark, sources.select("place", "blocks", "low", "high"), count, slots)

    bits = max(0, (units.count() // _RANGE).bit_length())
    own = sources.filter("take > 0").select("source", "place", "take", F.ceil(F.col("take") / F.col("source_size")).cast("int").alias("epochs"))
    laid = _to_source(units.filter("size > 0"), own, count)
    laid = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    hashed = F.xxhash64("doc_id", "mark", "epoch", F.lit(seed))
    laid = laid.withColumn("h", hashed).withColumn("range", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")).withColumn("held", F.col("size") * F.col("copies"))
    ranges = laid.groupBy("place", "epoch", "range").agg(F.sum("held").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("place").orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("place", "epoch", "range", before.alias("before"))
    order = Window.partitionBy("place", "epoch", "range").orderBy("h", "doc_id", "mark", "size", "unit")
    at = laid.withColumn("end", F.sum("held").over(order)).join(starts, ["place", "epoch", "range"])
    at = at.withColumn("begin", F.col("before") + F.col("end") - F.col("held")).filter("begin < take")
    copies = at.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("begin") + F.col("copy") * F.col("size")).filter("start < take")
    stop = F.least(F.col("start") + F.col("size"), F.col("take"))
    blocks = copies.withColumn("stop", stop).withColumn("rank", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}"))))
    pieces = blocks.select(
        "place", "rank", "epoch", "unit", "copy", "start",
        (F.greatest("start", F.col("rank") * block) - F.col("start")).alias("first"), (F.least("stop", (F.col("rank") + 1) * block) - F.col("start")).alias("last"),
    )
    return Mix(units, sources, schedule.join(pieces, ["place", "rank"]), count)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = slim(read(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken")


def op12_source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of the mix: the sources' sizes and targets, and that what is taken is the target to the word."""
    got = mix(slim(read(spark, sf_dir, "documents"), "doc_id", "source", "text")).taken()
    return got.groupBy("source").agg(F.count("*").alias("documents"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), F.sum("taken").alias("taken"), F.count_if(F.col("taken") > REPEATS * F.col("size")).alias("over"))


OP12_TARGETS_SQL = rf"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, count(*) AS documents, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {REPEATS} * source_size AS most, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INTEGER] AS weight FROM s),
f AS (SELECT *, sum(most) OVER o - most AS full_before, sum(weight) OVER () - (sum(weight) OVER o - weight) AS weight_left
      FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM (SELECT most / weight AS ratio, ({SHARE} * (SELECT sum(source_size) FROM s) - full_before) / weight_left AS level FROM f) WHERE ratio >= level),
t AS (SELECT source, documents, source_size, least(most, level * weight)::DOUBLE AS target FROM w, l)
SELECT source, documents, source_size, round(target, 3) AS target, floor(target + 0.5)::BIGINT AS taken, 0::BIGINT AS over FROM t
"""
