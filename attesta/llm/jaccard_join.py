"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of five-word shingles (64-bit hashes). All shingles follow one order, rarest
first by a fixed-size frequency sketch of the whole corpus. If two sets share at least T elements,
the first ``n - T + l`` elements of each share at least ``l``; so a document's prefix may be made
longer if correspondingly more shared elements are then asked for. Each document picks its ``l`` by
estimated candidate cost, and a pair has to share the smaller of its two.

The join returns components, not pairs: identical sets are one node before any join. Posting lists
of much the same documents are gathered, cut into blocks of a bounded size, and every two blocks of
a gathering meet in one task, which compares two documents only while no verified links join them
already. So no pair is ever a row, and no link between different components is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import BLANK, chunks, find_words, mix, shingles
from .components import components
from .shared import in_arrow, materialise, ordered, read, slim
from .worker import release

WIDTH = 5
NUM, DEN = 75, 100  # link: DEN * |x & y| >= NUM * |x | y|
LEAST, MORE = 20, 10  # l is a twentieth of the set, or a tenth where candidates are estimated to be dear
SKETCH_BITS = 23  # the sketch has this many cells at every size of input
_SEGMENTS = 1024
BLOCK = 1 << 17  # shingles of a block: 1 MB, so that a large gathering is many meetings
IDS_TO_BROADCAST = 2_000_000  # rows of ids, 16 to 80 MB; beyond it both sides are shuffled


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def frequency_classes(docs: DataFrame, bits: int = SKETCH_BITS, width: int = WIDTH) -> np.ndarray:
    """For each sketch cell, four times the binary logarithm of its shingle count over all documents.

    One byte a cell, ``2 ** bits`` cells whatever the input: this is what every task gets. Partial
    sketches meet segment by segment in a stream, so no task holds more than its segments.
    """
    part = 1 << bits - _SEGMENTS.bit_length() + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                np.add.at(total, _cells(shingles(find_words(data, at, BLANK), width)[0], bits), np.uint32(1))
        packed = [zlib.compress(total[i * part : (i + 1) * part].tobytes(), 1) for i in range(_SEGMENTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SEGMENTS), pa.int32()), pa.array(packed, pa.binary())], ["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
                sums[segment] = sums[segment] + counts if segment in sums else counts.astype(np.uint64)
        levels = [np.floor(4 * np.log2(v.astype(np.float64) + 1)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["segment", "levels"])

    rows = (
        slim(docs, "text").transform(in_arrow, count, "segment int, counts binary")
        .repartition("segment").transform(in_arrow, add, "segment int, levels binary").collect()
    )  # 2 ** bits bytes
    out = np.zeros(1 << bits, np.uint8)
    for r in rows:
        out[r["segment"] * part : (r["segment"] + 1) * part] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out


def least_overlap(n):
    """Smallest overlap that a set of n needs with any set it links to."""
    return -(-NUM * n // DEN)


def matches(n, share: int):
    return np.maximum(1, -(-n // share))


def choose_matches(frequency: np.ndarray, n: int, check: float = 4.0) -> int:
    """The l with the less estimated cost for a document whose ordered elements have these frequencies.

    Reading an element's postings costs its frequency. A candidate costs ``check`` postings, and
    of the candidates met about one in l shares l elements.
    """
    base = n - least_overlap(n)
    upto = np.cumsum(frequency)
    cost = {}
    for l in (int(matches(n, LEAST)), int(matches(n, MORE))):
        met = upto[min(base + l, n) - 1]
        cost[l] = met + check * (met - base - l) * n / l
    return min(cost, key=lambda l: (cost[l], l))


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(batch: pa.RecordBatch, text: int, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of the batch."""
    for row, end, data, at in chunks(batch.column(text)):
        found, of = shingles(find_words(data, at, BLANK), width)
        first = np.searchsorted(of, np.arange(end - row + 1))
        for i in range(end - row):
            yield row + i, np.unique(found[first[i] : first[i + 1]])


def _noise(levels: np.ndarray) -> float:
    return 2.0 ** (float(np.median(levels)) / 4) - 1


def _prefix(s: np.ndarray, levels: np.ndarray, noise: float) -> tuple[np.ndarray, int]:
    """Places of the first ``n - T + l`` elements of a sorted set in order of rarity (ties in order of hash), and l."""
    n = len(s)
    c = levels[_cells(s, len(levels).bit_length() - 1)]
    order = np.argsort(c, kind="stable")
    l = choose_matches(np.maximum(2.0 ** (c[order] / 4.0) - 1 - noise, 1.0), n)
    return order[: min(n, n - least_overlap(n) + l)], l


def signatures(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, the prefix in order, and l.

    Only the first of identical sets in a task carries its prefix; the others are known by fingerprint.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(levels)  # 2 ** bits bytes
    noise = _noise(levels)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        level = held.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0)
            n_, hi, lo, prefix, match = [], [], [], [], []
            named = ids.is_valid().to_pylist()
            for row, s in _sets(batch, 1):
                n = len(s)
                a, b = int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                n_.append(n)
                hi.append(a)
                lo.append(b)
                if not n or not named[row] or (a, b) in seen:
                    prefix.append(None)
                    match.append(0)
                    continue
                seen.add((a, b))
                p, l = _prefix(s, level, noise)
                prefix.append(_unsigned(s[p]))
                match.append(l)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_, pa.int32()), pa.array(_unsigned(np.array(hi, np.uint64))), pa.array(_unsigned(np.array(lo, np.uint64))), pa.array(prefix, pa.list_(pa.int64())), pa.array(match, pa.int32())],
                ["doc_id", "n_shingles", "hi", "lo", "prefix", "matches"],
            )

    return slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").transform(in_arrow,
        sign, "doc_id long, n_shingles int, hi long, lo long, prefix array<long>, matches int"
    )


def _full_sets(docs: DataFrame, wanted: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, packed sorted shingle set, a bit for each that is in the prefix, and l of the documents in ``wanted`` (distinct ids)."""
    held = docs.sparkSession.sparkContext.broadcast(levels)
    noise = _noise(levels)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            packed, prefixes, ls = [], [], []
            for _, s in _sets(batch, 1):
                prefix, l = _prefix(s, held.value, noise)
                inside = np.zeros(len(s), bool)
                inside[prefix] = True
                packed.append(s.tobytes())
                prefixes.append(np.packbits(inside).tobytes())
                ls.append(l)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(ls, pa.int32())], ["doc_id", "shingles", "prefix", "l"])

    wanted = F.broadcast(wanted) if wanted.count() <= IDS_TO_BROADCAST else wanted
    text = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return text.join(wanted, "doc_id", "left_semi").transform(in_arrow, pack, "doc_id long, shingles binary, prefix binary, l int")


def _worthwhile(buckets: DataFrame) -> DataFrame:
    """Without documents whose shared elements are too few for any partner.

    A partner has at least NUM / DEN of the document's size, so the pair's l is at least that share of
    the document's own least l.
    """
    held = F.count("*").over(Window.partitionBy("doc_id"))
    return buckets.withColumn("held", held).filter(DEN * LEAST * F.col("held") >= NUM * F.col("n")).drop("held")


def _mixed(lists: DataFrame) -> DataFrame:
    """Only lists that hold two documents."""
    w = Window.partitionBy("token")
    return lists.withColumn("low", F.min("doc_id").over(w)).withColumn("high", F.max("doc_id").over(w)).filter("low != high").drop("low", "high")


def _neighbourhoods(lists: DataFrame) -> DataFrame:
    """(hood, doc_id, n): documents of every list that holds two, under the list's document of least hash.

    Lists of much the same documents fall together, and two documents of a list share a hood.
    """
    first = F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("hood"))).over(Window.partitionBy("token"))
    return _mixed(lists.withColumn("first", first)).select("first.hood", "doc_id", "n").distinct()


def _block_pairs(hoods: DataFrame) -> DataFrame:
    """(hood, i, j, block, doc_id): hoods cut into blocks of about ``BLOCK`` shingles, each two of which meet once."""
    size = hoods.groupBy("hood").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = hoods.join(size, "hood").withColumn("block", F.pmod(F.xxhash64("doc_id", "hood"), F.col("blocks")).cast("int"))
    met = dealt.select("hood", "doc_id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select("hood", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id")


class _Meeting:
    """Documents that meet: finds verified links that join all that belong together, without comparing what is joined."""

    def __init__(self, ids: list[int], blocks: np.ndarray, sets: list[np.ndarray], prefixes: list[np.ndarray], l: np.ndarray):
        self.ids, self.blocks, self.l = ids, blocks, l
        self.n = np.array([len(x) for x in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)
        self.all, self.at = number[1], np.r_[0, np.cumsum(self.n)]
        self.first = np.searchsorted(number[0], np.concatenate(prefixes))
        self.first_at = np.r_[0, np.cumsum([len(x) for x in prefixes])]
        self.mark = np.zeros(len(number[0]), bool)
        self.label = np.arange(len(ids))

    def _overlaps(self, a: int, others: np.ndarray, elements: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Shared elements of document ``a`` with each of ``others``."""
        own = elements[at[a] : at[a + 1]]
        self.mark[own] = True
        length = at[others + 1] - at[others]
        begin = np.cumsum(length) - length
        place = np.repeat(at[others] - begin, length) + np.arange(length.sum())
        hit = np.r_[0, np.cumsum(self.mark[elements[place]])]
        self.mark[own] = False
        return hit[begin + length] - hit[begin]

    def links(self) -> Iterator[tuple[int, int]]:
        two = self.blocks.min() != self.blocks.max()
        for a in range(len(self.ids)):
            if two and self.blocks[a] != self.blocks[0]:
                continue
            others = np.arange(len(self.ids)) if two else np.arange(a + 1, len(self.ids))
            if two:
                others = others[self.blocks[others] != self.blocks[a]]
            small, large = np.minimum(self.n[others], self.n[a]), np.maximum(self.n[others], self.n[a])
            others = others[(self.label[others] != self.label[a]) & (NUM * large <= DEN * small)]
            if len(others):
                others = others[self._overlaps(a, others, self.first, self.first_at) >= np.minimum(self.l[others], self.l[a])]
            if len(others):
                both = self._overlaps(a, others, self.all, self.at)
                for b in others[DEN * both >= NUM * (self.n[a] + self.n[others] - both)]:
                    if self.label[b] != self.label[a]:
                        self.label[self.label == self.label[b]] = self.label[a]
                        yield self.ids[a], self.ids[b]


def _meet(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all linked documents of every two blocks that meet."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, rows = None, []

        def close() -> pa.RecordBatch:
            found = []
            if len(rows) > 1:
                ids, blocks, s, p, l = zip(*rows, strict=True)
                found = list(_Meeting(list(ids), np.array(blocks), list(s), list(p), np.array(l)).links())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            hood, i, j, block, doc, l = (batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 7))
            for r in range(batch.num_rows):
                if (hood[r], i[r], j[r]) != key:
                    yield close()
                    key, rows = (hood[r], i[r], j[r]), []
                s = np.frombuffer(batch.column(5)[r].as_buffer(), np.uint64).copy()
                inside = np.unpackbits(np.frombuffer(batch.column(6)[r].as_buffer(), np.uint8), count=len(s)).astype(bool)
                rows.append((doc[r], block[r], s, s[inside], l[r]))
        yield close()

    pairs = F.broadcast(pairs) if pairs.count() <= IDS_TO_BROADCAST else pairs
    together = sets.join(pairs, "doc_id").select("hood", "i", "j", "block", "doc_id", "shingles", "prefix", "l")
    return together.repartition("hood", "i", "j").sortWithinPartitions("hood", "i", "j", "doc_id").transform(in_arrow, compare, "a long, b long").filter("a != b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    ``docs`` needs doc_id and text; other columns are ignored. A null or blank text has no shingles
    and is its own component; a text of fewer than five words is one shingle. Rows that share a
    doc_id are one node: links of any of them count, and each gets a row. A null doc_id is compared
    with exact copies only. An empty table gives an empty result.
    """
    levels = frequency_classes(docs)
    signs = materialise(signatures(docs, levels), "signatures")
    known = signs.filter("n_shingles > 0")
    groups = materialise(
        known.groupBy("hi", "lo", "n_shingles").agg(
            F.min(F.when(F.col("prefix").isNotNull(), F.col("doc_id"))).alias("rep"), F.min("doc_id").alias("low")
        ),
        "groups",
    )
    carrying = known.filter("prefix is not null and doc_id is not null")
    extra = carrying.select("doc_id", "hi", "lo").join(groups.select("hi", "lo", "rep"), ["hi", "lo"]).filter("doc_id != rep").select("doc_id", "hi", "lo")
    extra = materialise(extra, "extra")
    reps = carrying.join(F.broadcast(extra) if extra.count() <= IDS_TO_BROADCAST else extra, ["doc_id", "hi", "lo"], "left_anti")

    lists = reps.select(F.explode("prefix").alias("token"), "doc_id", F.col("n_shingles").alias("n"))
    lists = materialise(_mixed(lists), "lists")
    hoods = materialise(_neighbourhoods(_worthwhile(lists)), "hoods")
    sets = materialise(_full_sets(docs, hoods.select("doc_id").distinct(), levels), "sets")
    links = materialise(_meet(_block_pairs(hoods), sets), "links")
    roots = materialise(components(links), "roots")

    lows = (
        groups.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .withColumn("root", F.coalesce("root", "rep"))
    )
    least = lows.groupBy("root").agg(F.min("low").alias("component"))
    named = lows.join(least, "root", "left").select("hi", "lo", F.coalesce("component", "low").alias("component"))
    return (
        signs.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
        .select("doc_id", F.col("n_shingles").cast("long"), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """(node, row) of the rows with an id, one of those that repeat an id and its text: the first by the JSON of all columns. Nodes are in the order of ids."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.filter("doc_id is not null").select("doc_id", F.md5("text").alias("mark"), row.alias("row"))
    least = materialise(keyed.groupBy("doc_id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row")), "distinct")
    node = ordered(least.select("doc_id", "mark"), F.col("doc_id"), F.col("mark")).select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), F.col("place").alias("node"))
    return materialise(least.join(node, (F.col("doc_id") == F.col("id")) & F.col("mark").eqNullSafe(F.col("m"))).select("node", "row"), "numbered")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates of a smaller id.

    A row goes only for a link to another text or for an equal row: rows that repeat an id and its text leave one, rows of
    one id with different texts are documents of their own, which the order of their texts' hashes numbers. Documents
    without words or without an id all stay. Which row is left never depends on chance.
    """
    rows, ids = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    numbered = _numbered(docs) if rows != ids else None
    found = materialise(near_duplicates(docs if numbered is None else numbered.select(F.col("node").alias("doc_id"), "row.text")), "components")
    kept = found.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id")
    kept = F.broadcast(kept) if kept.count() <= IDS_TO_BROADCAST else kept
    if numbered is None:
        named = docs.join(kept, "doc_id", "left_semi")
    else:
        named = numbered.join(kept.withColumnRenamed("doc_id", "node"), "node", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    unnamed = docs.filter("doc_id is null")
    return named.unionByName(unnamed) if unnamed.limit(1).count() else named


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 75 * (na.n + nb.n - x)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS m FROM r GROUP BY 1) USING (doc_id)
"""
