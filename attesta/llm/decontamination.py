"""Benchmark decontamination as a prefix-filtered containment join.

Every benchmark item is cut into windows of 13 consecutive words (an item of fewer words is one
window). A window's elements are its shingles of up to three words; their order is rarity over the
whole corpus. Containment of a whole window asks for every element, so the necessary prefix is its
single rarest one: documents are joined with windows on that element only, candidates must fit
into the document by place and length, and each is then compared word by word over the window.

The benchmark is worked off in blocks of ``BLOCK_WORDS`` words, so what a task is sent has a fixed
bound however large the benchmark is. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, chunks, find_words, mix, runs
from .shared import in_arrow, materialise, read, slim
from .worker import release

WINDOW = 13
SHINGLE = 3
BLOCK_WORDS = 500_000  # benchmark words a block: about 30 MB in a task
STRETCH = 10_000  # windows of an item that stay together
_STEP = 1 << 20  # candidates compared at once
_BITS = 20


class _Filter:
    """Membership of hashes in a sorted array: a bit table first, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of members, and the key number of each."""
        at = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


class Windows:
    """Distinct windows of a block of items: words, start and length in them, and the items of each."""

    def __init__(self, ids: list[str | None], texts: list[np.ndarray]):
        keep = [i for i, t in enumerate(texts) if len(t)]
        self.words = np.concatenate([texts[i] for i in keep]) if keep else np.zeros(0, np.uint64)
        start, length, item, seen = [], [], [], {}
        at = 0
        for i in keep:
            n = len(texts[i])
            size = min(n, WINDOW)
            for j in range(n - size + 1):
                content = self.words[at + j : at + j + size].tobytes()
                w = seen.setdefault(content, len(seen))
                if w == len(start):
                    start.append(at + j)
                    length.append(size)
                    item.append(set())
                if ids[i] is not None:
                    item[w].add(ids[i])
            at += n
        self.start, self.length = np.array(start, np.int64), np.array(length, np.int64)
        self.items = [sorted(x) for x in item]
        self.sizes = sorted({min(int(x), SHINGLE) for x in length})

    def elements(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose elements have ``size`` words: window, place in it, and hash of every element."""
        own = np.flatnonzero(np.minimum(self.length, SHINGLE) == size)
        count = self.length[own] - size + 1
        window = np.repeat(own, count)
        place = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        all_ = Words(self.words, np.array([0, len(self.words)]), None, None)
        hashes, _ = runs(all_, size)  # an element never leaves its item, so hashes across items are not read
        return window, place, hashes[self.start[window] + place] if len(window) else np.zeros(0, np.uint64)


def _column_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for row, end, data, at in chunks(column):
        yield row, end, find_words(data, at, ALNUM)


def _blocks(benchmark: DataFrame) -> list[Windows]:
    """The benchmark's windows, block by block, of about ``BLOCK_WORDS`` words each: repeated rows count once, long items are cut into stretches."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, w in _column_words(batch.column(1)):
                item, parts = [], []
                for i in range(end - row):
                    own = w.hashes[w.first[i] : w.first[i + 1]]
                    for at in range(0, max(len(own) - WINDOW + 1, min(len(own), 1)), STRETCH):  # a long item in stretches that share all but one word of a window
                        item.append(row + i)
                        parts.append(own[at : at + STRETCH + WINDOW - 1].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item, pa.int64())), pa.array(parts, pa.binary()), pa.array([len(x) // 8 for x in parts], pa.int64())], ["item_id", "words", "n"])

    spark = benchmark.sparkSession
    hashed = materialise(
        benchmark.select(F.col("item_id").cast("string"), "text").transform(in_arrow, words, "item_id string, words binary, n long"), "benchmark"
    ).filter("n > 0").distinct()
    total = hashed.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // BLOCK_WORDS))
    for b in range(count):
        rows = hashed.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(count)) == b).select("item_id", "words").collect()  # one block
        yield spark, Windows([r[0] for r in rows], [np.frombuffer(bytes(r[1]), np.uint64) for r in rows])


def _rarity(docs: DataFrame, windows: Windows) -> dict[int, np.ndarray]:
    """How often every element of the block occurs in all documents, by element size."""
    keys = {size: np.unique(windows.elements(size)[2]) for size in windows.sizes}
    held = docs.sparkSession.sparkContext.broadcast(keys)  # a block at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        probes = {size: _Filter(k) for size, k in held.value.items()}
        total = {size: np.zeros(len(k), np.int64) for size, k in held.value.items()}
        for batch in batches:
            for _, _, w in _column_words(batch.column(0)):
                for size, probe in probes.items():
                    _, key = probe.find(runs(w, size)[0])
                    total[size] += np.bincount(key, minlength=len(probe.keys))
        for size, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["size", "key", "n"])

    found = slim(docs, "text").transform(in_arrow, count, "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n")).collect()
    out = {size: np.zeros(len(k), np.int64) for size, k in keys.items()}
    for r in found:
        out[r["size"]][r["key"]] = r["n"]
    return {size: (keys[size], out[size]) for size in keys}


def _prefixes(windows: Windows, rarity: dict) -> dict[int, tuple]:
    """By element size: prefix elements in order, and for each its run of (window, place of the element in it)."""
    out = {}
    for size in windows.sizes:
        window, place, element = windows.elements(size)
        keys, n = rarity[size]
        order = np.lexsort((place, element, n[np.searchsorted(keys, element)], window))
        first = order[np.r_[True, window[order][1:] != window[order][:-1]]]  # the rarest of each window
        by = first[np.argsort(element[first], kind="stable")]
        elements, begin = np.unique(element[by], return_index=True)
        out[size] = elements, np.r_[begin, len(by)], window[by], place[by]
    return out


def _occurrences(w: Words, windows: Windows, prefixes: dict, probes: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window within one text of ``w``."""
    counts = np.diff(w.first)
    text_end = np.repeat(w.first[1:], counts)
    text_begin = np.repeat(w.first[:-1], counts)
    starts, which = [], []
    for size, (_, begin, window, place) in prefixes.items():
        hashes, at = runs(w, size)
        hit, key = probes[size].find(hashes)
        many = begin[key + 1] - begin[key]
        upto = np.cumsum(many)
        i = 0
        while i < len(hit):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _STEP, "right")))
            m, k = many[i:j], key[i:j]
            slot = np.repeat(begin[k] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            where = np.repeat(at[hit[i:j]], m)
            start, win = where - place[slot], window[slot]
            fits = (start >= text_begin[where]) & (start + windows.length[win] <= text_end[where])
            start, win = start[fits], win[fits]
            for o in range(WINDOW):
                if not len(start):
                    break
                in_window = o < windows.length[win]
                same = ~in_window
                same[in_window] = w.hashes[start[in_window] + o] == windows.words[windows.start[win[in_window]] + o]
                start, win = start[same], win[same]
            starts.append(start)
            which.append(win)
            i = j
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(which)


def mark(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns ``carry``, or else of all), n_words, n_hit, items (ids with an occurring window, sorted), contaminated.

    A word is hit if it lies inside any occurrence of a window; a document is contaminated if at
    least one word in twenty is hit. Null and empty texts have no words and are never contaminated;
    items without words have no windows; items with a null id hit words but are not listed. Rows are
    judged one by one, so repeated rows and repeated ids keep their own results. An empty benchmark
    marks nothing; an empty document table gives an empty result.
    """
    carry = carry or docs.columns
    own = "text" not in carry  # else the text is in the row already
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *(["text"] if own else [])).withColumns(
        {"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "hit": F.lit(None).cast("binary")}
    )
    schema = rows.schema
    for number, (spark, windows) in enumerate(_blocks(benchmark)):
        if number:
            rows = materialise(rows, "marked")
        prefixes = _prefixes(windows, _rarity(docs, windows))
        held = spark.sparkContext.broadcast((windows, prefixes))  # a block at most

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            release()
            windows, prefixes = held.value
            probes = {size: _Filter(p[0]) for size, p in prefixes.items()}
            for batch in batches:
                whole = batch.column("row")
                for row, end, w in _column_words(batch.column("text") if own else whole.field(whole.type.get_field_index("text"))):
                    part = batch.slice(row, end - row)
                    start, win = _occurrences(w, windows, prefixes, probes)
                    n = len(w.hashes)
                    edge = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(start + windows.length[win], minlength=n + 1)[: n + 1]
                    inside = np.cumsum(edge)[:n] > 0
                    before, items = part.column("hit"), part.column("items").to_pylist()
                    for i in range(end - row):
                        if before[i].is_valid:
                            span = slice(w.first[i], w.first[i + 1])
                            inside[span] |= np.unpackbits(np.frombuffer(before[i].as_buffer(), np.uint8), count=span.stop - span.start).astype(bool)
                    upto = np.r_[0, np.cumsum(inside)]
                    n_hit = upto[w.first[1:]] - upto[w.first[:-1]]
                    of = np.searchsorted(w.first, start, "right") - 1
                    for i, v in set(zip(of.tolist(), win.tolist(), strict=True)):
                        items[i] = [*items[i], *windows.items[v]]
                    bits = [np.packbits(inside[w.first[i] : w.first[i + 1]]).tobytes() if n_hit[i] else None for i in range(end - row)]
                    new = {"n_words": pa.array(np.diff(w.first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), "hit": pa.array(bits, pa.binary())}
                    yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in batch.schema.names], batch.schema.names)

        rows = rows.transform(in_arrow, scan, schema)
    return rows.select("row", "n_words", "n_hit", F.array_sort("items").alias("items")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return mark(docs, benchmark).filter(~F.col("contaminated")).select("row.*")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = slim(read(spark, sf_dir, "documents"), "doc_id", "text")
    return mark(docs, read(spark, sf_dir, "benchmark"), ["doc_id"]).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda j: array_to_string(w[j:j + least(len(w), {WINDOW}) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size),
h AS (SELECT doc_id, pos, i.size, item_id FROM (SELECT doc_id, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS s FROM p) q JOIN i ON i.s = q.s AND i.size = q.size),
k AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM h GROUP BY 1),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(items, []) AS items FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id))
SELECT doc_id, n_words, n_hit, len(items)::BIGINT AS n_items, sha256(array_to_string(items, ',')) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM c
"""
