"""A stored inverted index with block maxima, and top-k search over it by coverage or BM25.

The index is written once: a row for each term and block of ``BLOCK`` consecutive chunk ids, with the block's postings and its largest BM25
part, in files that are sorted by term, so that a batch of queries reads the row groups of its terms. A second table has a row a term
with its number of chunks. A search never cuts chunks into terms. It takes queries in batches; the lists of a batch's terms are read once and
meet in groups of ``GROUP`` neighbouring blocks. There each block's maxima, added over a query's terms, bound the scores in it;
blocks are taken from the largest bound on, and one that cannot reach a query's k-th best score is skipped for it, its
postings never added up. Results are exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch, settle, small_batches
from .lexical import B, K1, SCORE_DIGITS, coverage_topk, lowered, query_terms, tokens
from .lexical import bm25_topk as bm25_scan

BLOCK = 256  # chunk ids of a block
GROUP = 4  # blocks that a task adds up together
QUERIES = 1024  # queries of a batch
_SLACK = 1e-6
_CELLS = 1 << 22  # parts that are added up at once
_TOKENS = 1 << 21  # tokens that are counted at once
_SPAN = 64  # blocks whose counts a term's row may have; a frequent term is as many rows as it has spans
_COUNTED = "term string, span long, first long, tokens long, postings binary"
_POSTING = np.dtype([("chunk", "<i8"), ("tf", "<i4"), ("dl", "<i4")])  # packed, as Spark hands on arrays value by value
_LISTS = "term string, block long, chunks array<long>, parts array<double>, most double"


class Index:
    """``lists``: term, block, most, chunks, parts (arrays of equal lengths); ``lexicon``: term, df; parts are without the inverse document frequency."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.lists, self.lexicon = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/lexicon")
        self.chunks, self.k1, self.b = spark.read.parquet(f"{path}/corpus").select("chunks", "k1", "b").first()


def _lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """The values in lists that begin at the places ``first``."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), pa.array(values))


def _counted(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_COUNTED`` of rows (chunk_id, text): the postings of each term and ``span`` chunk ids, of some batches' tokens at a time."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column("chunk_id").to_numpy(), *tokens(batch.column("text"))))
        size += len(held[-1][2])
        if size >= _TOKENS:
            yield from _spans(held, span)
            held, size = [], 0
    yield from _spans(held, span)


def _spans(held: list[tuple[np.ndarray, pa.Array, np.ndarray]], span: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_COUNTED`` of batches' chunk ids, tokens and the tokens' rows."""
    if not sum(len(row) for *_, row in held):
        return
    ids, coded = np.concatenate([x for x, *_ in held]), pa.concat_arrays([x for _, x, _ in held]).dictionary_encode()
    before = np.cumsum([0, *(len(x) for x, *_ in held)])
    row = np.concatenate([x + n for (*_, x), n in zip(held, before[:-1], strict=True)])
    order, n = np.argsort(ids, kind="stable"), len(ids)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ids, dl = ids[order], np.bincount(row, minlength=n)[order]
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + place[row], return_counts=True)
    term, chunk = key // n, key % n
    of = ids[chunk] // span
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of[1:] != of[:-1])))
    postings = np.empty(len(key), _POSTING)
    postings["chunk"], postings["tf"], postings["dl"] = ids[chunk], tf, dl[chunk]
    at = np.append(first, len(key)) * _POSTING.itemsize
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(postings.view(np.uint8))])
    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[first])), pa.array(of[first]), pa.array(ids[chunk[first]]), pa.array(np.add.reduceat(tf, first)), packed], ["term", "span", "first", "tokens", "postings"])


def _whole(table: pa.Table, mean: float, k1: float, b: float, block: int) -> pa.RecordBatch:
    """Rows of ``_LISTS`` of rows of ``_COUNTED`` in order of term and span."""
    t = table.combine_chunks()
    term = t.column("term").combine_chunks()
    new = np.append(True, pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False))
    packed = pc.cast(t.column("postings").combine_chunks(), pa.large_binary())
    at = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    of = np.repeat(np.cumsum(new) - 1, np.diff(at) // _POSTING.itemsize)
    postings = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]].view(_POSTING)
    ids, tf, dl = (np.ascontiguousarray(postings[c]) for c in ("chunk", "tf", "dl"))
    if ((of[1:] == of[:-1]) & (ids[1:] <= ids[:-1])).any():
        order = np.lexsort((dl, ids, of))
        of, ids, tf, dl = of[order], ids[order], tf[order], dl[order]
        one = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (ids[1:] != ids[:-1]) | (dl[1:] != dl[:-1])))
        of, ids, tf, dl = of[one], ids[one], np.add.reduceat(tf, one), dl[one]
    blocks = ids // block
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (blocks[1:] != blocks[:-1])))
    parts = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
    names = term.take(pa.array(np.flatnonzero(new)[of[first]]))
    return pa.RecordBatch.from_arrays([names, pa.array(blocks[first]), _lists(ids, first), _lists(parts, first), pa.array(np.maximum.reduceat(parts, first))], ["term", "block", "chunks", "parts", "most"])


def _merged(batches: Iterator[pa.RecordBatch], mean: float, k1: float, b: float, block: int) -> Iterator[pa.RecordBatch]:
    """The same of a task's rows; those of the last term and span wait for the next ones."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        term, span = rows.column("term"), rows.column("span")
        last = pc.and_(pc.equal(term, term[-1]), pc.equal(span, span[-1])).to_numpy().argmax()
        if last:
            yield _whole(rows.slice(0, last), mean, k1, b, block)
        held = rows.slice(last)
    if held is not None:
        yield _whole(held, mean, k1, b, block)


def build(chunks: DataFrame, path: str | None = None, k1: float = K1, b: float = B, block: int = BLOCK) -> Index:
    """Writes the index of (chunk_id, content) to ``path``, by default to a new folder that the cluster shares.

    Null and empty contents have no terms but count as chunks; ids are whole numbers and not null. Tokens are counted in the task that cuts them, and
    one shuffle brings the counts of a term and ``_SPAN`` blocks together and sorts them; blocks are told apart after it. Rows that repeat a
    chunk_id with one length count as one chunk's text.
    """
    spark, path = chunks.sparkSession, path or scratch(chunks.sparkSession, "lexical-index")
    own = lowered(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "content"))
    raw = settle(own.mapInArrow(functools.partial(_counted, span=block * _SPAN), _COUNTED), "postings")
    n, total = chunks.count(), raw.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    mean = total / n if n else 0.0
    dealt = small_batches(raw.drop("tokens").repartition("term", "span").sortWithinPartitions("term", "first"))
    dealt.drop("first").mapInArrow(functools.partial(_merged, mean=mean, k1=k1, b=b, block=block), _LISTS).write.mode("overwrite").parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists")
    lists.groupBy("term").agg(F.sum(F.size("chunks")).alias("df")).write.mode("overwrite").parquet(f"{path}/lexicon")
    spark.createDataFrame([(n, float(k1), float(b))], "chunks long, k1 double, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    return Index(spark, path)


_known: dict[tuple, Index] = {}


def built_once(chunks: DataFrame) -> Index:
    """The index of chunks that are read from files: built at the first call of an application, opened after that."""
    key = (chunks.sparkSession.sparkContext.applicationId, tuple(sorted(chunks.inputFiles())))
    if key not in _known:
        _known[key] = build(chunks)
    return _known[key]


class _Batch:
    """The terms of a batch of queries, by name, and for each the queries that have it with their weights."""

    def __init__(self, rows: list, bm25: bool, chunks: int):
        self.ids = sorted({r["query_id"] for r in rows})
        self.terms = sorted({r["term"] for r in rows})
        term, query = {t: i for i, t in enumerate(self.terms)}, {q: i for i, q in enumerate(self.ids)}
        rows = sorted(rows, key=lambda r: term[r["term"]])
        self.first = np.searchsorted([term[r["term"]] for r in rows], np.arange(len(self.terms) + 1))
        self.query = np.array([query[r["query_id"]] for r in rows], np.int64)
        self.weight = np.array([np.log((chunks - r["df"] + 0.5) / (r["df"] + 0.5) + 1) if bm25 else 1.0 for r in rows])
        self.wanted = np.ones(len(self.ids))
        if not bm25:
            for r in rows:
                self.wanted[query[r["query_id"]]] = r["wanted"]

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows with a term each: row, query and weight of every query that has the row's term."""
        count = self.first[term + 1] - self.first[term]
        row = np.repeat(np.arange(len(term)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[term], count)
        return row, self.query[at], self.weight[at]


def _best(table: pa.Table, batch: _Batch, k: int, bm25: bool, least: float) -> pa.Table:
    """(query_id, chunk_id, score) of the k best chunks of a group of blocks for each query of the batch."""
    number = {t: i for i, t in enumerate(batch.terms)}
    term = np.array([number[t] for t in table.column("term").to_pylist()], np.int64)
    block, chunks, parts = table.column("block").to_numpy(), table.column("chunks").combine_chunks(), table.column("parts").combine_chunks()
    begin = chunks.offsets.to_numpy().astype(np.int64)
    begin, ids = begin - begin[0], chunks.flatten().to_numpy()
    values = parts.flatten().to_numpy() if bm25 else np.ones(len(ids))
    most = table.column("most").to_numpy() if bm25 else np.ones(len(term))
    names, at = np.unique(block, return_inverse=True)
    row, query, weight = batch.spread(term)
    bounds = np.bincount(at[row] * len(batch.ids) + query, weight * most[row], len(names) * len(batch.ids)).reshape(len(names), -1)
    reach = np.maximum(least * batch.wanted, 0.0 if bm25 else 1.0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for b in np.argsort(-bounds.max(axis=1), kind="stable"):
        alive = bounds[b] >= np.maximum(reach - _SLACK, 1e-12)
        own = np.flatnonzero(at == b)
        if not alive.any():
            break  # the blocks that are left have no larger bounds
        place = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in own])
        doc_ids, doc = np.unique(ids[place], return_inverse=True)
        of = np.repeat(term[own], begin[own + 1] - begin[own])
        score = np.zeros(len(doc_ids) * len(batch.ids))
        step = max(1, _CELLS // max(1, len(batch.ids)))
        for x in range(0, len(place), step):  # a term is in every query at most
            posting, query, weight = batch.spread(of[x : x + step])
            score += np.bincount(doc[x : x + step][posting] * len(batch.ids) + query, weight * values[place[x : x + step]][posting], len(score))
        score = np.round(score.reshape(len(doc_ids), -1) / batch.wanted, SCORE_DIGITS)
        docs, query = np.nonzero((score > 0) & (score >= np.round(least, SCORE_DIGITS)) & alive)
        q, c, s = (np.concatenate(x) for x in zip(found[0], (query, doc_ids[docs], score[docs, query]), strict=True))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        first = np.searchsorted(q, np.arange(len(batch.ids) + 1))
        kept = np.arange(len(q)) - first[q] < k
        full = np.flatnonzero(np.diff(first) >= k)
        reach[full] = np.maximum(reach[full], s[first[full] + k - 1] * batch.wanted[full])
        found = [(q[kept], c[kept], s[kept])]
    q, c, s = found[0]
    return pa.table({"query_id": pa.array(np.array(batch.ids, np.int64)[q]), "chunk_id": pa.array(c.astype(np.int64)), "score": pa.array(s)})


def _meeting(batch: _Batch, k: int, bm25: bool, least: float):
    return lambda table: _best(table, batch, k, bm25, least)


def search(index: Index, queries: DataFrame, k: int = 5, by: str = "bm25", least: float = 0.0, batch_size: int = QUERIES) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query (query_id, question), ties to the smaller id.

    ``by``: ``bm25``, or ``coverage``, the share of a query's terms that a chunk has, of ``least`` or more.
    """
    bm25, spark = by == "bm25", queries.sparkSession
    asked = settle(query_terms(queries).join(index.lexicon, "term"), "asked")
    batches = max(1, -(-asked.select("query_id").distinct().count() // batch_size))
    out = None
    for n in range(batches):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == n).collect()  # the terms of a batch
        if not rows:
            continue
        batch = _Batch(rows, bm25, index.chunks)
        named = spark.createDataFrame(pa.table({"term": pa.array(batch.terms, pa.string())}))
        lists = index.lists.join(F.broadcast(named), "term").withColumn("group", F.floor(F.col("block") / GROUP))  # the terms of a batch

        found = lists.groupBy("group").applyInArrow(_meeting(batch, k, bm25, least), "query_id long, chunk_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def candidates(queries: DataFrame, chunks: DataFrame, k: int, backend: str = "auto", index: Index | None = None, by: str = "bm25", least: float = 0.0) -> DataFrame:
    """The rows of ``search`` with the backend that gave them and why another one did not.

    ``index`` asks the stored index and fails without one, ``scan`` cuts the chunks into terms, ``auto`` takes the index
    where there is one.
    """
    if backend not in ("auto", "index", "scan"):
        raise ValueError(f"no such backend: {backend}")
    if backend == "index" and index is None:
        raise ValueError("the index backend needs an index")
    stored = index is not None and backend != "scan"
    found = search(index, queries, k, by, least) if stored else (bm25_scan(queries, chunks, k) if by == "bm25" else coverage_topk(queries, chunks, k, least))
    reason = "index_missing" if backend == "auto" and not stored else None
    return found.withColumns({"backend": F.lit("index" if stored else "scan"), "fallback_reason": F.lit(reason).cast("string")})
