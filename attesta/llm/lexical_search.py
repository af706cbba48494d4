"""Ranked lexical search over posting lists in geometric blocks.

Documents are vectors of integer impacts, queries vectors of integer weights; a score is their inner product. A shard
holds some thousand documents and, for each term, the posting list of those that have it. A list is clustered by
the similarity of its documents: each goes to the nearest of a few of the list's documents, by random projections. A
block of a cluster has a summary, the largest impact of each term in any of its documents, so a query's product
with the summary bounds the score of every document in it. A query takes its lists by falling impact; it skips a block
only if the block's bound is below the k-th best score, and stops once the lists that are left cannot reach it together.
Everything else is scored in full, so results are exact.

A first pass over one document in ``SEEDS`` gives every query a k-th score that holds for all; the second pass, over all documents,
starts from it. Queries are worked off in batches of ``BATCH_WORDS`` words, for whose terms alone the documents are
indexed: what a task is sent has a bound however many queries there are. The documents' vectors are written once a batch and never
shuffled; a shard's index is made by the task that searches it, from the vectors it reads, and a lost executor costs its shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import ALNUM, chunks, find_words
from .shared import in_arrow, materialise, read, slim
from .worker import release

K = 10
BATCH_WORDS = 500_000  # words of the items of a batch
SHARD = 4096  # documents of a shard
SEEDS = 16
SMALL = 128  # a list of so few documents is not blocked: each is scored
_SKETCH = 32
_BITS = 20


def _block_size(n: int) -> int:
    """Documents of a block of a list of ``n``: a summary has most of the terms of a shard once a block has some hundred documents, so few blocks are kept."""
    return max(SMALL, 16 * math.isqrt(n))


class Terms:
    """A batch's terms by hash, and its queries: their terms' numbers and counts."""

    def __init__(self, queries: list[np.ndarray]):
        self.keys = np.unique(np.concatenate(queries)) if queries else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.queries = [np.unique(np.searchsorted(self.keys, q), return_counts=True) for q in queries]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of the batch's terms, and the number of each."""
        at = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[term] == hashes[at]
        return at[same], term[same]


def _lists(parts: list[np.ndarray], ends: np.ndarray) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.astype(np.int32)))


def vectors(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents that have any term: their number of terms, and those of the batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row, end, data, at in chunks(batch.column(1)):
                w = find_words(data, at, ALNUM)
                n = np.diff(w.first)
                place, term = terms.find(w.hashes)
                doc = np.searchsorted(w.first, place, "right") - 1
                code, times = np.unique(doc * len(terms.keys) + term, return_counts=True)
                own, number = np.divmod(code, max(1, len(terms.keys)))
                ends = np.searchsorted(own, np.arange(len(n)), "right")
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(n.astype(np.int64)), _lists([number], ends), _lists([times], ends)], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, count, "doc_id long, n long, terms array<int>, counts array<int>")


class Corpus:
    """What scores need of all documents: N, L, and the weight of every term of the batch."""

    def __init__(self, held: DataFrame, terms: Terms):
        size = len(terms.keys)

        def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(size, np.int64)
            for batch in batches:
                df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
            term = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

        self.n, self.length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.df = np.zeros(size, np.int64)
        for r in held.select("terms").transform(in_arrow, holding, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the batch's terms
            self.df[r["term"]] = r["df"]
        self.weight = np.array([math.floor(1000 * math.log((2 * self.n + 2) / (2 * int(x) + 1))) for x in self.df], np.int64)

    def impacts(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Impacts of terms that occur ``counts`` times in documents of ``n`` terms."""
        kind = object if 75 * int(n.max(initial=0)) * self.n >= 1 << 62 else np.int64
        m = (25 + (75 * n.astype(kind) * self.n) // max(1, self.length)).astype(np.int64)
        return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


class Shard:
    """An index of some documents.

    Document i has ``term[first[i]:first[i + 1]]`` (numbers in ``terms``) with its ``impact``; term t's list is ``posting[list_first[t]:list_first[t + 1]]``,
    with ``most``, its largest impact, and its blocks ``blocks[t]:blocks[t + 1]``: block b begins at ``block_first[b]`` of ``posting`` and has the
    summary ``summary_first[b]:summary_first[b + 1]`` of ``summary_term`` and ``summary``.
    """

    @staticmethod
    def build(ids: np.ndarray, known: np.ndarray, first: np.ndarray, term: np.ndarray, impact: np.ndarray, weight: np.ndarray) -> Shard:
        out = Shard()
        out.ids, out.known, out.first, out.impact = ids, known, first, impact.astype(np.int32)
        out.terms, local = np.unique(term, return_inverse=True)
        out.term = local.astype(np.int32)
        n, width = len(ids), len(out.terms)
        doc = np.repeat(np.arange(n), np.diff(first))
        order = np.argsort(out.term, kind="stable")
        out.posting = doc[order].astype(np.int32)
        out.list_first = np.searchsorted(out.term[order], np.arange(width + 1))
        out.most = np.maximum.reduceat(out.impact[order], out.list_first[:-1]) if width else np.zeros(0, np.int32)
        near = out._sketch(weight[out.terms], doc)
        block_first, blocks, summaries = [], [0], []
        for t in range(width):
            begin, end = out.list_first[t], out.list_first[t + 1]
            if end - begin > SMALL:
                cuts = out._cluster(begin, end, near)
                block_first += (begin + cuts[:-1]).tolist()
                summaries += out._summaries(out.posting[begin:end], cuts, width)
            blocks.append(len(block_first))
        out.block_first, out.blocks = np.array([*block_first, len(out.posting)], np.int64), np.array(blocks, np.int64)
        out.summary_first = np.cumsum([0, *[len(s[0]) for s in summaries]])
        out.summary_term = np.concatenate([s[0] for s in summaries]) if summaries else np.zeros(0, np.uint16)
        out.summary = np.concatenate([s[1] for s in summaries]) if summaries else np.zeros(0, np.int32)
        return out

    def _sketch(self, weight: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Unit random projections of the documents' weighted vectors."""
        signs = np.random.default_rng(11).integers(0, 2, (_SKETCH, len(weight)), np.int8) * 2 - 1
        value = self.impact * weight[self.term].astype(np.float64)
        out = np.stack([np.bincount(doc, value * s[self.term], len(self.ids)) for s in signs], axis=1).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def _cluster(self, begin: int, end: int, near: np.ndarray) -> np.ndarray:
        """Puts the list in an order of clusters; the places in it where blocks begin, and its length."""
        own, size = self.posting[begin:end], _block_size(end - begin)
        pivots = own[np.linspace(0, len(own) - 1, -(-len(own) // size)).astype(np.int64)]
        cluster = np.argmax(near[own] @ near[pivots].T, axis=1)
        order = np.argsort(cluster, kind="stable")
        self.posting[begin:end], cluster = own[order], cluster[order]
        starts = np.flatnonzero(np.r_[True, np.diff(cluster) != 0])
        place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
        return np.r_[np.flatnonzero(place % size == 0), len(own)]

    def _entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' entries one after another, and where each document's begin."""
        length = self.first[docs + 1] - self.first[docs]
        begin = np.cumsum(length) - length
        return np.arange(length.sum()) + np.repeat(self.first[docs] - begin, length), begin

    def _summaries(self, docs: np.ndarray, cuts: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        kind, out = np.uint16 if width <= 1 << 16 else np.int32, []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            at, _ = self._entries(docs[x:y])
            row = np.zeros(width, np.int32)
            np.maximum.at(row, self.term[at], self.impact[at])
            term = np.flatnonzero(row)
            out.append((term.astype(kind), row[term]))
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of a query with a score of ``reach`` or more, and above 0: documents and scores, ties by id."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        own, gain = at[here], weights[here] * self.most[at[here]]
        order = np.argsort(-gain, kind="stable")
        own, gain = own[order], gain[order]
        query = np.zeros(len(self.terms), np.int64)
        query[own] = weights[here][order]
        left = query.copy()  # without the lists that are done: their documents are settled
        open_ = np.ones(len(self.ids), bool)
        found, scores, reach = np.zeros(0, np.int64), np.zeros(0, np.int64), max(1, reach)
        for i, t in enumerate(own):
            if gain[i:].sum() < reach:
                break
            begin, end = self.blocks[t], self.blocks[t + 1]
            if begin == end:
                docs = self.posting[self.list_first[t] : self.list_first[t + 1]]
            else:
                a, b = self.summary_first[begin], self.summary_first[end]
                bound = np.add.reduceat(left[self.summary_term[a:b]] * self.summary[a:b], self.summary_first[begin:end] - a)
                stops = np.r_[self.block_first[begin + 1 : end], self.list_first[t + 1]]
                docs = [self.posting[x:y] for x, y in zip(self.block_first[begin:end][bound >= reach], stops[bound >= reach], strict=True)]
                docs = np.concatenate(docs) if docs else np.zeros(0, np.int32)
            left[t] = 0
            docs = docs[open_[docs]]
            if not len(docs):
                continue
            open_[docs] = False
            place, starts = self._entries(docs)
            score = np.add.reduceat(query[self.term[place]] * self.impact[place], starts)
            good = score >= reach
            found, scores = np.r_[found, docs[good]], np.r_[scores, score[good]]
            if len(scores) > k:
                found, scores = self._first(found, scores, k)
            if len(scores) == k:
                reach = max(reach, int(scores.min()))
        return self._first(found, scores, k)

    def _first(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[docs], ~self.known[docs], -scores))[:k]
        return docs[order], scores[order]


def _shards(batches: Iterator[pa.RecordBatch], corpus: Corpus, size: int) -> Iterator[Shard]:
    """Shards of the documents of ``vectors``, ``size`` each but for a task's last one."""
    kept: list[pa.RecordBatch] = []

    def build() -> Shard:
        t = pa.Table.from_batches(kept).combine_chunks()
        kept.clear()
        ids, term, counts = (t.column(c).combine_chunks() for c in ("doc_id", "terms", "counts"))
        first = term.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        impact = corpus.impacts(counts.flatten().to_numpy().astype(np.int64), np.repeat(t.column("n").to_numpy(), np.diff(first)))
        return Shard.build(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), first, term.flatten().to_numpy(), impact, corpus.weight)

    for batch in batches:
        while len(batch):
            part = batch.slice(0, size - sum(map(len, kept)))
            kept.append(part)
            batch = batch.slice(len(part))
            if sum(map(len, kept)) == size:
                yield build()
    if kept:
        yield build()


def _search(held: DataFrame, terms: Terms, corpus: Corpus, k: int, reach: dict[int, int], size: int) -> DataFrame:
    """(query, doc_id, score, rank): the k best documents of ``held`` for each query, of ``reach`` or more."""
    own = held.filter(F.size("terms") > 0)
    shards = max(1, -(-own.count() // size))
    if shards < own.select("n").rdd.getNumPartitions():
        own = own.coalesce(shards)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for shard in _shards(batches, corpus, size):
            query, ids, known, scores = [], [], [], []
            for q, (own, times) in enumerate(terms.queries):
                docs, score = shard.best(own, times * corpus.weight[own], k, reach.get(q, 0))
                query.append(np.full(len(docs), q))
                ids.append(shard.ids[docs])
                known.append(shard.known[docs])
                scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate(ids), mask=~np.concatenate(known)), pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = own.transform(in_arrow, search, "query long, doc_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _batches(items: DataFrame) -> Iterator[list]:
    """The items with a term, batch by batch, as rows (item_id, words); equal items count once."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, at in chunks(batch.column(1)):
                w = find_words(data, at, ALNUM)
                own = [np.sort(w.hashes[w.first[i] : w.first[i + 1]]) for i in range(end - row)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())], ["item_id", "words", "n"])

    rows = materialise(items.select(F.col("item_id").cast("string"), "text").transform(in_arrow, hashed, "item_id string, words binary, n long"), "items").filter("n > 0").distinct()
    total = rows.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // BATCH_WORDS))
    for b in range(count):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(count)) == b).orderBy("item_id", "words").select("item_id", "words").collect()  # one batch
        if own:
            yield own


def search(items: DataFrame, docs: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) of each item (item_id, text), scores above 0, ties to the smaller doc_id.

    Terms are runs of ASCII letters and digits and of everything above ASCII, A-Z folded, of whole texts; they are compared as 64-bit hashes.
    Null and empty texts have no terms: such documents are not counted and such items have no rows, as is so for all with an empty table.
    Rows of documents that repeat an id are documents of their own; those without an id rank after equals with one. Equal
    items count once; items of one id with different words are ranked each by itself. Other columns are not read.
    """
    spark = docs.sparkSession
    out = None
    for rows in _batches(items):
        terms = Terms([np.frombuffer(bytes(r[1]), np.uint64) for r in rows])
        held = materialise(vectors(docs, terms), "vectors")
        corpus = Corpus(held, terms)
        seeds = held.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SEEDS)) == 0)
        last = _search(seeds, terms, corpus, k, {}, shard).filter(F.col("rank") == k)
        reach = {r["query"]: r["score"] for r in last.select("query", "score").collect()}  # one for each query of the batch
        best = materialise(_search(held, terms, corpus, k, reach, shard), "best")
        names = spark.createDataFrame([(q, r[0]) for q, r in enumerate(rows)], "query long, item_id string")
        own = best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # the batch's items
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    found = search(items, slim(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))


_TERMS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), i AS (SELECT item_id, {_TERMS} AS t FROM benchmark),
c AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS term FROM i) GROUP BY ALL),
p AS (SELECT doc_id, len AS n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {K}
"""
