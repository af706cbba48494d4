"""Toxicity by a linear-chain conditional random field.

Tokens are words; a chain is up to 64 consecutive words of a document. Labels of documents become
labels of tokens: an attribute of a word (the word itself or its first bytes) is a cue if it is far
more frequent in toxic than in other labelled documents, and a token of a toxic document is toxic
if it has a cue. The field learns these tags from the word, its beginnings and its neighbours; its
forward-backward marginals give every word of every document a probability. A document's score is
a calibrated function of the marginals alone, and runs of likely words are its offending spans.

Only fitting is on a sample: ``SAMPLE`` labelled documents at most, in order of a hash of their id
and one for each least shingle (so that copies do not vote), and ``CHAINS`` chains of each kind at
most, in order of a hash of what they hold. An id with labels that differ counts as toxic; of rows with
one least shingle the one with the smallest id and then text is kept: a fit is the same at every run.
Every document is scored from its whole text, in one pass and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, chunks, find_words, mix, shingles
from .linear import Logistic, sigmoid
from .shared import in_arrow, materialise, read, slim

CHAIN = 64
SAMPLE = 8000  # labelled documents that are fitted on, at most
CHAINS = 6000  # chains with a toxic token, and as many without
CUE_DOCS = 6  # toxic documents that an attribute must be in to be a cue
CUE_LIFT = 10.0  # times its share of other documents
FOLDS = 5
_PREFIXES = (4, 5, 6, 7)
_BUCKETS = 1 << 18
_TEMPLATES = 1 + len(_PREFIXES) + 2


def attributes(w: Words) -> np.ndarray:
    """Hashes of each word and of its beginnings, a row for each kind; 0: none."""
    return np.stack([w.hashes, *[w.prefixes[k] for k in _PREFIXES]])


def buckets(w: Words) -> np.ndarray:
    """Weight number of each template at each word: its attributes, and the words before and after it."""
    a = attributes(w)
    before, after = np.r_[np.uint64(0), w.hashes[:-1]], np.r_[w.hashes[1:], np.uint64(0)]
    edge = w.first[(w.first > 0) & (w.first < len(w.hashes))]
    before[edge], after[edge - 1] = 0, 0
    out = []
    for i, h in enumerate([*a, before, after]):
        b = (mix(h + np.uint64(i + 1)) & np.uint64(_BUCKETS - 1)).astype(np.int64)
        out.append(np.where(h == 0, _BUCKETS, b))  # the last weight stays 0
    return np.stack(out)


class Field:
    """Two tags; ``weights`` and ``start`` favour tag 1, ``move[i, j]`` is the step from tag i to j."""

    def __init__(self):
        self.weights, self.start, self.move = np.zeros(_BUCKETS + 1), 0.0, np.zeros((2, 2))

    def marginals(self, emission: np.ndarray, pairs: bool = False):
        """Probability of tag 1 at each place of chains of equal length (rows), by forward-backward.

        With ``pairs`` also the expected counts of the four steps and the log of each partition sum.
        """
        rows, n = emission.shape
        m = self.move
        # log odds of tag 1 against tag 0: forward includes the place's own emission, backward does not
        ahead, back = np.zeros((rows, n)), np.zeros((rows, n))
        ahead[:, 0] = self.start + emission[:, 0]
        for t in range(1, n):
            x = ahead[:, t - 1]
            ahead[:, t] = emission[:, t] + np.logaddexp(m[0, 1], m[1, 1] + x) - np.logaddexp(m[0, 0], m[1, 0] + x)
        for t in range(n - 2, -1, -1):
            x = back[:, t + 1] + emission[:, t + 1]
            back[:, t] = np.logaddexp(m[1, 0], m[1, 1] + x) - np.logaddexp(m[0, 0], m[0, 1] + x)
        p = sigmoid(ahead + back)
        if not pairs:
            return p
        steps = np.zeros((2, 2))
        if n > 1:
            x, y = ahead[:, :-1], back[:, 1:] + emission[:, 1:]
            table = np.stack([np.full_like(x, m[0, 0]), m[0, 1] + y, m[1, 0] + x, m[1, 1] + x + y])
            table -= table.max(axis=0)
            e = np.exp(table)
            steps = (e / e.sum(axis=0)).sum(axis=(1, 2)).reshape(2, 2)
        return p, steps

    def fit(self, features: list[np.ndarray], tags: list[np.ndarray], epochs: int = 12, rate: float = 0.3, penalty: float = 1e-4) -> Field:
        """Gradient ascent on the conditional likelihood, chains of equal length together, steps scaled by past gradients."""
        by: dict[int, list[int]] = {}
        for i, t in enumerate(tags):
            by.setdefault(len(t), []).append(i)
        order = np.random.default_rng(7)
        groups = [g[i : i + 256] for _, g in sorted(by.items()) for i in range(0, len(g), 256)]
        seen_w, seen_m, seen_s = np.full(_BUCKETS + 1, 1e-2), np.full((2, 2), 1e-2), 1e-2
        for _ in range(epochs):
            for k in order.permutation(len(groups)):
                f = np.stack([features[i] for i in groups[k]])  # rows, templates, places
                y = np.stack([tags[i] for i in groups[k]]).astype(np.float64)
                p, steps = self.marginals(self.weights[f].sum(axis=1), pairs=True)
                miss = (y - p)[:, None, :]
                g = np.bincount(f.ravel(), weights=np.broadcast_to(miss, f.shape).ravel(), minlength=_BUCKETS + 1)
                g -= penalty * len(f) * self.weights
                g[_BUCKETS] = 0
                seen_w += g * g
                self.weights += rate * g / np.sqrt(seen_w)
                counted = np.zeros((2, 2))
                np.add.at(counted, (y[:, :-1].astype(int), y[:, 1:].astype(int)), 1)
                gm, gs = counted - steps, float((y[:, 0] - p[:, 0]).sum())
                seen_m, seen_s = seen_m + gm * gm, seen_s + gs * gs
                self.move += rate * gm / np.sqrt(seen_m)
                self.start += rate * gs / np.sqrt(seen_s)
        return self

    def tag(self, w: Words) -> np.ndarray:
        """Probability of tag 1 of every word."""
        n = len(w.hashes)
        if not n:
            return np.zeros(0)
        emission = self.weights[buckets(w)].sum(axis=0)
        starts, lengths = cut_chains(w.first)
        out = np.zeros(n)
        for length in np.unique(lengths):
            own = starts[lengths == length]
            at = own[:, None] + np.arange(length)
            out[at] = self.marginals(emission[at])
        return out


def cut_chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of every chain of the texts with words ``first[i]:first[i + 1]``."""
    counts = np.diff(first)
    many = -(-counts // CHAIN)
    text = np.repeat(np.arange(len(counts)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    starts = first[:-1][text] + place * CHAIN
    return starts, np.minimum(CHAIN, first[1:][text] - starts)


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: log odds that any word is toxic, log of the expected number of toxic words, log of their share."""
    clipped = np.clip(p, 0, 1 - 1e-9)
    upto = np.r_[0, np.cumsum(np.log1p(-clipped))]
    none = np.minimum(upto[first[1:]] - upto[first[:-1]], -1e-9)
    sums = np.r_[0, np.cumsum(p)]
    expected = sums[first[1:]] - sums[first[:-1]]
    some = np.log(-np.expm1(none)) - none
    return np.c_[np.clip(some, -20, 20), np.log1p(expected), np.log((expected + 0.01) / (np.diff(first) + 20))]


def _words(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    for row, end, data, at in chunks(column):
        yield row, end, find_words(data, at, ALNUM, _PREFIXES), data, at


def held_out(doc_id):
    """Whether a document is in the fold that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """(label, text): at most ``SAMPLE`` labelled documents outside the held-out fold, one for each least shingle."""
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    )

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, w, _, _ in _words(batch.column(2)):
                found, of = shingles(w, 5)
                out = np.zeros(end - row, np.uint64)
                out[:] = np.iinfo(np.uint64).max
                np.minimum.at(out, of, found)
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out.view(np.int64)), part.column(2)], ["id", "label", "least", "text"])

    text = docs.select(F.col("doc_id").alias("id"), "text")
    marked = text.join(F.broadcast(known), "id").select("id", "label", "text").transform(in_arrow, least, "id long, label int, least long, text string")
    return materialise(marked.groupBy("least").agg(F.min(F.struct("id", "text", "label")).alias("m")).select("m.id", "m.label", "m.text"), "toxic-sample")


def _cues(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the attributes that mark toxic documents."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy()
            for row, end, w, _, _ in _words(batch.column(1)):
                a = attributes(w)
                text = np.repeat(np.arange(end - row), np.diff(w.first))
                seen = np.unique(np.stack([np.tile(text, len(a)).astype(np.uint64), a.ravel()]), axis=1) if a.size else np.zeros((2, 0), np.uint64)
                seen = seen[:, seen[1] != 0]
                toxic = labels[row + seen[0].astype(np.int64)] == 1
                kinds, at = np.unique(seen[1], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds.view(np.int64)), pa.array(np.bincount(at, weights=toxic, minlength=len(kinds)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(kinds)))], ["kind", "toxic", "all"]
                )

    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = total.get(1, 0), total.get(0, 0)
    counts = sample.select("label", "text").transform(in_arrow, own, "kind long, toxic long, all long").groupBy("kind").agg(F.sum("toxic").alias("t"), F.sum("all").alias("a"))
    found = counts.filter((F.col("t") >= CUE_DOCS) & (F.col("t") * other >= CUE_LIFT * (F.col("a") - F.col("t") + 0.5) * toxic)).select("kind").collect()
    return np.unique(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _training_chains(sample: DataFrame, cues: np.ndarray) -> tuple[list, list]:
    """Templates and tags of at most ``CHAINS`` chains with a toxic token and as many without."""

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy()
            for row, end, w, _, _ in _words(batch.column(1)):
                text = np.repeat(np.arange(end - row), np.diff(w.first))
                tags = np.isin(attributes(w), cues).any(axis=0) & (labels[row + text] == 1)
                b = buckets(w).astype(np.int32)
                starts, lengths = cut_chains(w.first)
                some = [tags[s : s + n].any() for s, n in zip(starts, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.bool_()), pa.array([b[:, s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)], pa.binary()), pa.array([tags[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)], pa.binary())],
                    ["some", "features", "tags"],
                )

    rows = sample.select("label", "text").transform(in_arrow, chains, "some boolean, features binary, tags binary")
    rows = materialise(rows, "toxic-chains")
    of = lambda kind: rows.filter(F.col("some") == kind).orderBy(F.xxhash64("features"), "features", "tags").limit(CHAINS).select("features", "tags")
    held = [r for kind in (True, False) for r in of(kind).collect()]  # 2 * CHAINS at most
    return [np.frombuffer(bytes(r[0]), np.int32).reshape(_TEMPLATES, -1) for r in held], [np.frombuffer(bytes(r[1]), bool) for r in held]


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> tuple[Field, Logistic] | None:
    """The field and the calibration, or None where the labels outside the held-out fold are not of two classes."""
    sample = _sample(docs, labels, target)
    if sample.select("label").distinct().count() < 2:
        return None
    field = Field()
    features, tags = _training_chains(sample, _cues(sample))
    field.fit(features, tags)
    held = docs.sparkSession.sparkContext.broadcast(field)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, w, _, _ in _words(batch.column(1)):
                x = document_features(held.value.tag(w), w.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array([v.tobytes() for v in x], pa.binary())], ["label", "x"])

    rows = sample.select("label", "text").transform(in_arrow, describe, "label int, x binary").toPandas()
    x = np.array([np.frombuffer(v) for v in rows["x"]])
    order = np.lexsort(x.T)
    return field, Logistic(0.1).fit(x[order], rows["label"].to_numpy()[order])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and spans (start and end in code points) of toxic words.

    A null or empty text has no words and gets the score of no toxic word. Rows are scored one by one,
    so repeated rows score alike. Without labels of both classes every score is 0. An empty table
    gives an empty result. Only the text is an input of a score.
    """
    fitted = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(fitted)  # 2 MB of weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, w, data, at in _words(batch.column(1)):
                n = end - row
                if held.value is None:
                    p, s = np.zeros(len(w.hashes)), np.zeros(n)
                else:
                    field, model = held.value
                    p = field.tag(w)
                    s = sigmoid(model.logit(document_features(p, w.first)))
                toxic = np.flatnonzero(p >= 0.5)
                spans: list[list[dict]] = [[] for _ in range(n)]
                if len(toxic):
                    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                    of = np.searchsorted(w.first, toxic, "right") - 1
                    joins = (np.diff(toxic) == 1) & (np.diff(of) == 0)
                    begins, stops = toxic[np.r_[True, ~joins]], toxic[np.r_[~joins, True]]
                    for b, e, i in zip(begins, stops, of[np.r_[True, ~joins]], strict=True):
                        base = chars[at[i]]
                        spans[i].append({"start": int(chars[w.starts[b]] - base), "end": int(chars[w.ends[e]] - base)})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    ["doc_id", "score", "predicted", "spans"],
                )

    rows = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    judged = rows.transform(in_arrow, judge, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(slim(read(spark, sf_dir, "documents"), "doc_id", "text"), read(spark, sf_dir, "labels"))
