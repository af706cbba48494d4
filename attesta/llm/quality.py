"""Quality classifier by co-training.

A document has two views: its text content (what its words, characters and lines are and how they repeat)
and its page metadata (the table's source, language and declared size; nothing of the text). A classifier for
each view starts from the labelled rows. In each round both judge every unlabelled document, and the
texts that a view is surest of become training rows of the other. Both views are calibrated on
labelled rows that the calibrated fit has not learned from, fold by fold, and a document's score combines the two.

Only fitting is on a sample: ``LABELLED`` labelled rows at most, in order of a hash of their id. The texts that
views hand over are taken from all documents, each distinct text once, ``HANDED`` of a class in a round. Every
document is scored from its whole text, in one pass and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import BLANK, chunks, find_words
from .linear import Logistic, sigmoid
from .shared import in_arrow, materialise, read, slim
from .worker import release

LABELLED = 6000  # labelled rows that are fitted on, at most
ROUNDS = 3
SURE = 0.95
HANDED = 200  # texts of a class that a view hands over in a round: the surest of all that are sure
FOLDS = 5  # of the labelled rows, for calibration
KEEP_FROM = 0.5
_WORDS, _SOURCES, _LANGS = 256, 64, 16

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True
_stop = np.zeros(256, bool)
_stop[[*b".,;:'\"()-"]] = True
_symbol = ~(_letter | _digit | _blank | _stop)
_symbol[:32] = False


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.r_[0, np.cumsum(flags)]
    return (upto[first[1:]] - upto[first[:-1]]).astype(np.float64)


def _name_buckets(names: list[str | None], size: int) -> np.ndarray:
    out = np.zeros((len(names), size), np.float32)
    for i, name in enumerate(names):
        data = (name or "").encode()
        out[i, int.from_bytes(data[-8:].rjust(8, b"\0"), "little") % 4294967291 % size] = 1
    return out


def features(column: pa.Array, sources: list, langs: list, sizes: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their text-content and page-metadata features."""
    for row, end, data, at in chunks(column):
        n = end - row
        w = find_words(data, at, BLANK)
        first = w.first
        count = np.diff(first).astype(np.float64)
        some = np.maximum(count, 1)
        text = np.repeat(np.arange(n), np.diff(first))
        letters, uppers = np.r_[0, np.cumsum(_letter[data])], np.r_[0, np.cumsum(_upper[data])]
        n_letters = letters[w.ends] - letters[w.starts]
        n_upper = uppers[w.ends] - uppers[w.starts]
        size = (w.ends - w.starts).astype(np.float64)
        share = lambda flags: _sums(flags, first) / some

        def back(k: int) -> np.ndarray:
            same = np.zeros(len(w.hashes), bool)
            same[k:] = (w.hashes[k:] == w.hashes[:-k]) & (text[k:] == text[:-k])
            return same

        kinds = np.unique((text.astype(np.uint64) << np.uint64(40)) | (w.hashes >> np.uint64(24)))
        distinct = np.bincount((kinds >> np.uint64(40)).astype(np.int64), minlength=n) / some
        last = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
        words = np.bincount(text * _WORDS + (w.hashes & np.uint64(_WORDS - 1)).astype(np.int64), minlength=n * _WORDS).reshape(n, _WORDS) / some[:, None]
        total = np.maximum(np.diff(at), 1).astype(np.float64)
        of = lambda table: _sums(table[data], at) / total
        lines = _sums(data == 10, at) + 1
        content = np.c_[
            np.log1p(count), _sums(size, first) / some, share(size == 1), share(n_letters == 0), share(_symbol[last]),
            share((n_upper == n_letters) & (n_letters > 1)), share(back(1) if len(w.hashes) > 1 else np.zeros(len(w.hashes), bool)),
            share(back(2) | back(3) if len(w.hashes) > 3 else np.zeros(len(w.hashes), bool)), distinct, distinct * np.log1p(count),
            np.log1p(np.diff(at)), np.log1p(lines), np.log1p(total / lines), of(_letter), of(_upper), of(_digit), of(_blank), of(_stop), of(_symbol),
            _sums(data >= 128, at) / total, _sums(data == 46, at) / lines, words,
        ]
        known = np.array([x is not None for x in sizes[row:end]])
        declared = np.array([max(x or 0, 0) for x in sizes[row:end]], np.float64)
        page = np.c_[known, np.log1p(declared), np.log1p(declared) ** 2, _name_buckets(sources[row:end], _SOURCES), _name_buckets(langs[row:end], _LANGS)]
        yield row, end, content.astype(np.float32), page.astype(np.float32)


def _column(docs: DataFrame, name: str, kind: str = "string"):
    return (F.col(f"`{name}`").try_cast(kind) if name in docs.columns else F.lit(None).cast(kind)).alias(name)


def _metadata(docs: DataFrame) -> list:
    return [_column(docs, "source"), _column(docs, "lang"), _column(docs, "n_chars", "double")]


def _described(docs: DataFrame) -> DataFrame:
    """(id, same, a, b) of every document: a hash of its text, and both views as 32-bit floats."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row, end, a, b in features(batch.column(2), *(batch.column(c).to_pylist() for c in (3, 4, 5))):
                part = batch.slice(row, end - row)
                views = [pa.array([x.tobytes() for x in v], pa.binary()) for v in (a, b)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *views], ["id", "same", "a", "b"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("same"), "text", *_metadata(docs))
    return materialise(rows.transform(in_arrow, pack, "id long, same long, a binary, b binary"), "views")


def _matrices(rows: list) -> list[np.ndarray]:
    """Both views of rows (a, b, …) of a bounded number."""
    return [np.array([np.frombuffer(bytes(r[c]), np.float32) for r in rows], np.float64) for c in ("a", "b")]


def _surest(views: DataFrame, known: DataFrame, models: list[Logistic], given: list[dict[int, int]]) -> list[dict[int, int]]:
    """For each view, the texts (hash to label) of unlabelled documents that the other view is surest of and that it has not been given."""
    held = views.sparkSession.sparkContext.broadcast(models)  # about 300 weights a view

    def judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [sigmoid(m.logit(np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in batch.column(c)]).astype(np.float64))) if batch.num_rows else np.zeros(0) for c, m in ((1, held.value[0]), (2, held.value[1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(p[0]), pa.array(p[1])], ["id", "same", "pa", "pb"])

    scored = views.select("id", "a", "b", "same").transform(in_arrow, judge_all, "id long, same long, pa double, pb double")
    sure = scored.filter(f"greatest(pa, 1 - pa, pb, 1 - pb) >= {SURE}").join(known, "id", "left_anti")
    sure = materialise(sure.groupBy("same").agg(F.max("pa").alias("pa"), F.max("pb").alias("pb")), "sure")
    out: list[dict[int, int]] = [{}, {}]
    for v, p in ((1, "pa"), (0, "pb")):  # what view a is sure of goes to view b, and the other way round
        for label, likely in ((1, F.col(p)), (0, 1 - F.col(p))):
            rows = sure.select("same", likely.alias("p")).filter(F.col("p") >= SURE).orderBy(F.desc("p"), "same").limit(HANDED + len(given[v])).collect()
            out[v] |= {s: label for s in [r["same"] for r in rows if r["same"] not in given[v]][:HANDED]}
    return out


def _both(models: list[Logistic], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.c_[models[0].logit(a), models[1].logit(b)]


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> dict | None:
    """Both views' models and the combination, or None where the labels are not of two classes.

    An id with labels that differ has none. Ids that no document has do not count; of rows that share an id all
    count, up to ``LABELLED`` rows. A text that several rows share is handed over once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(target).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    known = materialise(known, "labels")
    views = _described(docs)
    first = known.join(views.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    rows = views.join(F.broadcast(first), "id").orderBy(F.xxhash64("id"), "id", "same", "a", "b").limit(LABELLED).select("label", "a", "b").collect()
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    a, b = _matrices(rows)
    fold = np.arange(len(y)) % FOLDS
    logits = np.zeros((len(y), 2))
    for k in range(FOLDS):
        out = fold == k
        if out.any() and len(set(y[~out].tolist())) == 2:  # else these rows say nothing: logits of 0
            logits[out] = _both([Logistic().fit(v[~out], y[~out]) for v in (a, b)], a[out], b[out])
    platt = [Logistic(0.1).fit(logits[:, [v]], y) for v in (0, 1)]
    both = Logistic(0.1).fit(np.c_[platt[0].logit(logits[:, [0]]), platt[1].logit(logits[:, [1]])], y)
    training = [[a, y], [b, y]]
    models = [Logistic().fit(*training[0]), Logistic().fit(*training[1])]
    given: list[dict[int, int]] = [{}, {}]
    for _ in range(ROUNDS):
        new = _surest(views, known.select("id"), models, given)
        wanted = sorted({*new[0], *new[1]})
        if not wanted:
            break
        ids = docs.sparkSession.createDataFrame([(s,) for s in wanted], "same long")  # 4 * HANDED at most
        one = views.join(F.broadcast(ids), "same").groupBy("same").agg(F.min(F.struct("a", "b")).alias("v")).select("same", "v.a", "v.b").orderBy("same").collect()
        gifts = _matrices(one)
        for v in (0, 1):
            mine = [i for i, r in enumerate(one) if r["same"] in new[v]]
            training[v] = [np.r_[training[v][0], gifts[v][mine]], np.r_[training[v][1], [new[v][one[i]["same"]] for i in mine]]]
            given[v] |= new[v]
        models = [Logistic().fit(*training[0]), Logistic().fit(*training[1])]
    return {"models": models, "platt": platt, "both": both}


def judge(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns ``carry``, or else of all), p_text, p_page, score and keep for every document.

    score is the calibrated probability of good quality. Null and empty texts are scored from what
    they have; null sources and languages are one more value; rows are scored one by one, so repeated
    rows score alike. If the labels do not hold both classes every score is 0.5 and everything is
    kept. An empty table gives an empty result.
    """
    fitted = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(fitted)  # about 350 weights a view

    carry = carry or docs.columns
    own = "text" not in carry  # else the text is in the row already

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = held.value
        for batch in batches:
            whole = batch.column("row")
            text = batch.column("text") if own else whole.field(whole.type.get_field_index("text"))
            for row, end, a, b in features(text, *(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))):
                if m is None:
                    pa_ = pb = s = np.full(end - row, 0.5)
                else:
                    la = m["platt"][0].logit(m["models"][0].logit(a)[:, None])
                    lb = m["platt"][1].logit(m["models"][1].logit(b)[:, None])
                    pa_, pb, s = sigmoid(la), sigmoid(lb), sigmoid(m["both"].logit(np.c_[la, lb]))
                yield pa.RecordBatch.from_arrays([whole.slice(row, end - row), pa.array(pa_), pa.array(pb), pa.array(s)], ["row", "p_text", "p_page", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *(["text"] if own else []), *_metadata(docs))
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.DoubleType()) for c in ("p_text", "p_page", "score")]])
    return rows.transform(in_arrow, score, schema).withColumn("keep", F.col("score") >= KEEP_FROM)


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    return judge(docs, labels).filter("keep").select("row.*")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = slim(read(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang", "n_chars")
    return judge(docs, read(spark, sf_dir, "labels"), ["doc_id"]).select("row.doc_id", "p_text", "p_page", "score", "keep")
