"""Token ids in a binary file with random access: directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that
has one, one byte each, and a bitmap that says which of them go on at level k + 1; a rank directory
with the number of set bits before every 512th makes the place at the next level a look-up. So the
i-th id is read by touching one byte and one directory entry a level, without decoding a block.

A file is a sequence of blocks of whole documents in ascending doc_id order; a block is readable by
itself. Blocks are rows of a Parquet folder in the shared file system: Spark's committer makes a
lost executor's blocks appear once, and a block is found by its place without reading the others.
"""

from __future__ import annotations

import operator
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import chunks
from .shared import in_arrow, read, slim, table_path
from .worker import keep

MAGIC = b"DAC1"
RANK_STEP = 512
BLOCK_TOKENS = 1 << 18  # a block is closed once it holds so many; a longer document is a block by itself
MEMO_WORDS = 1_200_000  # words whose ids a worker remembers
MEMO_STEMS = 1_000_000  # and lower-case stems
END_ID = 2

_LAYOUT = "part int, block long, first_doc long, last_doc long, n_docs long, within long, n_tokens long, payload binary"


# the code


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, known: np.ndarray | None = None) -> bytes:
    """A block: header, documents (ids, first tokens, ids that are null), then chunks, bitmap and ranks of every level."""
    known = np.ones(len(doc_ids), bool) if known is None else known
    out = []
    values, levels = ids.astype(np.uint32), 0
    while True:
        goes_on = values > 255
        bits = np.packbits(goes_on, bitorder="little")
        ranks = np.r_[0, np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_STEP), dtype=np.int64))] if len(values) else np.zeros(1, np.int64)
        out += [np.int64(len(values)).tobytes(), values.astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        levels += 1
        values = values[goes_on] >> np.uint32(8)
        if not len(values):
            break
    head = MAGIC + np.array([levels, len(doc_ids), len(ids)], "<i8").tobytes()
    first = np.r_[0, np.cumsum(lengths)]
    return b"".join([head, doc_ids.astype("<i8").tobytes(), first.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), *out])


class Block:
    """A packed block, opened without decoding it."""

    def __init__(self, payload: bytes):
        if bytes(payload[:4]) != MAGIC:
            raise ValueError("not a token block")
        n_levels, n_docs, self.n_tokens = (int(x) for x in np.frombuffer(payload, "<i8", 3, 4))
        at = 28
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        self.first = np.frombuffer(payload, "<i8", n_docs + 1, at + 8 * n_docs)
        at += 8 * (2 * n_docs + 1)
        self.known = np.frombuffer(payload, np.uint8, n_docs, at).astype(bool)
        at += n_docs
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(payload, "<i8", 1, at)[0])
            n_bits, n_ranks = -(-n // 8), -(-n // RANK_STEP) + 1
            self.levels.append((
                np.frombuffer(payload, np.uint8, n, at + 8), np.frombuffer(payload, np.uint8, n_bits, at + 8 + n), np.frombuffer(payload, "<u4", n_ranks, at + 8 + n + n_bits),
            ))
            at += 8 + n + n_bits + 4 * n_ranks

    def token(self, i: int) -> int:
        """The i-th id of the block."""
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_STEP
            between = np.unpackbits(bits[block * RANK_STEP // 8 : i // 8 + 1], bitorder="little")[: i - block * RANK_STEP]
            i = int(ranks[block]) + int(between.sum())
        return value

    def tokens(self) -> np.ndarray:
        """All ids of the block."""
        above = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            values = chunk.astype(np.uint32)
            goes_on = np.unpackbits(bits, bitorder="little", count=len(chunk)).astype(bool)
            values[goes_on] |= above << np.uint32(8)
            above = values
        return above


# encoding


class WordMemo:
    """Ids of space-separated words by the tokenizers library, each distinct word encoded once in a while.

    The tokenizer drops white space before it splits words, so a text's ids are its words' ids in order.
    A word of plain letters with or without closing marks is two pre-tokens, its lower-case stem and the
    marks, whose ids follow each other. Stems go through the library joined by spaces, and their ids are cut
    apart where a token ends a pre-token.
    """

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|%$&*#]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {"": b""}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
        if len(cut) != len(words) + 1:
            return self._each(words)
        cut, data = (cut * 4).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > MEMO_WORDS:
            self.known.clear()
        if len(self.stems) > MEMO_STEMS:
            self.stems = {"": b""}
        if not words:
            return
        plain, heads, tails, other = [], [], [], []
        match = self._plain.fullmatch
        for w, text in zip(words, b"\n".join(words).decode().split("\n"), strict=True):
            if len(w) < 200 and (m := match(text)):
                head, tail = m.groups()
                plain.append(w)
                heads.append(head)
                tails.append(tail)
            else:
                other.append(w)
        heads = "\n".join(heads).lower().split("\n") if heads else []
        stems = self.stems
        new = list(set(heads).difference(stems))
        for i in range(0, len(new), 500):
            stems.update(zip(new[i : i + 500], self._joined(new[i : i + 500]), strict=True))
        marks = list(set(tails).difference(stems))
        stems.update(zip(marks, self._each(marks), strict=True))
        get = stems.__getitem__
        self.known.update(zip(plain, map(operator.add, map(get, heads), map(get, tails)), strict=False))
        self.known.update(zip(other, self._each([w.decode() for w in other]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.split() for t in texts]  # at ASCII white space
        missing = set().union(*split).difference(self.known)
        if missing:
            self.learn(missing)
            if len(self.known) == len(missing):  # it was cleared
                self.learn(set().union(*split).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _memo(path: str) -> WordMemo:
    return keep(("words", path), lambda: WordMemo(path))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> str:
    """Encodes ``docs`` (doc_id, text) and writes the token file; returns its path.

    A null or empty text has the end id alone. Documents go by doc_id, nulls first, rows of one id by a hash of
    their text and then by text, so that many rows of one id can be parted. An empty table writes a file without blocks.
    """
    path = table_path(docs.sparkSession, "tokens")
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, number = _memo(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = before = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for _, x in held], np.int64)
            known = np.array([d is not None for d, _ in held])
            ids = np.array([d or 0 for d, _ in held], np.int64)
            payload = pack(ids, lengths, np.frombuffer(b"".join(x for _, x in held), "<u4"), known)
            row = [part, number, held[0][0], held[-1][0], len(held), before, size, payload]
            types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["part", "block", "first_doc", "last_doc", "n_docs", "within", "n_tokens", "payload"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, stop, data, at in chunks(batch.column(1)):
                texts = [data[at[i] : at[i + 1]].tobytes() for i in range(stop - row)]
                for doc, ids in zip(doc_ids[row:stop], memo.encode(texts), strict=True):
                    held.append((doc, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= BLOCK_TOKENS:
                        yield close()
                        number, before, held, size = number + 1, before + size, [], 0
        if held:
            yield close()

    rows = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.transform(in_arrow, blocks, _LAYOUT).write.option("compression", "none").parquet(path)
    return path


def _starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part of the file: a row for each part."""
    out, at = {}, 0
    for r in spark.read.schema(_LAYOUT).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        out[r["part"]] = at
        at += r["n"]
    return out


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the number of ids before each in the file."""
    rows = list(_starts(spark, path).items())
    before = spark.createDataFrame(rows, "part int, before long")
    return spark.read.schema(_LAYOUT).parquet(path).join(before, "part").withColumn("start", F.col("before") + F.col("within"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Block(payload.as_buffer().to_pybytes())
                ids = b.tokens().astype("<u4")
                crc = [zlib.crc32(ids[b.first[i] : b.first[i + 1]].tobytes()) for i in range(len(b.doc_ids))]
                columns = [pa.array(b.doc_ids, pa.int64(), mask=~b.known), pa.array(b.first[:-1] + start), pa.array(np.diff(b.first)), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(b.first, pa.int32()), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    starts = _placed(spark, path).select("start", "payload")
    return starts.transform(in_arrow, documents, schema)


def read_at(spark: SparkSession, path: str, places: list[int]) -> dict[int, int]:
    """The ids at some places of the file, in one job: only the blocks that hold them are read, and not decoded.

    A place outside the file, as any of an empty file, is not in the result; a place asked for twice is there once.
    """
    size = BLOCK_TOKENS
    wanted = spark.createDataFrame([(p,) for p in sorted(set(places))], "place long").withColumn("stretch", F.floor(F.col("place") / size))
    end = F.col("start") + F.col("n_tokens")
    blocks = _placed(spark, path).select("start", "n_tokens", "payload")
    dealt = blocks.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))))
    met = dealt.join(wanted, "stretch").filter((F.col("place") >= F.col("start")) & (F.col("place") < end))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [Block(payload.as_buffer().to_pybytes()).token(i) for payload, i in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(ids, pa.int64())], ["place", "id"])

    found = met.select("payload", (F.col("place") - F.col("start")).alias("i"), "place").transform(in_arrow, look, "place long, id long")
    return {r["place"]: r["id"] for r in found.collect()}  # a row for each place asked for


def op4_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)
