"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words of equal length advance together: for every end position, hashes of the substrings that end
there probe the sorted piece keys, and a vectorised maximum over piece lengths stores the score and
the backpointer of each word's best path.

For a unigram model the path of the largest sum of scores is the encoding. A BPE model's scores are
merge ranks, and their sum does not give its encoding; but a sequence of pieces is the encoding
exactly if every two neighbours are what the merges make of the two joined. So there a piece is
admitted after the best path's last piece only if the pair is stable, and the same search finds the
one stable path. Results equal the sentencepiece library's for both kinds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import chunks, mix
from .shared import in_arrow, read, slim
from .worker import keep

SPACE = "\u2581"
MEMO_UNITS = 250_000  # units of a generation of the memo, two of which a worker holds: about 80 MB
_ROWS = 1 << 13  # words searched at once
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = np.int64(-1)
_BITS = 22
_PAIRS = 1 << 20  # pairs whose stability is remembered, one a slot


def _char(c: np.ndarray) -> np.ndarray:
    return mix(c.astype(np.uint64) + np.uint64(0x1234567))


class Pieces:
    """A model's pieces as arrays, in the order single characters, then merged pieces by falling score.

    ``number`` is a piece's place in this order. left and right are the two pieces that a merged piece
    was made of last; of a single character, itself.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.merges = proto.trainer_spec.model_type == 2
        if not self.merges and proto.trainer_spec.model_type != 1:
            raise ValueError("only unigram and BPE models have pieces to search")
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("the model normalises texts; normalise them before and pass an identity model")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.unknown = proto.trainer_spec.unk_id
        self.surface = proto.trainer_spec.unk_surface.encode()
        self.byte = np.full(256, self.unknown, np.int32)
        self.text = []
        normal = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.text.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == 1:
                normal.append((len(p.piece) > 1, -p.score if len(p.piece) > 1 else 0, i, p.piece, p.score))
                self.text.append(p.piece.encode())
            else:
                self.text.append(self.surface if p.type == 2 else b"")
        normal.sort()
        self.ids = np.array([n[2] for n in normal], np.int32)
        self.score = np.array([n[4] for n in normal])
        strings = [n[3] for n in normal]
        if (self.byte == self.unknown).any():
            raise ValueError("the model has no byte fallback")
        self.length = np.array([len(x) for x in strings], np.int64)
        self.longest = int(self.length.max())
        self.charset = set("".join(strings))
        self.pairs = {x[i : i + 2] for x in strings for i in range(len(x) - 1)}
        if any(SPACE in x.lstrip(SPACE) for x in strings):
            raise ValueError("a piece has a space after another character")
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, _BASE)])
        self.hash = np.zeros(len(strings), np.uint64)
        for i, x in enumerate(strings):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in _char(np.array([ord(y) for y in x])):
                    h = h * _BASE + c
            self.hash[i] = h
        keys = mix(self.hash)
        order = np.argsort(keys)
        self.keys, self.key_number = keys[order], order
        slot = (keys >> np.uint64(64 - _BITS)).astype(np.int64)
        self.table = np.full(1 << _BITS, _NONE, np.int32)  # piece of a slot; -1: none, -2: more than one
        self.table[slot] = np.arange(len(keys))
        self.table[np.flatnonzero(np.bincount(slot, minlength=1 << _BITS) > 1)] = -2
        self.key = keys
        self.pair_keys, self.pair_stable = np.full(_PAIRS, _NONE), np.zeros(_PAIRS, bool)
        self.left = np.arange(len(strings))
        self.right = np.arange(len(strings))
        self.reachable = np.ones(len(strings), bool)
        if self.merges:
            number = {x: i for i, x in enumerate(strings)}
            for i, x in enumerate(strings):
                if len(x) > 1:
                    parts = self._merge(x, number, i)
                    self.reachable[i] = len(parts) == 2 and None not in (number.get(parts[0]), number.get(parts[1]))
                    if self.reachable[i]:
                        self.left[i], self.right[i] = number[parts[0]], number[parts[1]]
        # units end where no piece goes on: at control characters and before spaces
        cut = re.escape("".join(c for c in map(chr, range(32)) if c not in self.charset))
        self.units = re.compile(f" *[^ {cut}]+| +|[{cut}]+")

    @staticmethod
    def _merge(x: str, number: dict[str, int], below: int) -> list[str]:
        """Merges of ``x`` with pieces that come before piece ``below``."""
        parts = list(x)
        while len(parts) > 2:
            best = min(((number.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)))
            if best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def cut(self, text: str) -> list[str]:
        """Units of a text, in which the model's space character is a plain space: no piece lies across the border of two."""
        units = self.units.findall((" " * self.prefix + text).replace(SPACE, " ")) if text else []
        if not units or max(map(len, units)) <= 64:
            return units
        out = []
        for unit in units:
            at = 0
            for i in range(1, len(unit) if len(unit) > 64 else 0):
                if unit[i - 1 : i + 1].replace(" ", SPACE) not in self.pairs:
                    out.append(unit[at:i])
                    at = i
            out.append(unit[at:])
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        keys = mix(hashes)
        out = self.table[(keys >> np.uint64(64 - _BITS)).astype(np.int64)]
        some = np.flatnonzero(out.ravel() != _NONE)
        if len(some):
            flat, k = out.ravel(), keys.ravel()[some]
            number = flat[some]
            many = np.flatnonzero(number == -2)
            if len(many):
                number[many] = self.key_number[np.minimum(np.searchsorted(self.keys, k[many]), len(self.keys) - 1)]
            flat[some] = np.where(self.key[number] == k, number, _NONE)
            out = flat.reshape(out.shape)
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave pieces a and b side by side when their texts are joined."""
        pair = a * len(self.key) + b
        slot = (mix(pair.astype(np.uint64)) & np.uint64(_PAIRS - 1)).astype(np.int64)
        new = np.flatnonzero(self.pair_keys[slot] != pair)
        out = self.pair_stable[slot]
        if len(new):
            out[new] = self._stable(a[new], b[new])
            self.pair_keys[slot[new]], self.pair_stable[slot[new]] = pair[new], out[new]
            # of two pairs in one slot either may have won; the slot then holds that one's result
            self.pair_stable[slot[new]] = self._winner(slot[new], pair[new], out[new])
        return out

    def _winner(self, slot: np.ndarray, pair: np.ndarray, stable: np.ndarray) -> np.ndarray:
        held = self.pair_keys[slot] == pair
        order = np.argsort(slot[held], kind="stable")
        first = np.searchsorted(slot[held][order], slot)
        return stable[held][order][np.minimum(first, len(order) - 1)]

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Both pieces are taken apart, the later merge first; if the ends that face each other would have
        merged before the last merge undone, the pair never comes to stand.
        """
        ok = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(open_):
            n = self.length[a] + self.length[b]
            fits = n <= self.longest
            joined = np.full(len(a), _NONE)
            joined[fits] = self.find(self.hash[a[fits]] * self.power[self.length[b[fits]]] + self.hash[b[fits]])
            bad = (joined >= 0) & (joined < limit)
            ok[open_[bad]] = False
            later = a > b  # the left piece was merged after the right one
            can_a, can_b = self.length[a] > 1, self.length[b] > 1
            take_a = (later & can_a) | (~later & ~can_b & can_a)
            take_b = (~later & can_b) | (later & ~can_a & can_b)
            limit = np.where(take_a, a, np.where(take_b, b + 1, limit))
            a, b = np.where(take_a, self.right[a], a), np.where(take_b, self.left[b], b)
            go = ~bad & (take_a | take_b)
            open_, a, b, limit = open_[go], a[go], b[go], limit[go]
        return ok

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers (piece length) and last piece of every prefix of words of equal length (rows); -1: an unknown character."""
        rows, n = codes.shape
        prefix = np.zeros((rows, n + 1), np.uint64)
        chars = _char(codes)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * _BASE + chars[:, j]
        found = np.full((n + 1, rows, min(n, self.longest)), _NONE, np.int32)  # by end, word and length - 1
        for size in range(1, min(n, self.longest) + 1):
            piece = self.find(prefix[:, size:] - prefix[:, : n + 1 - size] * self.power[size])
            found[size:, :, size - 1] = np.where((piece >= 0) & self.reachable[piece], piece, _NONE).T
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back, last = np.ones((rows, n + 1), np.int8), np.full((rows, n + 1), _NONE)
        unknown = self.score.min() - 10
        every = np.arange(rows)
        for j in range(1, n + 1):
            row, size = np.nonzero(found[j] >= 0)
            piece, start = found[j][row, size], j - 1 - size
            if self.merges and len(row):
                before = last[row, start]
                pair = np.flatnonzero(before >= 0)
                keep = np.ones(len(row), bool)
                keep[pair] = self.stable(before[pair], piece[pair].astype(np.int64))
                row, size, piece, start = row[keep], size[keep], piece[keep], start[keep]
            score = np.full((rows, found.shape[2]), -np.inf)
            score[row, size] = best[row, start] + self.score[piece]
            size = score.argmax(axis=1)
            best[:, j], back[:, j] = score[every, size], size + 1
            last[:, j] = found[j][every, size]
            none = np.isneginf(best[:, j])  # no path ends here: an unknown character stands alone, else the place is inside a piece
            if none.any():
                back[none, j], last[none, j] = 1, _NONE
                alone = none & (found[j][:, 0] < 0)
                best[alone, j] = best[alone, j - 1] + unknown
        return back, last

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each unit."""
        units = [u.replace(" ", SPACE) for u in units]
        out: list[bytes] = [b""] * len(units)
        by: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            n = len(u)
            by.setdefault(n if n <= 32 else 1 << (n - 1).bit_length(), []).append(i)  # longer ones are padded
        for width, own in by.items():
            step = max(1, min(_ROWS, (1 << 17) // width))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                if width <= 32:
                    codes = np.frombuffer("".join([units[i] for i in some]).encode("utf-32-le"), "<u4").reshape(len(some), width)
                else:
                    codes = np.full((len(some), width), 0x110000, np.uint32)
                    for k, i in enumerate(some):
                        codes[k, : len(units[i])] = np.frombuffer(units[i].encode("utf-32-le"), "<u4")
                back, last = self.search(codes)
                for k, ids in enumerate(self._paths(back, last, [units[i] for i in some])):
                    out[some[k]] = ids
        return out

    def _paths(self, back: np.ndarray, last: np.ndarray, units: list[str]) -> list[bytes]:
        at = np.array([len(u) for u in units])
        steps = []  # ids from the end of each word, or -1 - place of an unknown character
        while at.any():
            rows = np.arange(len(at))
            piece = last[rows, at]
            steps.append(np.where(at > 0, np.where(piece >= 0, self.ids[piece], -1 - at), 0x7FFFFFFF))
            at = np.where(at > 0, at - back[rows, at], 0)
        path = np.array(steps[::-1]).T if steps else np.zeros((len(units), 0), np.int64)
        out = []
        plain = (path >= 0).all(axis=1)
        used = path != 0x7FFFFFFF
        flat = path[used].astype("<i4")
        cut = np.r_[0, np.cumsum(used.sum(axis=1))]
        data = flat.tobytes()
        for k in range(len(units)):
            if plain[k]:
                out.append(data[4 * cut[k] : 4 * cut[k + 1]])
                continue
            ids: list[int] = []
            for v in flat[cut[k] : cut[k + 1]]:
                if v >= 0:
                    ids.append(int(v))
                else:
                    c = units[k][-int(v) - 2].encode()
                    ids += [int(self.byte[x]) for x in c]
            out.append(np.array(ids, "<i4").tobytes())
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; invalid bytes become replacement characters, as the library has it."""
        data = b"".join([self.text[i] for i in ids])
        data = data.replace(SPACE.encode(), b" ")
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode(errors="replace")


class Encoder:
    """Pieces with the ids of units met lately.

    The memo has two generations. A full young one becomes the old one, whose units move back to the young one
    when they are met again; so frequent units stay, rare ones go, and there are never more than twice ``MEMO_UNITS``
    of them and those of one chunk of texts.
    """

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        p = self.pieces
        split = [p.cut(t) for t in texts]
        missing = set().union(*split).difference(self.young)
        if missing:
            if len(self.young) + len(missing) > MEMO_UNITS:
                self.young, self.old = {}, self.young
                missing = set().union(*split)
            again = missing.intersection(self.old)
            self.young.update((u, self.old[u]) for u in again)
            new = list(missing.difference(again))
            self.young.update(zip(new, p.encode_units(new), strict=True))
        get = self.young.__getitem__
        return [b"".join(map(get, units)) for units in split]


def _encoder(path: str) -> Encoder:
    return keep(("pieces", path), lambda: Encoder(path))


def tokenise(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 (of little-endian 32-bit ids) and round_trip for every document.

    round_trip: decoding the ids gives the text back. It can fail for texts that hold the model's
    space character only. A null or empty text has no ids and round_trip true. Rows are encoded one by
    one, so repeated rows and ids keep their own results; other columns are ignored; an empty table
    gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for row, end, data, at in chunks(batch.column(1)):
                texts = [data[at[i] : at[i + 1]].tobytes().decode() for i in range(end - row)]
                packed = encoder.encode(texts)
                lengths = np.array([len(x) // 4 for x in packed])
                ids = np.frombuffer(b"".join(packed), "<i4")
                first = np.r_[0, np.cumsum(lengths)]
                back = [encoder.pieces.decode(ids[first[i] : first[i + 1]].tolist()) == t for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)), pa.array([zlib.crc32(x) for x in packed], pa.int64()), pa.array(back)],
                    ["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"],
                )

    return slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").transform(in_arrow,
        encode, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean"
    )


def op2_sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenise(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
