"""Words of UTF-8 text as 64-bit hashes, found on the bytes of a whole Arrow column at once.

A word class is a table from byte to kept byte (0: separator). Every byte of a multi-byte
character is above 0x7F, so a class that is stated on ASCII works on bytes unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text that are worked on together; a longer text is a chunk by itself
_SEGMENT = 1 << 19  # bytes whose arrays are held at once; a longer word is a segment by itself
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _fold(keep) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for b in range(128):
        if not keep(b):
            table[b] = 0
    return table


#: words of [0-9A-Za-z] and everything above ASCII, A-Z folded
ALNUM = _fold(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: words between ASCII white space, A-Z folded; byte 0 is a word character and maps to 255, which UTF-8 never uses
BLANK = _fold(lambda b: not (b == 32 or 9 <= b <= 13))
BLANK[0] = 255


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; those of a segment are kept, more are made for a longer word only."""
    if _powers and n <= len(_powers[0][0]):
        return _powers[0]
    size = max(n, _SEGMENT + 1)
    made = []
    for base in (_BASE, _BASE_INV):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size == _SEGMENT + 1:
        _powers[:] = [tuple(made)]
    return made[0], made[1]


class Words:
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are the words of text i; ``prefixes`` has, for each size
    asked for, the hashes of the words' first bytes, 0 for shorter words."""

    def __init__(self, hashes, first, starts, ends, prefixes=None):
        self.hashes, self.first, self.starts, self.ends, self.prefixes = hashes, first, starts, ends, prefixes or {}


def _segment(folded: np.ndarray, edge: np.ndarray, prefixes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes, starts and ends of words, then a row for each prefix size; a word ends at each of ``edge`` too."""
    n = len(folded)
    inside = folded != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = _pow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[folded] * power[:n], out=total[1:])
    out = [mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends]
    for size in prefixes:
        own = ends - starts >= size
        s = starts[own]
        row = np.zeros(len(starts), np.uint64)
        row[own] = mix((total[s + size] - total[s]) * inverse[s] + np.uint64(size))
        out.append(row)
    return out


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``, found segment by segment: a segment ends between words."""
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + _SEGMENT)
        folded = table[data[at:end]]
        while end < n and folded.all():
            more = table[data[end : end + _SEGMENT]]
            folded, end = np.concatenate([folded, more]), end + len(more)
        if end < n:
            end = at + int(np.flatnonzero(folded == 0)[-1]) + 1
            folded = folded[: end - at]
        found = _segment(folded, offsets[(offsets > at) & (offsets < end)] - at, prefixes)
        found[1] += at
        found[2] += at
        parts.append(found)
        at = end
    if not parts:
        parts = [[np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.uint64)] * len(prefixes)]]
    hashes, starts, ends, *rows = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, dict(zip(prefixes, rows, strict=True)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``CHUNK`` bytes: first row, row after the last, bytes, offsets."""
    if not len(column):
        return
    data, at = utf8(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def shingles(words: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and the text each is from, in order of place.

    With ``short`` a text of fewer words, but not none, has its whole sequence as one shingle.
    """
    h, first = words.hashes, words.first
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(h) - size + 1
    if n > 0:
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = (out ^ h[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(i + 1)
        whole = text[:n] == text[size - 1 :]
        out, of = mix(out)[whole], text[:n][whole]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if short and len(few):
        extra = []
        for i in few:
            x = np.uint64(counts[i])
            with np.errstate(over="ignore"):
                for w in h[first[i] : first[i + 1]]:
                    x = (x ^ w) * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(7)
            extra.append(x)
        out = np.concatenate([out, mix(np.array(extra, np.uint64))])
        of = np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one text, and the place of each one's first word."""
    h, n = words.hashes, len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(i + 1)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return mix(out[at]), at
