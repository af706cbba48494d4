"""Names in texts by one automaton: a pass over a text finds every name in it, however many names there are.

The automaton has a state for every beginning of a name, edges as sorted keys (state and character class), and for each state the
longest proper ending that is a state too. A batch of texts is one stream of characters, cut into lanes of equal length
that advance together; a lane begins one name's length before its own characters, so no name is lost at a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import small_batches

LANES = 4096
STREAM = 1 << 20  # characters of a stream


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Automaton:
    """Of distinct names, none empty; its arrays are as large as the names' characters."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.longest = max((len(n) for n in self.names), default=0)
        self.letters = np.unique(_codes("".join(self.names)))  # class 0 is any other character
        self.width = len(self.letters) + 1
        classes = [self.classes(_codes(n)) for n in self.names]
        sizes = np.array([len(c) for c in classes], dtype=np.int64)
        at = np.zeros(len(self.names), dtype=np.int64)  # each name's state so far
        fail, named, edges = [np.zeros(1, np.int64)], [np.full(1, -1, np.int64)], []
        self.keys, self.targets = np.zeros(0, np.int64), np.zeros(0, np.int64)
        states = 1
        for depth in range(self.longest):
            alive = np.flatnonzero(sizes > depth)
            key = at[alive] * self.width + np.array([classes[i][depth] for i in alive], dtype=np.int64)
            fresh, child = np.unique(key, return_inverse=True)
            at[alive] = states + child
            own = np.full(len(fresh), -1, np.int64)
            ends = np.flatnonzero(sizes == depth + 1)
            own[at[ends] - states] = ends
            edges.append(fresh)
            known = np.concatenate(fail)
            back = np.zeros(len(fresh), np.int64)
            if depth:  # the parent's ending, advanced; edges of all shallower states are there
                self.fail = known
                back = self.step(known[fresh // self.width], fresh % self.width)
            fail.append(back)
            named.append(own)
            self.keys = np.concatenate(edges)
            self.targets = np.arange(1, states + len(fresh), dtype=np.int64)
            states += len(fresh)
        self.fail, self.named = np.concatenate(fail), np.concatenate(named)
        self.ending = np.zeros(states, np.int64)  # the longest proper ending that is a whole name; 0: none
        first = 1
        for level in edges:
            s = np.arange(first, first + len(level))
            f = self.fail[s]
            self.ending[s] = np.where(self.named[f] >= 0, f, self.ending[f])
            first += len(level)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.zeros(len(codes), np.int64)
        i = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[i] == codes, i + 1, 0).astype(np.int64)

    def step(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Next states: edges are tried from each state and then from its endings, down to the root."""
        out = np.zeros(len(state), np.int64)
        left = np.flatnonzero(cls)
        state = state.copy()
        while len(left):
            key = state[left] * self.width + cls[left]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            out[left[hit]] = self.targets[i[hit]]
            left = left[~hit & (state[left] > 0)]
            state[left] = self.fail[state[left]]
        return out

    def find(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last character, state) of every place of a stream of classes where a name ends."""
        n = len(stream)
        if not n or not self.longest:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = max(1, min(LANES, n // self.longest))
        own = -(-n // lanes)
        before = self.longest - 1
        begin = np.arange(lanes, dtype=np.int64) * own - before
        state = np.zeros(lanes, np.int64)
        places, states = [], []
        for j in range(own + before):
            at = begin + j
            cls = np.where((at >= 0) & (at < n), stream[np.clip(at, 0, n - 1)], 0)
            state = self.step(state, cls)
            hit = np.flatnonzero((self.named[state] >= 0) | (self.ending[state] > 0))
            if len(hit):
                places.append(at[hit])
                states.append(state[hit])
        return (np.concatenate(places), np.concatenate(states)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _pieces(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, classes); a text longer than a stream comes in pieces that overlap by a name less one character."""
        for i, t in enumerate(texts):
            if t:
                codes = _codes(t)
                for a in range(0, max(1, len(codes) - self.longest + 1), STREAM):
                    yield i, self.classes(codes[a : a + STREAM + self.longest - 1])

    def in_texts(self, texts: list[str | None]) -> list[list[str]]:
        """For each text the distinct names in it, in order; none in a text that is null."""
        found: list[np.ndarray] = []
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for piece in self._pieces(texts):
            held.append(piece)
            size += len(piece[1]) + 1
            if size >= STREAM:
                found.append(self._in_stream(held))
                held, size = [], 0
        if held:
            found.append(self._in_stream(held))
        out: list[list[str]] = [[] for _ in texts]
        if found:
            for text, name in np.unique(np.concatenate(found), axis=0).tolist():
                out[text].append(self.names[name])
        return out

    def _in_stream(self, held: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Distinct rows (text, name) of pieces, which a character of class 0 parts."""
        gap = np.zeros(1, np.int64)
        stream = np.concatenate([x for _, c in held for x in (c, gap)])
        starts = np.cumsum([0, *(len(c) + 1 for _, c in held[:-1])])
        place, state = self.find(stream)
        text = np.array([i for i, _ in held], dtype=np.int64)[np.searchsorted(starts, place, side="right") - 1]
        pairs = np.unique(np.stack([text, state], axis=1), axis=0)
        out = []
        while len(pairs):
            whole = pairs[self.named[pairs[:, 1]] >= 0]
            out.append(np.stack([whole[:, 0], self.named[whole[:, 1]]], axis=1))
            pairs = np.unique(np.stack([pairs[:, 0], self.ending[pairs[:, 1]]], axis=1), axis=0)
            pairs = pairs[pairs[:, 1] > 0]
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def names_in(texts: DataFrame, names: list[str]) -> DataFrame:
    """(text_id, name) of each name, once, that occurs in a text of (text_id, folded). The names' size is the caller's to bound."""
    machine = texts.sparkSession.sparkContext.broadcast(Automaton(names))

    @F.pandas_udf("array<string>")
    def hits(column: pd.Series) -> pd.Series:
        return pd.Series(machine.value.in_texts(column.tolist()), dtype=object)

    return small_batches(texts).select("text_id", F.explode(hits("folded")).alias("name"))
