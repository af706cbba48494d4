"""The first-wins duplicate filter: a text is kept only if no kept text before it is similar.

This is the first maximal independent set, in the order of ids, of the graph of similar texts; components of that graph would drop
more. Similarity is Jaccard over distinct lower-case words. Texts of equal word sets are settled by the first of them alone.

Words are in one order, rarest first by a sketch of how many texts have them, which decides speed and not results. Of two similar sets the smaller
one's first words and the larger one's, a few more, have the first common word among them, and of large sets several common words, if each takes some words more. The filter works in rounds:

* *leading rounds*: while a word is among the first ones of more than ``SHORT_LIST`` undecided texts, the first text of each such list is compared with
  all others. One that has no similar text before it is kept, and what is similar to it goes. A group of any number of near copies goes in one
  round, without a pair of copies being formed.
* *edge rounds*: once there are no such lists, or leading rounds settle little, the texts on a list are paired in the task that has the list; lengths,
  places and a mark of the words drop most pairs that are not similar before they leave it. A text that no undecided one is paired with
  before it is kept, round by round. In the first round only pairs with the texts kept are compared by their words, which settles most copies, then
  all that are left. The number of rounds is that of the longest chain in which a text waits for the one before.

Sets of words are not written but for the texts of such pairs, and a word's list is shuffled once, so what lies on disk grows with the texts. Results are
exact and do not depend on how many rounds of which kind there are.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import settle, small_batches

LEAST = 0.8
SHORT_LIST = 512  # undecided holders of a word up to which pairs are formed
PAIRS = 1 << 19  # pairs that a task holds at once
ROWS = 1 << 15  # pairs of a bucket, about
HOOD = 1 << 23  # pairs of a hood that are dealt out
SLOW = 20  # leading rounds end when one settles less than one in so many
CELLS = 1 << 22  # counters of the sketch, at every size of input
PARTS = 64  # in which the sketch is summed up
SENT = 2_000_000  # ids that are sent to every task; of more both sides are shuffled
LONG = 14  # a list of over 2 ** LONG texts is dealt to several tasks
SALT = np.uint64(0x9E3779B97F4A7C15)
_PREFIX = "id long, n int, tokens array<long>, mark binary"
_POSTING = "token long, id long, n int, place int, leads boolean, mark binary"
_PAIR, _COUNTED = "a long, b long", "a long, b long, shared long, least long"


def _picked(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The ``rows`` of settled ``ids``, which are sent to every task if they are not too many."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, "id", how)


def _own(texts: DataFrame) -> DataFrame:
    """(id, s): a row for each id, with the hashes of its words."""
    words = F.array_distinct(F.transform(text.word_set(F.col("text")), lambda w: F.xxhash64(w)))
    rows = texts.select("id", words.alias("s"))
    repeated = settle(texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("same")), "repeated")
    if not repeated.limit(1).count():
        return rows
    same = F.col("id").eqNullSafe(F.col("same"))
    merged = rows.join(repeated, same, "left_semi").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    return settle(rows.join(repeated, same, "left_anti").unionByName(merged), "words")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, h, g, s) without s, and in the end the parts of a sketch of how often words come."""
    total, names = np.zeros(CELLS, np.uint32), ["id", "n", "h", "g", "part", "counts"]
    for batch in batches:
        np.add.at(total, batch.column("s").flatten().to_numpy(zero_copy_only=False) & (CELLS - 1), np.uint32(1))
        none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *none], names)
    if total.any():
        none = [pa.nulls(PARTS, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(total, PARTS)], pa.binary())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, levels): four times the binary logarithm of each cell's count and 1."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(packed.as_py()), np.uint32).astype(np.uint64)
    levels = [np.floor(4 * np.log2(x + 1.0)).astype(np.uint8).tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])


def _levels(told: DataFrame) -> np.ndarray:
    """The sketch that every task gets: a byte a cell."""
    out = np.zeros(CELLS, np.uint8).reshape(PARTS, -1)
    for r in told.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(_summed, "part int, levels binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out.ravel()


class _Rule:
    """When sets are similar: lengths of first words, sizes, common words and marks, all of arrays."""

    def __init__(self, least: Fraction):
        self.num, self.den = least.numerator, least.denominator
        self.wide = 2 if 3 * self.num >= 2 * self.den else 1  # words of a mark's bit: the more similar, the fewer bits tell sets apart

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words similar sets of ``a`` and ``b`` words have in common at least."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def more(self, n: np.ndarray) -> np.ndarray:
        """How many lists a set shares with similar ones that are not smaller, besides one."""
        return np.minimum(n // 64, -(-self.num * n // self.den) - 1)

    def length(self, n: np.ndarray) -> np.ndarray:
        """How many first words of a set are on lists: among them are the first ones that it has in common with any similar set."""
        return n + (-self.num * n // self.den) + 1 + self.more(n)

    def leads(self, n: np.ndarray) -> np.ndarray:
        """The same for similar sets that are not smaller."""
        return n - self.needed(n, n) + 1 + self.more(n)

    def width(self, n: np.ndarray) -> np.ndarray:
        """Longs of a mark."""
        return np.where(n <= 64 * self.wide, 2, np.where(n <= 128 * self.wide, 4, 8 // self.wide))

    def marked(self, s: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Marks of sets of ``n`` words ``s``: a bit for each word."""
        bits = np.zeros((len(n), 512), bool)
        bits[row, s & 511] = True
        folded = {8: np.packbits(bits, axis=1, bitorder="little").view(np.uint64)}
        for w in (4, 2):
            folded[w] = folded[2 * w][:, :w] | folded[2 * w][:, w:]
        return [folded[w][i].tobytes() for i, w in enumerate(self.width(n).tolist())]


class _Holders:
    """Postings as arrays."""

    def __init__(self, rows: pa.Table, rule: _Rule):
        self.rule = rule
        self.token, self.id, self.n, self.place, self.leads = (rows.column(c).to_numpy().astype(t) for c, t in (("token", np.int64), ("id", np.int64), ("n", np.int64), ("place", np.int64), ("leads", bool)))
        self.width = rule.width(self.n)
        self.marks = {w: np.zeros((len(self.n), w), np.uint64) for w in (8, 4, 2)}
        marks = rows.column("mark").combine_chunks()
        for w in (8, 4, 2):
            at = np.flatnonzero(self.width == w)
            if len(at):
                own = np.frombuffer(b"".join(marks.take(pa.array(at)).to_pylist()), np.uint64).reshape(-1, w)
                self.marks[w][at] = own
            if w > 2:
                self.marks[w // 2][:] = self.marks[w][:, : w // 2] | self.marks[w][:, w // 2 :]

    def close(self, x: np.ndarray, other: _Holders, y: np.ndarray) -> np.ndarray:
        """Which pairs of the places ``x`` here and ``y`` of ``other`` may be of similar sets with one of the first common words here."""
        na, nb = self.n[x], other.n[y]
        need = self.rule.needed(na, nb)
        leads = np.where(na < nb, self.leads[x], np.where(na > nb, other.leads[y], self.leads[x] | other.leads[y]))
        left = np.flatnonzero((self.id[x] != other.id[y]) & leads & (np.minimum(na, nb) >= need) & (np.minimum(na - self.place[x], nb - other.place[y]) + self.rule.more(np.minimum(na, nb)) >= need))
        x, y, need = x[left], y[left], need[left]
        width, ok = np.minimum(self.width[x], other.width[y]), np.zeros(len(x), bool)
        for w in (8, 4, 2):
            at = np.flatnonzero(width == w)
            a, b = self.marks[w][x[at]], other.marks[w][y[at]]
            lost = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64)
            ok[at] = np.minimum(self.n[x[at]] - lost(a, b), other.n[y[at]] - lost(b, a)) >= need[at]
        return left[ok]


def _ordered(batches: Iterator[pa.RecordBatch], held, rule: _Rule) -> Iterator[pa.RecordBatch]:
    """The first words and the mark of each set of rows (id, s) that has any."""
    for batch in batches:
        n = pc.list_value_length(batch.column("s")).to_numpy()
        some = np.flatnonzero(n)
        n, s = n[some].astype(np.int64), batch.column("s").flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        marks = rule.marked(s, row, n)
        s = s[np.lexsort((s, held.value[s & (CELLS - 1)], row))]
        first = np.cumsum(n) - n
        kept = np.arange(len(s)) - first[row] < rule.length(n)[row]
        tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rule.length(n))).astype(np.int32)), pa.array(s[kept]))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(some)), pa.array(n.astype(np.int32)), tokens, pa.array(marks, pa.binary())], ["id", "n", "tokens", "mark"])


def _spread(batch: pa.RecordBatch, levels: np.ndarray, rule: _Rule, above: int = 4) -> tuple[np.ndarray, ...]:
    """Of rows of prefixes the row, word, place and level of each word that more than one text may have, or of a level above."""
    size = pc.list_value_length(batch.column("tokens")).to_numpy().astype(np.int64)
    token = batch.column("tokens").flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    place, level = np.arange(len(token)) - (np.cumsum(size) - size)[row], levels[token & (CELLS - 1)]
    left = np.flatnonzero(level > above)
    return row[left], token[left], place[left], level[left]


def _posted(batches: Iterator[pa.RecordBatch], held, rule: _Rule, dealt: bool) -> Iterator[pa.RecordBatch]:
    """Postings of rows of prefixes; ``dealt``: long lists are several, each with all texts, of which each leads in one."""
    for batch in batches:
        row, token, place, level = _spread(batch, held.value, rule)
        n, ids = batch.column("n").to_numpy().astype(np.int64), batch.column("id").to_numpy()
        leads = place < rule.leads(n)[row]
        if dealt:
            lists = 1 << np.clip(level.astype(np.int64) // 4 - LONG, 0, 6)
            part = np.arange(lists.sum()) - np.repeat(np.cumsum(lists) - lists, lists)
            row, token, place, leads, lists = (np.repeat(x, lists) for x in (row, token, place, leads, lists))
            leads &= part == (ids[row].view(np.uint64) * SALT >> np.uint64(40)).astype(np.int64) % lists
            token = (token.view(np.uint64) + part.astype(np.uint64) * SALT).view(np.int64)
        for i in range(0, len(row), 1 << 16):
            x = slice(i, i + (1 << 16))
            at = pa.array(row[x])
            yield pa.RecordBatch.from_arrays([pa.array(token[x]), batch.column("id").take(at), batch.column("n").take(at), pa.array(place[x].astype(np.int32)), pa.array(leads[x]), batch.column("mark").take(at)], ["token", "id", "n", "place", "leads", "mark"])


def _counted(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """(a, b, shared, least): pairs with the number of lists found to be shared and of those that similar sets share."""
    a, b, least = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], np.diff(np.append(first, len(a))), least[first])], ["a", "b", "shared", "least"])


def _listed(rows: pa.Table, rule: _Rule, most: int) -> Iterator[pa.RecordBatch]:
    """Counted pairs of texts on the same list that may be similar; ``rows`` are whole lists."""
    h = _Holders(rows, rule)
    _, h.token = np.unique(h.token, return_inverse=True)
    key = (h.token << 32) + h.n
    order = np.argsort(key, kind="stable")
    lead, able = np.flatnonzero(h.leads), rule.leads(h.n)
    low = np.searchsorted(key[order], key[lead])
    high = np.searchsorted(key[order], (h.token[lead] << 32) + h.n[lead] * rule.den // rule.num, side="right")
    upto, begin, found = np.cumsum(high - low), 0, []
    while begin < len(lead):  # some texts at a time against their lists
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, side="right")))
        count = (high - low)[begin:end]
        x = np.repeat(lead[begin:end], count)
        y = order[np.arange(len(x)) - np.repeat(np.cumsum(count) - count - low[begin:end], count)]
        once = (h.n[x] < h.n[y]) | (h.place[y] >= able[y]) | (h.id[x] < h.id[y])  # of equal size each may lead the other
        x, y = x[once], y[once]
        left = h.close(x, h, y)
        if len(left):
            found.append((h.id[x[left]], h.id[y[left]], 1 + rule.more(h.n[x[left]])))
        begin = end
        if sum(len(f[0]) for f in found) > PAIRS:
            yield _counted(found)
            found = []
    if found:
        yield _counted(found)


def _met(batches: Iterator[pa.RecordBatch], rule: _Rule, most: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a task's postings, which are sorted by word."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        token = batch.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1]))  # where the last list begins, which may go on
        if (cut or held[0].column("token")[0].as_py() != token[-1]) and sum(x.num_rows for x in held) >= 1 << 17:
            yield from _listed(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]), rule, most)
            held = [batch.slice(cut)]
    if held:
        yield from _listed(pa.Table.from_batches(held), rule, most)


def _long_lists(batches: Iterator[pa.RecordBatch], held, rule: _Rule, short: int) -> Iterator[pa.RecordBatch]:
    """(token, id) of words that more than ``short`` texts may have."""
    for batch in batches:
        row, token, _, _ = _spread(batch, held.value, rule, max(4, int(np.floor(4 * np.log2(short + 1.0))) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(token), batch.column("id").take(pa.array(row))], ["token", "id"])


def _led(batches: Iterator[pa.RecordBatch], held, rule: _Rule, leaders, most: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of pairs of a leader and a text that may be similar."""
    rows = pa.Table.from_batches(_posted(pa.ipc.open_stream(leaders.value), held, rule, False), schema=_schema())
    lead = _Holders(rows.sort_by("token"), rule)
    for batch in _posted(batches, held, rule, False):
        h = _Holders(pa.Table.from_batches([batch]), rule)
        low, high = (np.searchsorted(lead.token, h.token, side=side) for side in ("left", "right"))
        upto, begin = np.cumsum(high - low), 0
        while begin < len(upto):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, side="right")))
            count = (high - low)[begin:end]
            x = np.repeat(np.arange(begin, end), count)
            y = np.arange(len(x)) - np.repeat(np.cumsum(count) - count - low[begin:end], count)
            left = h.close(x, lead, y)
            if len(left):
                yield _counted([(h.id[x[left]], lead.id[y[left]], 1 + rule.more(np.minimum(h.n[x[left]], lead.n[y[left]])))])
            begin = end


def _schema() -> pa.Schema:
    return pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("leads", pa.bool_()), ("mark", pa.binary())])


def _sharing(counted: DataFrame) -> DataFrame:
    """The pairs that share as many lists as similar sets do."""
    return counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")).filter("shared >= least").select("a", "b")


def _ids(pairs: DataFrame) -> DataFrame:
    return settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")


def _overlaps(pairs: pa.Table, sets: pa.Table, rule: _Rule) -> pa.Table:
    """The similar ones of ``pairs`` (a, b), with the ``sets`` (id, s) of all their ends."""
    sets, pairs = sets.sort_by("id"), pairs.sort_by("a")
    ids, lists = sets.column("id").to_numpy(), sets.column("s").combine_chunks()
    s, n = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy().astype(np.int64)
    first = np.cumsum(n) - n
    a, b = (np.searchsorted(ids, pairs.column(c).to_numpy()) for c in ("a", "b"))
    shared, begin = np.zeros(len(a), np.int64), 0
    while begin < len(a):  # one text at a time against some of its partners
        end = min(int(np.searchsorted(a, a[begin], side="right")), begin + ROWS)
        own, of = np.sort(s[first[a[begin]] : first[a[begin]] + n[a[begin]]]), b[begin:end]
        word = s[np.arange(n[of].sum()) - np.repeat(np.cumsum(n[of]) - n[of] - first[of], n[of])]
        at = np.minimum(np.searchsorted(own, word), len(own) - 1)
        shared[begin:end] = np.bincount(np.repeat(np.arange(len(of)), n[of]), own[at] == word, len(of))
        begin = end
    return pairs.select(["a", "b"]).filter(pa.array((shared > 0) & (shared >= rule.needed(n[a], n[b]))))


def _compared(pairs: DataFrame, sets: DataFrame, rule: _Rule) -> DataFrame:
    """The similar ones of settled ``pairs``, by the words of their ``sets``.

    A text's hood is the first text that it is paired with or itself, so that copies of one text share one. Pairs meet by the hoods of both texts in a bucket, to which
    a set is sent once; a hood of very many pairs is dealt out.
    """
    ends = pairs.select(F.col("a").alias("id"), F.col("a").alias("hood")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("hood")))
    hoods = settle(ends.groupBy("id").agg(F.min("hood").alias("hood")), "hoods")
    side = lambda x: hoods.select(F.col("id").alias(x), F.col("hood").alias(f"h{x}"))
    met = settle(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.xxhash64("ha", "hb").alias("key")), "met")
    many = settle(met.groupBy("key").agg(F.floor(F.count("*") / HOOD).alias("more")).filter("more > 0"), "many")
    key = F.xxhash64("key", F.pmod(F.xxhash64("a"), F.coalesce("more", F.lit(0)) + 1))
    buckets = max(1, met.count() // ROWS, hoods.count() // (ROWS // 16))
    met = met.join(F.broadcast(many), "key", "left").select("a", "b", F.pmod(key, F.lit(buckets)).alias("bucket"))
    sent = settle(met.select("bucket", F.explode(F.array("a", "b")).alias("id")).distinct(), "sent")
    sent = sets.join(F.broadcast(sent) if sent.count() <= SENT else sent, "id").select("bucket", "id", "s")
    return met.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(lambda x, y: _overlaps(x, y, rule), _PAIR)


class Filtered:
    """``rows`` (id, kept) of every text, and how many rounds of each kind it took."""

    def __init__(self, rows: DataFrame, leading: int, edge: int):
        self.rows, self.leading, self.edge = rows, leading, edge


def first_wins(texts: DataFrame, least: float = LEAST, short: int = SHORT_LIST, most: int = PAIRS) -> Filtered:
    """The texts (id, text) with ``kept``: no kept text of a smaller id, a long, has a similarity of ``least`` or more.

    A null or blank text is similar to none and kept. Rows that repeat an id and its words count once; an id with
    several texts is judged by the words of all of them together. Words are compared as 64-bit hashes. A task holds ``most`` pairs at once.
    """
    share = Fraction(str(least))
    rule, spark = _Rule(share), texts.sparkSession
    own = small_batches(_own(texts))
    s = F.array_sort("s")
    told = settle(own.select("id", F.size("s").alias("n"), F.xxhash64(s).alias("h"), F.hash(s).alias("g"), "s").mapInArrow(_told, "id long, n int, h long, g int, part int, counts binary"), "told")
    held = spark.sparkContext.broadcast(_levels(told))
    told = told.filter("part is null")
    known = told.filter("n > 0 and id is not null")
    first = settle(known.groupBy("h", "g", "n").agg(F.min("id").alias("id")).select("id"), "first")
    copies = settle(known.select("id").join(first, "id", "left_anti"), "copies")
    own = own.filter("id is not null")
    sets = _picked(own, copies, "left_anti") if copies.count() <= first.count() else _picked(own, first)
    prefix = settle(sets.mapInArrow(functools.partial(_ordered, held=held, rule=rule), _PREFIX), "prefixes")
    kept, leading, edge = [], 0, 0

    left = prefix.count()
    while left:
        lists = prefix.mapInArrow(functools.partial(_long_lists, held=held, rule=rule, short=short), "token long, id long")
        leaders = settle(lists.groupBy("token").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter(F.col("n") > short).select("id").distinct(), "leaders")
        if not leaders.limit(1).count():
            break
        sent = _sent(_picked(prefix, leaders))
        met = settle(prefix.mapInArrow(functools.partial(_led, held=held, rule=rule, leaders=spark.sparkContext.broadcast(sent), most=most), _COUNTED).transform(_sharing), "met")
        found = settle(_compared(met, settle(_picked(own, _ids(met)), "sets"), rule), "found")
        free = settle(leaders.join(found.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "kept")
        dropped = settle(found.join(free.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "dropped")
        leading += 1
        kept.append(free)
        prefix = settle(_picked(prefix, settle(free.unionByName(dropped), "done"), "left_anti"), "prefixes")
        before, left = left, prefix.count()
        if (before - left) * SLOW < before:
            break

    lists = prefix.mapInArrow(functools.partial(_posted, held=held, rule=rule, dealt=True), _POSTING).repartition("token").sortWithinPartitions("token")
    pairs = settle(lists.mapInArrow(functools.partial(_met, rule=rule, most=most), _COUNTED).transform(_sharing), "pairs")
    waiting = _ids(pairs)
    sets = settle(_picked(own, waiting), "sets")
    kept.append(prefix.select("id").join(waiting, "id", "left_anti"))  # without a partner
    while waiting.limit(1).count():
        edge += 1
        free = settle(waiting.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "kept")
        near = settle(pairs.join(free.withColumnRenamed("id", "a"), "a", "left_semi"), "near")
        dropped = settle((_compared(near, sets, rule) if edge == 1 else near).select(F.col("b").alias("id")).distinct(), "dropped")
        kept.append(free)
        done = free.unionByName(dropped)
        waiting = settle(waiting.join(done, "id", "left_anti"), "waiting")
        pairs = settle(pairs.join(done.withColumnRenamed("id", "a"), "a", "left_anti").join(done.withColumnRenamed("id", "b"), "b", "left_anti"), "pairs")
        if edge == 1:
            pairs = settle(_compared(pairs, sets, rule), "edges")

    winners = kept[0]
    for more in kept[1:]:
        winners = winners.unionByName(more)
    rows = told.select("id", (F.col("n") == 0).alias("blank")).join(winners.withColumn("won", F.lit(True)), "id", "left")
    return Filtered(rows.select("id", (F.col("blank") | F.coalesce("won", F.lit(False))).alias("kept")), leading, edge)


def _sent(rows: DataFrame) -> bytes:
    """The leaders' prefixes as every task gets them: at most one for each list of over ``SHORT_LIST`` texts."""
    out = pa.BufferOutputStream()
    table = rows.toArrow()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table, 1 << 12)
    return out.getvalue().to_pybytes()
