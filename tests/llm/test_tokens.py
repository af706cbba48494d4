"""op2 against the sentencepiece library, op4 against the tokenizers library, op8 against all products."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from attesta.llm import pieces, token_file, topk

from .conftest import EDGES

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  two  spaces ▁x", "日本語のテキストを分割する", "\n\n\t tab", "aaaa" * 60, "🙂🙂 emoji é é", "<s> </s> <0x0A> ⁇", "x" * 700 + "!" * 90, "https://example.com/?q=1&b=2#f 3.14 ---",
    "def f(x):\n    return x**2", "\x00 \x01", "İstanbul 's don't <|endoftext|>x a\x1fb c ﬁ ǅ ½ 'S ___", "word, word. Word WORD! word###",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_library(library):
    rnd = random.Random(9)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("abcde ▁é日.\n,AB1 ") for _ in range(rnd.randrange(80))) for _ in range(300)]
    encoder = pieces.Encoder(MODEL)
    want = library.encode(texts, num_threads=1)
    got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)]
    assert got == want
    assert [encoder.pieces.decode(x) for x in want] == [library.decode(x) for x in want]


def test_search_is_the_best_path():
    """Without merges the search gives the largest sum of scores."""
    p = pieces.Pieces(MODEL)
    p.merges = False
    number = {}
    for i, s in zip(p.ids, p.score, strict=True):
        number[p.text[i].decode()] = (float(s), int(i))

    def best(x):
        score = [0.0] + [-np.inf] * len(x)
        for j in range(1, len(x) + 1):
            for i in range(max(0, j - p.longest), j):
                if x[i:j] in number:
                    score[j] = max(score[j], score[i] + number[x[i:j]][0])
        return score[-1]

    for x in ["▁the", "▁internationalization", "▁aaaaab", "abcabc", "▁x"]:
        ids = np.frombuffer(p.encode_units([x])[0], "<i4")
        assert sum(number[p.text[i].decode()][0] for i in ids) == pytest.approx(best(x))


def test_pieces_on_rows(spark, make, library):
    rows = list(enumerate(ODD)) + [r for r in EDGES if r[0] is None or r[0] > 3]
    got = pieces.tokenise(make(rows), MODEL).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_tokens"], list(r["ids"]), r["ids_crc32"], r["round_trip"]))
    for i, t in rows:
        ids = library.encode(t or "")
        assert (len(ids), ids, zlib.crc32(np.array(ids, "<i4").tobytes()), library.decode(ids) == (t or "")) in by[i]
    assert pieces.tokenise(make(rows).limit(0), MODEL).count() == 0


def test_code_round_trip():
    rnd = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), np.array([0], np.uint32), rnd.integers(0, 1 << 8, 3000), rnd.integers(0, 1 << 16, 5000), rnd.integers(0, 1 << 32, 4000), np.array([255, 256, 65535, 65536, (1 << 32) - 1])):
        ids = ids.astype(np.uint32)
        b = token_file.Block(token_file.pack(np.array([5]), np.array([len(ids)]), ids))
        assert np.array_equal(b.tokens(), ids) and b.n_tokens == len(ids)
        for i in {0, 1, 7, 511, 512, 513, len(ids) - 1} & set(range(len(ids))):
            assert b.token(i) == ids[i]
    with pytest.raises(ValueError):
        token_file.Block(b"nope" + bytes(40))


def test_token_file(spark, make, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 50)
    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [r for r in EDGES if r[0] != 5] + [(5, "b"), (5, "a")]
    want, ids = [], []
    hashed = {r["text"]: r["h"] for r in make(rows).select("text", F.xxhash64("text").alias("h")).collect()}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]], r[1] is not None, (r[1] or "").encode())):
        own = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, len(ids), len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        ids += own
    path = token_file.write_tokens(make(rows).repartition(3), WORDS)
    got = [tuple(r) for r in token_file.read_documents(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    back = token_file.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    assert [x for r in back for x in r["ids"]] == ids
    places = [0, 1, len(ids) // 2, len(ids) - 1]
    assert token_file.read_at(spark, path, [*places, 1, -1, len(ids)]) == {p: ids[p] for p in places}
    empty = token_file.write_tokens(make(rows).limit(0), WORDS)
    assert token_file.read_documents(spark, empty).count() == 0 and token_file.read_at(spark, empty, [0]) == {}


def brute_topk(rows, every, k):
    import math

    v = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block, k", [(4096, 5), (16, 5), (16, 300), (4096, 1)])
def test_topk_equals_all_products(spark, block, k):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(24)]) for i in range(150)]
    rows += [(1000 + i, [0.5] * 24) for i in range(20)] + [(2000, None), (2001, [None] * 24), (2050, [float("nan")] * 24), (2100, [float("inf")] + [0.0] * 23), (2150, [0.0] * 24), (2151, [0.25, 0.5]), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, rank int, query_id string")
    v = topk.integer_vectors(df)
    got = topk.top_k(v.filter("vec_id % 50 = 0"), v, k, block)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows, 50, k)


def test_topk_repeats_and_empty(spark):
    v = spark.createDataFrame([(0, [1, 2]), (0, [1, 2]), (1, [3, 4]), (1, [3, 4])], "vec_id long, v array<long>")
    assert [tuple(r) for r in topk.top_k(v.filter("vec_id = 0"), v).collect()] == [(0, 1, 1, 11)]
    assert topk.top_k(v.filter("vec_id = 0"), v.filter("vec_id = 0")).count() == 0
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_topk_of_padded_and_wide_vectors(spark, monkeypatch):
    """Rows of one id are queries of their own even where one is the other with zeros after it; wide vectors make smaller blocks, not other results."""
    rows = [(50, [1]), (50, [1, 0]), (1, [3, 1]), (2, [2]), (3, [-1, 5])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(v.filter("vec_id = 50"), v, 2).collect())
    assert got == [(50, 1, 1, 3), (50, 1, 1, 3), (50, 2, 2, 2), (50, 2, 2, 2)]
    rng = np.random.default_rng(4)
    wide = spark.createDataFrame([(i, rng.integers(-50, 50, 3000).tolist()) for i in range(120)], "vec_id long, v array<long>")
    whole = sorted(tuple(r) for r in topk.top_k(wide.filter("vec_id % 40 = 0"), wide).collect())
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 3000 * 7)
    assert topk._blocks(wide, 4096) == 18 and sorted(tuple(r) for r in topk.top_k(wide.filter("vec_id % 40 = 0"), wide).collect()) == whole


def test_topk_sql(spark, sf, duck):
    want = [tuple(r) for r in duck.execute(topk.OP8_SQL).fetchall()]
    assert sorted(tuple(r) for r in topk.op8_exact_topk(spark, sf).collect()) == sorted(want)
