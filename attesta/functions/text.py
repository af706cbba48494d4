"""Text functions as Column expressions; the few that need Unicode rules Spark lacks are pandas UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
ASCII_TOKEN = r"([a-z0-9]+(?:[._/-][a-z0-9]+)*)"
ANY_TOKEN = r"([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*)"
CJK_RUN = r"([\x{4e00}-\x{9fff}]+)"
STOPWORDS = ["the", "and", "or", "a", "an", "of", "to", "in", "for", "with", "is", "are", "be", "by", "that", "this", "from", "as", "can", "will", "it", "its", "on"]
STOP_BIGRAMS = ["因为", "所以", "可以", "通过", "进行", "一个", "这种", "具有", "用于", "以及", "需要", "能够", "实现", "其中", "相关", "系统"]
ANCHORS = ["2.5d", "3d", "键合", "检测", "市场", "财务", "国产", "政策"]
COMPANIES = ["长电科技", "通富微电", "中微公司", "北方华创"]
NEWS_CATEGORIES = [
    ("政策", ["政策", "通知", "意见", "办法", "规定", "条例", "规划", "法规"]),
    ("纪要", ["纪要", "会议", "座谈", "研讨"]),
    ("研报", ["研报", "研究报告", "分析报告", "白皮书", "行业报告"]),
]
LINK_SOURCES = [
    ("gov.cn", "政府网站"), ("xinhuanet.com", "新华网"), ("people.com.cn", "人民网"), ("mot.gov.cn", "交通运输部"),
    ("ndrc.gov.cn", "国家发改委"), ("miit.gov.cn", "工信部"), ("163.com", "网易"), ("sohu.com", "搜狐"),
    ("sina.com", "新浪"), ("qq.com", "腾讯"), ("baidu.com", "百度"),
]
DEPARTMENTS = ["国务院", "交通运输部", "工信部", "发改委", "科技部", "住建部", "公安部", "财政部", "自然资源部", "工业和信息化部", "国家发展改革委", "交通运输厅"]
UNIT = "万亿元|千亿元|百万元|千万元|亿元|百亿|万亿|千亿|十亿|万元|兆|千万|百|十|万|千|元|%|个百分点|个|件|人|台|套|根|米|公里|千克|吨|倍|美元|人民币|亿"
METRIC = r"([\x{4e00}-\x{9fff}A-Za-z]{3,12}(?:率|占比|增速|规模|数量|金额|收入|利润|市值)?(?:\d{4}年)?(?:\d{1,2}月)?)"
REFUSALS = ["无法", "没有找到", "未找到", "资料不足", "不足以", "无相关", "不能确定", "未提供"]


def _lits(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# tokens


def ascii_tokens(c: Column) -> Column:
    """Lower-case technical tokens in order, such as ``ieee-1149.1``."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(ASCII_TOKEN), 1)


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(blank(c), F.lit(ANY_TOKEN), 1)


def cjk_bigrams(c: Column, single: bool = True) -> Column:
    """Character pairs of every run of CJK ideographs; with ``single`` a run of one stays."""
    def pairs(run: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(F.length(run) > 1, many).otherwise(F.array(run) if single else F.array().cast("array<string>"))

    return F.flatten(F.transform(F.regexp_extract_all(blank(c), F.lit(CJK_RUN), 1), pairs))


def terms(c: Column) -> Column:
    return F.array_distinct(F.concat(ascii_tokens(c), cjk_bigrams(c)))


def coverage(wanted: Column, held: Column) -> Column:
    """Share of the wanted terms that are held; 0 where none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, held)) / F.size(F.array_distinct(wanted))).otherwise(0.0)


def _contained(tokens: Column, content: Column) -> Column:
    """Share of the tokens that occur in the content; null where there are none."""
    low = F.lower(blank(content))
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.contains(low, F.lower(t)))) / F.size(tokens))


def technical_exact_score(question: Column, content: Column) -> Column:
    """Containment of exact terms: tokens with ``_``, or of two characters or more in capitals with a letter. Null: not applicable."""
    exact = F.filter(raw_tokens(question), lambda t: F.contains(t, F.lit("_")) | ((F.length(t) >= 2) & (F.upper(t) == t) & t.rlike("[A-Z]")))
    underscored = F.regexp_extract_all(blank(question), F.lit(r"([A-Za-z0-9]+(?:_[A-Za-z0-9]+)+)"), 1)
    return _contained(F.array_distinct(F.concat(exact, underscored)), content)


def strict_identifier_score(question: Column, content: Column) -> Column:
    """Containment of identifiers: first a letter, with a digit and one of ``_ - /``. Null: not applicable."""
    ids = F.filter(raw_tokens(question), lambda t: t.rlike("^[A-Za-z]") & t.rlike("[0-9]") & t.rlike("[_/-]"))
    return _contained(F.array_distinct(ids), content)


def passes_strict(score: Column) -> Column:
    return score.isNull() | (score > 0)


def focus_coverage(focus: Column, content: Column, as_given: bool = False) -> Column:
    """Share of the phrases that occur in the content after white space is collapsed, in the phrases too unless they are taken ``as_given``."""
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    text = squeeze(blank(content))
    return F.when(F.size(focus) > 0, F.size(F.filter(focus, lambda t: F.contains(text, F.lower(t) if as_given else squeeze(t)))) / F.size(focus)).otherwise(0.0)


def support_tokens(c: Column) -> Column:
    ascii_ = F.filter(ascii_tokens(c), lambda t: (F.length(t) >= 2) & ~F.array_contains(_lits(STOPWORDS), t))
    return F.array_distinct(F.concat(ascii_, F.array_except(cjk_bigrams(c, single=False), _lits(STOP_BIGRAMS))))


def lexical_support(claim: Column, evidence: Column) -> Column:
    return coverage(support_tokens(claim), support_tokens(evidence))


def required_identifiers(c: Column) -> Column:
    """Tokens a claim must share with its evidence: with ``_`` or a digit, or two capitals or more."""
    return F.array_distinct(F.transform(
        F.filter(raw_tokens(c), lambda t: F.contains(t, F.lit("_")) | t.rlike("[0-9]") | ((F.length(t) >= 2) & (F.upper(t) == t))), F.lower
    ))


def source_terms(c: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(blank(c)), F.lit("([a-z0-9][a-z0-9.+%-]*)"), 1), cjk_bigrams(c, single=False)))


def source_score(question: Column, haystack: Column) -> Column:
    """Coverage plus 0.2 for every shared anchor and 0.6 for every shared company."""
    q, h = F.lower(blank(question)), F.lower(blank(haystack))
    score = coverage(source_terms(question), source_terms(haystack))
    for a in ANCHORS:
        score = score + F.when(F.contains(q, F.lit(a)) & F.contains(h, F.lit(a)), 0.2).otherwise(0.0)
    for a in COMPANIES:
        score = score + F.when(F.contains(blank(question), F.lit(a)) & F.contains(blank(haystack), F.lit(a)), 0.6).otherwise(0.0)
    return F.when(F.size(source_terms(question)) > 0, score).otherwise(0.0)


# similarity


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(both_empty)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(blank(c)), r"\s+"), lambda w: w != ""))


def question_key(c: Column) -> Column:
    """Lower case without anything but letters, digits and ``_`` of any script."""
    return F.regexp_replace(F.lower(blank(c)), r"(?U)[^\w]+", "")


def char_ngrams(c: Column, size: int = 3) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size)))
    return F.array_distinct(F.when(F.length(c) >= size, grams).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>")))


# normal forms and hashes


def normalise_lower(c: Column) -> Column:
    """The built-in variant: lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(blank(c)), r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Compatibility characters in their plain form; null is empty."""
    return c.fillna("").map(lambda x: unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def normalise_evidence(c: pd.Series) -> pd.Series:
    """Case folding, white space collapsed and trimmed, no NFKC; null is empty."""
    return c.fillna("").map(lambda x: " ".join(x.casefold().split()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalise_quotes(c: pd.Series) -> pd.Series:
    """The same for each of an array's texts."""
    return c.map(lambda texts: [" ".join((x or "").casefold().split()) for x in texts])


@F.pandas_udf(T.StringType())
def normalise_text(c: pd.Series) -> pd.Series:
    """NFKC, case folding, white space collapsed and trimmed; null is empty."""
    return c.fillna("").map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields joined by the unit separator; fields are normalised by the caller."""
    return F.sha2(F.concat_ws("\u001f", *[blank(f) for f in fields]), 256)


def news_key(title: Column, content: Column, publisher: Column, time: Column) -> Column:
    return content_hash(F.lit("news"), *[normalise_lower(x) for x in (title, content, publisher, time)])


def bidding_key(bid_id: Column, title: Column, province: Column, time: Column) -> Column:
    return content_hash(F.lit("bidding"), *[normalise_lower(x) for x in (bid_id, title, province, time)])


def chunk_id(filename: Column, index: Column, chunk: Column) -> Column:
    return F.md5(F.concat_ws("_", filename, index.cast("string"), F.substring(chunk, 1, 50)))


def stable_id(c: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(c)), 256), 1, 20)


def query_hash(c: Column) -> Column:
    return F.md5(F.lower(F.trim(c)))


def fact_fingerprint(c: Column) -> Column:
    """md5 of the first three numbers and the first five CJK runs of two to four, 16 digits."""
    numbers = F.slice(F.regexp_extract_all(blank(c), F.lit(r"(\d+\.?\d*)"), 1), 1, 3)
    words = F.slice(F.regexp_extract_all(blank(c), F.lit(r"([\x{4e00}-\x{9fff}]{2,4})"), 1), 1, 5)
    return F.substring(F.md5(F.concat(F.array_join(numbers, "_"), F.lit("|"), F.array_join(words, "_"))), 1, 16)


# labels


def _first_match(text: Column, rules: list, otherwise: Column) -> Column:
    out = None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(otherwise)


def news_category(title: Column, content: Column) -> Column:
    return _first_match(F.lower(F.concat_ws(" ", blank(title), blank(content))), NEWS_CATEGORIES, F.lit("新闻"))


def department(title: Column, content: Column) -> Column:
    return _first_match(F.concat_ws(" ", blank(title), blank(content)), [(d, [d]) for d in DEPARTMENTS], F.lit(None).cast("string"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(blank(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def link_source(url: Column) -> Column:
    """Name of a known site, by the first of an ordered list that the host contains; else the host's last two labels."""
    host = url_host(url)
    last = F.array_join(F.slice(F.split(host, r"\."), F.greatest(-F.size(F.split(host, r"\.")), F.lit(-2)), 2), ".")
    return F.when(blank(url) == "", F.lit("未知来源")).otherwise(_first_match(host, [(n, [k]) for k, n in LINK_SOURCES], last))


def allowed_domain(url: Column, domains: list[str]) -> Column:
    host = url_host(url)
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host == d) | host.endswith("." + d)
    return hit


def stock_code(c: Column) -> Column:
    """``sh`` or ``sz`` with six digits, from a bare or prefixed code; null where it is none."""
    low = F.lower(F.trim(blank(c)))
    full = (
        F.when(low.rlike("^(sh|sz)[0-9]{6}$"), low).when(low.rlike("^6[0-9]{5}$"), F.concat(F.lit("sh"), low)).when(low.rlike("^[03][0-9]{5}$"), F.concat(F.lit("sz"), low))
    )
    return full


def collection_base(c: Column, default: str = "knowledge_base") -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(base == "", F.lit(default)).otherwise(base)


def html_to_text(c: Column, most: int | None = None) -> Column:
    """The pattern tier: no scripts and styles, tags to spaces, five entities, white space collapsed; the first ``most`` characters, if given."""
    out = F.regexp_replace(blank(c), r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return out if most is None else F.substring(out, 1, most)


def numeric_units(c: Column) -> Column:
    """(raw, value, unit) of every number that has a unit."""
    pattern = rf"(-?\d+(?:\.\d+)?\s*(?:{UNIT}))"
    raw = F.regexp_extract_all(blank(c), F.lit(pattern), 1)
    return F.transform(raw, lambda r: F.struct(
        r.alias("raw"), F.regexp_extract(r, r"^(-?\d+(?:\.\d+)?)", 1).cast("double").alias("value"), F.regexp_extract(r, rf"({UNIT})$", 1).alias("unit")
    ))


def bucket_key(content: Column, raw: Column) -> Column:
    """The longest word of 2 to 12 letters within 12 characters of the first place of ``raw``; the first of equals, else ``raw``."""
    at = F.position(raw, content)
    begin = F.greatest(at - 12, F.lit(1))
    window = F.substr(content, begin, at + F.length(raw) + 12 - begin)
    words = F.regexp_extract_all(window, F.lit(r"([\x{4e00}-\x{9fff}A-Za-z]{2,12})"), 1)
    best = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.when(at <= 0, F.lit("")).when(best == "", raw).otherwise(best)


def metric_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(blank(c), F.lit(METRIC), 1))


def refuses(c: Column) -> Column:
    return blank(c).rlike("|".join(REFUSALS))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(blank(c), r"(?<=[。！？!?.\n])\s*"), F.trim), lambda s: s != "")


def citation_markers(c: Column) -> Column:
    """Ids in ``[[id]]`` and ``[En]`` marks, in order."""
    return F.regexp_extract_all(blank(c), F.lit(r"\[\[?([^\[\]]+)\]\]?"), 1)


def token_estimate(c: Column) -> Column:
    """A third of the characters, one at least; 0 for an empty text."""
    return F.when(F.length(blank(c)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 3))).cast("long")


# dates


def parse_datetime(c: Column) -> Column:
    """The first of eight formats that fits, after fractions and offsets are cut; no time zone."""
    cut = F.substring_index(F.substring_index(blank(c), ".", 1), "+", 1)
    formats = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyy年MM月dd日"]
    return F.coalesce(*[F.try_to_timestamp(cut, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_iso(c: Column) -> Column:
    """ISO 8601; without an offset it is UTC (the session's time zone)."""
    return c.try_cast("timestamp")


def snippet_date(c: Column) -> Column:
    """The first year-month-day in a snippet with a year from 2020 to 2030."""
    parts = [F.regexp_extract(blank(c), r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})", i) for i in (1, 2, 3)]
    year = parts[0].try_cast("int")
    date = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")).try_cast("date")
    return F.when(year.between(2020, 2030), date)


def replace_each(source: Column, found: Column, by) -> Column:
    """``source`` with every one of the literal strings ``found`` replaced by what ``by`` makes of it."""
    return F.aggregate(F.array_distinct(found), blank(source), lambda out, x: F.replace(out, x, by(x)))


def strip_citations(source: Column, references: Column) -> Column:
    """Removes ``[[n]]`` marks outside 1..references."""
    marks = F.regexp_extract_all(blank(source), F.lit(r"(\[\[\d+\]\])"), 1)
    number = lambda m: F.regexp_extract(m, r"\d+", 0).try_cast("long")
    bad = F.filter(marks, lambda m: ~F.coalesce(number(m).between(1, F.coalesce(references, F.lit(0))), F.lit(False)))
    return replace_each(source, bad, lambda m: F.lit(""))


def valid_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), F.lit(False))


# fixed values, in order
SEARCH_PATTERNS = ["搜索[「\"'【](.+?)[」\"'】]", "查找[「\"'【](.+?)[」\"'】]", "搜索关于(.+?)的", "查询(.+?)的信息", "了解(.+?)的", "获取(.+?)的"]


def search_query(thought: Column) -> Column:
    """What a thought wants to search for, by the first pattern that fits; null: none."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(blank(thought), p, 1)), F.lit("")) for p in SEARCH_PATTERNS])
