"""Evaluation of retrieval and answers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

DIGITS = 9


SHARE = 0.0005  # of a group's rows on either side of a wanted place that are put in order; the sketch errs by a fifth of it
_ACCURACY = 10_000


def order_statistics(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, Column]]) -> DataFrame:
    """(by, n, and a column for each of ``wanted``): values at exact places of each group's ascending order.

    ``wanted`` has the share of the group where a value lies and its place from 1, a Column of ``n``, the number of
    the group's values. A quantile sketch brackets each place; values below a bracket are counted and only those
    within it are put in order, each distinct value once with its count, so that neither a large group, or a table that is one
    group, nor a value that most rows repeat is sorted in one task. A bracket that misses its place is widened to the
    whole group's distinct values.
    """
    names = list(wanted)
    rows = df.select(*by, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    sketch = lambda q: F.percentile_approx("_v", F.lit(min(1.0, max(0.0, q))), F.lit(_ACCURACY))
    ends = [F.struct(sketch(q - SHARE).alias("a"), sketch(q + SHARE).alias("b")).alias(f"_{i}") for i, (q, _) in enumerate(wanted.values())]
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), *ends).filter("n > 0")
    near = rows.join(groups, by) if by else rows.join(F.broadcast(groups))  # one row
    below = near.groupBy(*by).agg(*[F.count_if(F.col("_v") < F.col(f"_{i}.a")).alias(f"_l{i}") for i in range(len(names))], *[F.count_if(F.col("_v") <= F.col(f"_{i}.b")).alias(f"_u{i}") for i in range(len(names))])
    met = groups.join(below, by) if by else groups.join(F.broadcast(below))
    for i, (_, place) in enumerate(wanted.values()):
        inside = (F.col(f"_l{i}") < place) & (place <= F.col(f"_u{i}"))
        met = met.withColumn(f"_p{i}", place - F.when(inside, F.col(f"_l{i}")).otherwise(0)).withColumn(f"_{i}", F.when(inside, F.col(f"_{i}")))
    facts = met.select(*by, "n", *[c for i in range(len(names)) for c in (f"_{i}", f"_p{i}")])
    held = rows.join(facts, by) if by else rows.join(F.broadcast(facts))
    hits = F.array(*[F.when(F.col(f"_{i}").isNull() | F.col("_v").between(F.col(f"_{i}.a"), F.col(f"_{i}.b")), F.struct(F.lit(i).alias("i"), F.col(f"_p{i}").alias("p"))) for i in range(len(names))])
    few = held.select(*by, "n", "_v", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x")).select(*by, "n", "_v", "x.i", "x.p")
    counted = few.groupBy(*by, "n", "i", "p", "_v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy("_v"))
    ranked = counted.withColumn("r", upto).filter((F.col("r") - F.col("c") < F.col("p")) & (F.col("p") <= F.col("r")))
    return ranked.groupBy(*by, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)])


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(by, q, value): the ``ceil(q * n)``-th smallest value of each group, the first at least."""
    wanted = {f"v{i}": (q, F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))) for i, q in enumerate(quantiles)}
    found = order_statistics(df, by, value, wanted)
    return found.select(*by, F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"v{i}").alias("value")) for i, q in enumerate(quantiles)])))


def answer_latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50 at place ``(n - 1) // 2`` and p95 at place ``int(n * 0.95 + 0.999) - 1``, places from 0; nulls count and come first."""
    low = F.lit(float("-inf"))
    places = {"p50": (0.5, F.floor((F.col("n") - 1) / 2) + 1), "p95": (0.95, F.greatest(F.lit(1), F.floor(F.col("n") * 0.95 + 0.999)))}
    found = order_statistics(df.withColumn(value, F.coalesce(F.col(value).cast("double"), low)), by, value, places)
    return found.select(*by, "n", *[F.nullif(F.col(c), low).alias(c) for c in places])


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, first_hit, rr, ndcg, recall) over distinct documents.

    ``ranked``: query_id, doc_id, rank (chunks; a document counts at its first); ``gold``: query_id, doc_id.
    """
    docs = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    docs = docs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    gold = gold.distinct()
    hits = docs.join(gold, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("place").alias("first"), F.sum(1 / F.log2(F.col("place") + 1)).alias("dcg"), F.count("*").alias("hits"))
    wanted = gold.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return wanted.join(hits, "query_id", "left").select(
        "query_id", F.col("first").cast("long").alias("first_hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), DIGITS).alias("rr"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), DIGITS).alias("ndcg"), F.round(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)), DIGITS).alias("recall"),
    )


def group_coverage(groups: Column, content: Column) -> Column:
    """Share of term groups of which any term occurs in the content."""
    low = F.lower(text.blank(content))
    met = F.filter(groups, lambda g: F.exists(g, lambda t: F.contains(low, F.lower(t))))
    return F.when(F.size(groups) > 0, F.size(met) / F.size(groups)).otherwise(1.0)


def verdicts(cases: DataFrame) -> DataFrame:
    """Adds ``passed``: found what was expected, all expected terms, enough groups, and a gold source.

    ``cases``: expected_retrieval, retrieved (count), evidence, expected_terms, required_term_groups,
    min_group_coverage, gold, found (arrays of documents).
    """
    low = F.lower(text.blank(F.col("evidence")))
    terms = F.forall("expected_terms", lambda t: F.contains(low, F.lower(t)))
    gold = (F.size("gold") == 0) | (F.size(F.array_intersect("gold", "found")) > 0)
    enough = group_coverage(F.col("required_term_groups"), F.col("evidence")) >= F.coalesce("min_group_coverage", F.lit(1.0))
    right = F.col("expected_retrieval") == (F.col("retrieved") > 0)
    return cases.withColumn("passed", right & (~F.col("expected_retrieval") | (terms & enough & gold)))


def pass_rates(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), DIGITS).alias("rate"))


def against_first(runs: DataFrame, by: str, first: str, metric: str) -> DataFrame:
    """Each scenario's metric and its difference from the first scenario's."""
    base = runs.filter(F.col(by) == first).select(F.col(metric).alias("base"))
    return runs.join(F.broadcast(base)).withColumn("delta", F.round(F.col(metric) - F.col("base"), DIGITS)).drop("base")  # one row


def load_summary(requests: DataFrame, seconds: Column) -> DataFrame:
    """One row of requests (ok, good, latency): rates, throughput and nearest-rank percentiles."""
    stats = requests.agg(
        F.count("*").alias("n"), F.round(F.avg((~F.col("ok")).cast("double")), DIGITS).alias("error_rate"), F.round(F.avg(F.col("good").cast("double")), DIGITS).alias("quality_rate"),
        F.round(F.count("*") / seconds, DIGITS).alias("throughput"), F.round(F.avg("latency"), DIGITS).alias("mean"),
    )
    places = {f"p{int(100 * q)}": (q, F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))) for q in (0.5, 0.95, 0.99)}
    return stats.join(F.broadcast(order_statistics(requests, [], "latency", places).drop("n")))  # one row each


def distribution_faults(cases: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """(by, n, expected) of categories whose count is not the expected one."""
    return cases.groupBy(by).agg(F.count("*").alias("n")).join(expected, by, "full_outer").filter(~F.col("n").eqNullSafe(F.col("expected")))


def leaked_fields(rows: DataFrame, private: DataFrame) -> DataFrame:
    """(field): private fields (field) among the columns of a public table."""
    return private.select("field").distinct().filter(F.col("field").isin(rows.columns))


def missing_gold(gold: DataFrame, available: DataFrame) -> DataFrame:
    """(case_id, kind, missing): gold evidence ids that are not available, for each kind."""
    lost = gold.join(available, ["kind", "evidence_id"], "left_anti")
    return lost.groupBy("case_id", "kind").agg(F.sort_array(F.collect_set("evidence_id")).alias("missing"))


def budget_matrix(paths: DataFrame, ratios: list[float], window: int) -> DataFrame:
    """(path, ratio, input_tokens): every path (path) at every ratio of the window, for ``budget.context_budget``."""
    at = F.explode(F.array(*map(F.lit, ratios))).alias("ratio")
    return paths.select("path", at).withColumn("input_tokens", F.floor(F.lit(window) * F.col("ratio")))


def group_support(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, groups, matched, cited, supported) of answers against their required term groups.

    ``cases``: case_id, answer, required_term_groups; ``documents``: case_id, citation_id, content. A group is
    matched by a sentence with one of its terms, cited if such a sentence has a mark ``[[n]]``, supported if a
    cited document holds one of its terms. Marks behind a full stop belong to the sentence before it.
    """
    attached = F.regexp_replace(text.blank(F.col("answer")), r"([。！？.!?])[ \t]*((?:\[\[\d+\]\][ \t]*)+)", "$2$1")
    groups = cases.select("case_id", F.posexplode("required_term_groups").alias("g", "terms"), attached.alias("answer"))
    low = F.transform("terms", F.lower)
    has = lambda body: F.exists("low", lambda t: F.contains(F.lower(body), t))
    sentences_ = groups.withColumn("low", low).select("case_id", "g", "low", F.explode_outer(text.sentences(F.col("answer"))).alias("s"))
    met = sentences_.withColumn("hit", F.coalesce(has(F.col("s")), F.lit(False))).withColumn("marks", F.when(F.col("hit"), F.regexp_extract_all("s", F.lit(r"\[\[(\d+)\]\]"), 1)).otherwise(F.array().cast("array<string>")))
    own = met.groupBy("case_id", "g", "low").agg(F.max("hit").alias("matched"), F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"))
    cited = own.select("case_id", "g", "low", F.explode("marks").alias("citation_id")).withColumn("citation_id", F.col("citation_id").cast("int")).join(documents, ["case_id", "citation_id"])
    supported = cited.filter(has(F.col("content"))).select("case_id", "g").distinct().withColumn("supported", F.lit(True))
    return own.join(supported, ["case_id", "g"], "left").groupBy("case_id").agg(
        F.count("*").alias("groups"), F.count_if("matched").alias("matched"), F.count_if(F.col("matched") & (F.size("marks") > 0)).alias("cited"), F.count_if(F.coalesce("supported", F.lit(False))).alias("supported")
    )


GATES = ["no_errors", "retrieval", "coverage", "citation", "citation_support", "gold_retrieved", "gold_cited", "refusal", "no_forbidden"]


def answer_verdicts(cases: DataFrame) -> DataFrame:
    """Adds a boolean for each of ``GATES``, quality_passed (all of them), latency_ok and passed.

    ``cases``: answer, errors, documents (counts), expected_retrieval, must_cite, must_not_cite, must_refuse (null: as
    retrieval is expected, or not), required_term_groups, min_group_coverage, support_coverage, min_support, gold_retrieved,
    gold_cited, gold_required, refusal (the text of one), forbidden_terms, latency, max_latency.
    """
    expected, low = F.coalesce("expected_retrieval", F.lit(True)), F.lower(text.blank(F.col("answer")))
    marks = F.transform(F.regexp_extract_all(text.blank(F.col("answer")), F.lit(r"\[\[(\d+)\]\]"), 1), lambda m: m.try_cast("long"))
    inside = F.forall(marks, lambda m: F.coalesce(m.between(1, F.col("documents")), F.lit(False)))
    must, never = F.coalesce("must_cite", expected), F.coalesce("must_not_cite", ~expected)
    support = F.coalesce("min_support", F.when(must, F.coalesce("min_group_coverage", F.lit(1.0))).otherwise(1.0))
    gates = {
        "no_errors": F.col("errors") == 0, "retrieval": (F.col("documents") > 0) == expected, "coverage": group_coverage(F.col("required_term_groups"), F.col("answer")) >= F.coalesce("min_group_coverage", F.lit(1.0)),
        "citation": inside & (~must | (F.size(marks) > 0)) & (~never | (F.size(marks) == 0)), "citation_support": F.col("support_coverage") >= support, "gold_retrieved": F.col("gold_retrieved"),
        "gold_cited": F.col("gold_cited") | ~F.coalesce("gold_required", F.lit(False)), "refusal": ~F.coalesce("must_refuse", F.lit(False)) | F.contains(text.blank(F.col("answer")), F.col("refusal")),
        "no_forbidden": ~F.exists("forbidden_terms", lambda t: F.contains(low, F.lower(t))),
    }
    out = cases.withColumns({f"{g}_ok": v for g, v in gates.items()})
    quality = F.forall(F.array(*[F.col(f"{g}_ok") for g in GATES]), lambda x: x)
    return out.withColumns({"quality_passed": quality, "latency_ok": F.col("latency") <= F.col("max_latency")}).withColumn("passed", F.col("quality_passed") & F.col("latency_ok"))


CHECKS = ["tools", "gold_recall", "kinds", "citations", "locators", "refusal", "inference", "conflict"]


def joint_checks(runs: DataFrame) -> DataFrame:
    """Adds a boolean for each of ``CHECKS`` and passed to runs of multi-source cases.

    ``runs``: expected_tools, tools, gold, retrieved, cited, expected_kinds, kinds (arrays), locators (whether every citation has
    one of its own kind), refused, expected_refusal, inference_labelled, conflict_required, conflict_disclosed. News is met by policy.
    """
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    kinds = F.forall("expected_kinds", lambda k: F.array_contains("kinds", k) | ((k == "news") & F.array_contains("kinds", "policy")))
    checks = {
        "tools": within("expected_tools", "tools") & within("tools", "expected_tools"), "gold_recall": within("gold", "retrieved"), "kinds": kinds, "citations": F.col("refused") | within("gold", "cited"),
        "locators": F.col("refused") | F.col("locators"), "refusal": F.col("refused") == F.col("expected_refusal"), "inference": F.col("inference_labelled"), "conflict": ~F.col("conflict_required") | F.col("conflict_disclosed"),
    }
    out = runs.withColumns({f"{c}_ok": v for c, v in checks.items()})
    return out.withColumn("passed", F.forall(F.array(*[F.col(f"{c}_ok") for c in CHECKS]), lambda x: x))


def joint_report(checked: DataFrame) -> DataFrame:
    """(check, rate) of joint checks over all runs, and of passing all of them."""
    rates = F.array(*[F.struct(F.lit(c).alias("check"), F.round(F.avg(F.col(f"{c}_ok" if c != "passed" else c).cast("double")), DIGITS).alias("rate")) for c in [*CHECKS, "passed"]])
    return checked.agg(rates.alias("r")).select(F.inline("r"))


def case_availability(cases: DataFrame, gold: DataFrame, held: DataFrame) -> DataFrame:
    """(case_id, missing, available) of every case: how many of its gold rows (case_id, source, id) the tables (source, id) do not hold."""
    absent = gold.select("case_id", "source", "id").distinct().join(held.select("source", "id").distinct(), ["source", "id"], "left_anti").groupBy("case_id").agg(F.count("*").alias("missing"))
    out = cases.select("case_id").distinct().join(absent, "case_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return out.withColumn("available", F.col("missing") == 0)


REPORT_GATES = ["adapter_conversion", "contract_validation", "eval_structure", "case_availability", "end_to_end_execution"]


def joint_gates(conversions: DataFrame, evidence: DataFrame, cases: DataFrame, available: DataFrame, checked: DataFrame, required: dict[str, int], least: int) -> DataFrame:
    """(gate, met, n, passed) of each of ``REPORT_GATES`` and overall: how many of n met it.

    ``conversions``: source, input, converted, all of which must be converted and some be there; ``evidence``: valid, all of them;
    ``cases``: case_id, category, as many of each category as ``required`` and ``least`` in all; ``available`` of ``case_availability``, all and
    ``least`` of them; ``checked``: passed, exactly ``least`` and all of them. A null flag is not met.
    """
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))

    def gate(name: str, counts: DataFrame, passed) -> DataFrame:
        return counts.select(F.lit(name).alias("gate"), F.col("met").cast("long").alias("met"), F.col("n").cast("long").alias("n"), passed.alias("passed"))

    met, n = F.col("met"), F.col("n")
    per = [F.count_if(F.col("category") == c) == w for c, w in required.items()]
    structure = cases.agg(F.count("*").alias("n"), sum((p.cast("int") for p in per), F.lit(0)).alias("met"))
    rows = [
        gate("adapter_conversion", conversions.agg(total("converted").alias("met"), total("input").alias("n")), (met >= n) & (n > 0)),
        gate("contract_validation", evidence.agg(flag("valid").alias("met"), F.count("*").alias("n")), (met == n) & (n > 0)),
        gate("eval_structure", structure, (met == len(required)) & (n >= least)),
        gate("case_availability", available.agg(flag("available").alias("met"), F.count("*").alias("n")), (met == n) & (met >= least)),
        gate("end_to_end_execution", checked.agg(flag("passed").alias("met"), F.count("*").alias("n")), (met == n) & (n == least)),
    ]
    five = functools.reduce(DataFrame.unionByName, rows)
    whole = five.agg(F.count_if("passed").alias("met"), F.count("*").alias("n"))
    return five.unionByName(gate("overall", whole, met == n))


def set_issues(cases: DataFrame, domains: dict[str, str], splits: list[str]) -> DataFrame:
    """(id, code) of an evaluation set's faults; columns id, domain, knowledge_base, question, split, expected_retrieval, required_term_groups, gold_sources, must_cite, min_group_coverage.

    ``domains``: the knowledge base of each. A repeated id has one row; of equal questions all but the one of the
    smallest id are named.
    """
    base = F.create_map(*[F.lit(x) for kv in domains.items() for x in kv])[F.col("domain")] if domains else F.lit(None).cast("string")
    own = cases.withColumns({
        "_copies": F.count("*").over(Window.partitionBy("id")), "_n": F.row_number().over(Window.partitionBy(text.question_key(F.col("question"))).orderBy("id")),
    })
    positive, cover = F.coalesce("expected_retrieval", F.lit(False)), F.col("min_group_coverage")
    no = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    rules = [
        ("missing_id", text.blank(F.col("id").cast("string")) == ""), ("duplicate_id", F.col("_copies") > 1), ("invalid_domain", base.isNull()), ("knowledge_base_mismatch", ~F.col("knowledge_base").eqNullSafe(base) & base.isNotNull()),
        ("short_question", F.length(F.trim(text.blank(F.col("question")))) < 8), ("duplicate_question", F.col("_n") > 1), ("invalid_split", F.col("split").isNotNull() & ~F.col("split").isin(splits)),
        ("missing_expectation", F.col("expected_retrieval").isNull()), ("missing_terms", positive & no("required_term_groups")), ("missing_gold", positive & no("gold_sources")),
        ("citation_policy", positive & ~F.coalesce("must_cite", F.lit(False))), ("invalid_coverage", positive & ~F.coalesce((cover > 0) & (cover <= 1), F.lit(False))),
    ]
    return own.select("id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())).alias("code")).distinct()


def keyed_answers(answers: DataFrame, keys: DataFrame) -> DataFrame:
    """Answers (question_id, …) with the key (question_id, …) of their question; answers to unknown questions have none."""
    return answers.join(keys.dropDuplicates(["question_id"]), "question_id", "left")
