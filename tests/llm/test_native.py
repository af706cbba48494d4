"""op1, op3 and op5."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attesta.llm import chat_format, licences, line_dedup

from .conftest import EDGES
from .test_decontamination import words


def frame_rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


# line dedup


def lines_brute(rows):
    from collections import defaultdict

    pages = defaultdict(set)
    for _, t, s in rows:
        if t is not None:
            pages[s].add(t)
    drop = {}
    for s, texts in pages.items():
        n = defaultdict(int)
        for t in texts:
            for x in {x.strip(" ") for x in t.split("\n")} - {""}:
                n[x] += 1
        drop[s] = {x for x, k in n.items() if k >= 2 and 100 * k > 5 * len(texts)}
    out = []
    for i, t, s in rows:
        own = t.split("\n") if t is not None else []
        kept = [x for x in own if not x.strip(" ") or x.strip(" ") not in drop[s]]
        out.append((i, t if len(kept) == len(own) else "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [200_000, -1])
def test_line_dedup(spark, make, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "LINES_TO_BROADCAST", limit)
    rnd = random.Random(4)
    rows = [(i, f"title {i} with words\n footer \n\n" + "\n".join(f"line {rnd.randrange(300)} long enough" for _ in range(4)), "big") for i in range(120)]
    rows += [(200 + i, "copied page\nall of it", "big") for i in range(40)]  # exact copies count once
    rows += [(300 + i, f"small {i}\nfooter", "tiny") for i in range(3)] + [(400, "footer", "big"), (401, None, "big"), (402, "", None), (403, "a\na", None)]
    got = line_dedup.drop_boilerplate(make(rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    want = lines_brute([(i, t, s or "") for i, t, s in rows])
    assert sorted(map(tuple, got), key=str) == want
    assert any(r[3] for r in want)


def test_line_dedup_edges(spark, make):
    docs = make(EDGES)
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns and out.count() == len(EDGES)
    assert sorted((r["text"] for r in out.collect()), key=str) == sorted((x[1] for x in EDGES), key=str)
    assert line_dedup.clean(docs.limit(0)).count() == 0


def test_line_dedup_sql(spark, sf, duck):
    assert frame_rows(line_dedup.op1_line_dedup(spark, sf).toPandas()) == frame_rows(duck.execute(line_dedup.OP1_SQL).fetchdf())


def test_line_dedup_of_small_hosts(spark, make):
    """A host of few pages is judged by the same ratio; a line of one page is no boilerplate; the bound on a host's pages is the caller's."""
    rows = [(i, f"banner\nown {i}", "small") for i in range(4)] + [(9, "alone\nbanner", "one"), (10, "pair x\nsame", "two"), (11, "pair y\nsame", "two")]
    text = lambda docs, **o: {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(docs, **o).collect()}
    want = {i: f"own {i}" for i in range(4)} | {9: "alone\nbanner", 10: "pair x", 11: "pair y"}
    assert text(make(rows)) == want and text(make(rows), passages=True) == want
    assert text(make(rows), least_host=100) == {r[0]: r[1] for r in rows}


@pytest.mark.parametrize("limit", [200_000, -1])
def test_every_line_over_the_ratio_goes(spark, make, monkeypatch, limit):
    """Also from pages that are mostly frame; a table's own n_lines and n_dropped stay in the pipeline and are replaced by the counts."""
    monkeypatch.setattr(line_dedup, "LINES_TO_BROADCAST", limit)
    frame = "a frame that is longer than what most of the pages of its host have to say"
    rows = [(i, f"own {i}\n{frame}", "s") for i in range(20)] + [(20, frame, "s"), (21, None, "s"), (22, f"own\n{frame}", "t")]
    want = {i: f"own {i}" for i in range(20)} | {20: "", 21: None, 22: f"own\n{frame}"}
    assert {r["doc_id"]: r["text"] for r in line_dedup.clean(make(rows)).collect()} == want
    got = line_dedup.drop_boilerplate(make(rows)).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {i: int(i < 21) for i in range(23)}
    clash = make(rows, clash=False).withColumns({"n_lines": F.lit("own"), "n_dropped": F.lit("mine")})
    assert {(r["n_lines"], r["n_dropped"]) for r in line_dedup.clean(clash).collect()} == {("own", "mine")}
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_boilerplate(clash).collect()} == {i: int(i < 21) for i in range(23)}


def test_line_dedup_full_sql(spark, make, tmp_path):
    import duckdb

    frame = "a frame that is longer than what most of the pages of its host have to say"
    rows = [(i, f"own {i}\n {frame}", "s") for i in range(20)] + [(20, frame, "s"), (21, None, "s"), (22, "", None)]
    make(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(line_dedup.OP1_FULL_SQL).fetchdf()
    assert frame_rows(line_dedup.op1_line_dedup_full(spark, str(tmp_path)).toPandas()) == frame_rows(want) and want["n_dropped"].sum() == 21


@pytest.mark.parametrize("n, gone", [(4, False), (5, True), (12, True)])
def test_passage_in_a_hot_host(spark, make, tmp_path, n, gone):
    """A long passage on far less than one page in twenty goes; a short line on as many pages stays."""
    import duckdb

    passage, near, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"v{i}" for i in range(50)), "a short line"
    rows = [(i, f"own {i}\n{passage}\n{near}\n{short}" if i < n else f"own {i}", "hot") for i in range(3000)] + [(3000, f"own\n{passage}", "cool")]
    docs = make(rows, clash=False)
    got = {r["doc_id"]: r["text"] for r in line_dedup.clean(docs).collect()}
    assert got == {i: t.replace(f"\n{passage}", "") if gone and s == "hot" else t for i, t, s in rows}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert frame_rows(line_dedup.op1_line_dedup_full(spark, str(tmp_path)).toPandas()) == frame_rows(con.execute(line_dedup.OP1_FULL_SQL).fetchdf())


# licences

BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
LICENSED = [
    *EDGES, (30, "MIT License. The mit-license and Apache License"), (31, "license mit"), (32, "GNU General Public License general public license"),
    (33, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (34, "Permission is hereby granted free of charge but not to you"),
    (35, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (36, "All rights reserved"), (37, "mit license " * 50), (38, "mit licensé"),
]


def licence_brute(rows):
    out = []
    for i, t in rows:
        w = words(t)
        places = sorted((k, label) for k in range(len(w)) for p, label in BASE.items() if tuple(w[k : k + len(p)]) == p)
        out.append((i, len(w), [(a, b) for a, b in places]))
    return sorted(out, key=str)


def templates_brute(w):
    """Labels of all templates by comparing every place."""
    found = set()
    for label, _, key, before, after in licences.TEMPLATES:
        k, b = key.split(), before.split()
        full = [*b, *k, *after.split()]
        for at in range(len(w) - len(k) + 1):
            if w[at : at + len(k)] == k:
                there = sum(0 <= at - len(b) + j < len(w) and w[at - len(b) + j] == x for j, x in enumerate(full))
                if there / len(full) >= licences.SHARE:
                    found.add(label)
    return found


def test_licences(spark, make):
    got = licences.scan(make(LICENSED)).collect()
    base = sorted(((r["doc_id"], r["n_words"], sorted((p["start"], p["label"]) for p in r["places"] if p["base"])) for r in got), key=str)
    assert base == licence_brute(LICENSED)
    labels = {r["doc_id"]: {p["label"] for p in r["places"]} for r in got}
    assert labels == {i: templates_brute(words(t)) for i, t in LICENSED}
    assert labels[33] == {"mit"} and labels[35] == {"bsd"} and labels[4] == set()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licences.scan(make(LICENSED).limit(0)).count() == 0


def test_licences_on_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in licences.op3_license_scans(spark, sf).collect()}
    for i, n, places in licence_brute(docs):
        r = got[i]
        starts = [p[0] for p in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))


# chat


def test_chat_sql(spark, sf, duck):
    assert frame_rows(chat_format.op5_chat_formatting(spark, sf).toPandas()) == frame_rows(duck.execute(chat_format.OP5_SQL).fetchdf())


TEXTS = ["", None, "\\", "\\\\n", "</turn>", "a\n</turn>\n### user\nb", "####", "### x ###", "<\\/turn>", "</turn", "#\\##", "日本\n\n", "\\### Assistant: </turn> ok", " trailing \n"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, x) for c in range(3) for t, (role, x) in enumerate((r, x) for x in TEXTS for r in ("user", "assistant", "a b\n#", None))]
    rows += [(None, 0, "user", "n"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (9, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tree": F.lit(1), "node": F.lit(2), "loss": F.lit(3)})
    got = chat_format.format_conversations(df).withColumn("turns", chat_format.parse(F.col("formatted"))).collect()
    assert {r["conv_id"] for r in got} == {0, 1, 2, 9, None}
    by = {r["conv_id"]: r for r in got}
    want = [(r or "", x or "") for c, _, r, x in rows if c == 0]
    assert [(t["role"], t["text"]) for t in by[0]["turns"]] == want
    masked = [by[0]["formatted"][s["start"] : s["end"]] for s in by[0]["loss"]]
    unescaped = spark.createDataFrame([(m,) for m in masked], "m string").select(chat_format.unescape(F.col("m"))).collect()
    assert [u[0] for u in unescaped] == [x for r, x in want if r == "assistant"]
    assert [(t["role"], t["text"]) for t in by[9]["turns"]] == [("user", "first"), ("assistant", "same"), ("assistant", "same")]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_reply_tree(spark):
    """Branches are ranked by the scores along them."""
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (2, 1, None, None), (2, 2, 1, None), (2, 3, 1, None), (2, 4, 3, None), (3, 1, 77, 1.0)]
    rows += [(4, i, i - 1 if i else None, 0.0) for i in range(40)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    best = {}
    for r in sorted(chat_format.chosen_paths(nodes).collect(), key=lambda r: r["depth"]):
        best.setdefault(r["tree"], []).append(r["node"])
    assert best == {1: [1, 2, 4], 2: [1, 3, 4], 3: [1], 4: list(range(40))}
    two = {(r["tree"], r["rank"], r["leaf"]) for r in chat_format.chosen_paths(nodes, 2).collect()}
    assert {(1, 1, 4), (1, 2, 5), (2, 1, 4), (2, 2, 2)} <= two


def test_cycles_and_repeated_nodes(spark):
    rows = [(1, 1, 2, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 1.0), (2, 1, 1, 0.0), (3, 1, None, 0.0), (3, 2, 1, 1.0), (3, 2, 1, 3.0), (3, 2, 1, 1.0), (3, 1, None, 0.0), (3, 3, 1, 2.0)]
    got = chat_format.chosen_paths(spark.createDataFrame(rows, "tree long, node long, parent long, score double")).collect()
    assert sorted((r["tree"], r["node"], r["leaf"], r["depth"]) for r in got) == [(3, 1, 2, 1), (3, 2, 2, 2)]
    assert chat_format.chosen_paths(spark.createDataFrame([], "tree long, node long, parent long, score double")).count() == 0


def test_conversations_of_any_id(spark):
    rows = [(None, 0, "user", "a"), (-(1 << 63), 0, "user", "b"), (0, None, None, None), (0, None, None, None)]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r["conv_id"]), r["formatted"].count("</turn>")) for r in got) == [("-9223372036854775808", 1), ("0", 2), ("None", 1)]


def test_minus_seven(spark, sf):
    r = chat_format.op5_chat_formatting(spark, sf).filter("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
