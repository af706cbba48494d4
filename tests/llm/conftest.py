import pytest

#: names that operators use inside
CLASHING = ["row", "hit", "items", "n_words", "n_hit", "label", "score", "keep", "host", "page", "lines", "kept", "drop", "whole", "token", "prefix", "words", "places", "postings", "id", "least", "n_lines"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with columns of clashing names."""

    def build(rows, clash=True):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df

    return build


LONG = " ".join(f"w{i % 9973}" for i in range(60_000))
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (6, LONG), (7, "Ünï çödé 日本語 ß"), (8, "\x00\x01 a"), (None, "null id")]
