"""The training-data pipeline: five stages, each by one operator, each over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of ``documents``, extra columns too.

Null and empty texts: the classifier judges them from what they have; line dedup and decontamination keep them; the
join keeps them all, as they have no shingles; the last stage gives them no ids. Rows that repeat an id: the
classifier, line dedup and decontamination treat each row by itself; the join leaves one row of an id. Rows
without an id are never near duplicates. An empty table of documents gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontamination, jaccard_join, line_dedup, pieces, quality
from attesta.llm.shared import materialise, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return quality.drop_rejected(docs, read(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their host's boilerplate lines; n_chars is of the text that is left."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 and round_trip of each document that is left."""
    import public_tokenizers

    return pieces.tokenise(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


#: The classifier's scores and the tokeniser cannot be stated in SQL; tests hold every stage against a brute-force version
#: on its own input: the lines, pairs and windows against plain Python, the ids against the sentencepiece library.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
