"""Documents to training tokens: toxicity, near duplicates, benchmark passages, secrets, sentence pieces.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a
DataFrame; `run` writes each result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from centavo.llm import decontaminate, jaccard, pieces, secrets, toxicity
from centavo.llm.registry import table
from centavo.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic. The model is fitted on labelled rows of the given documents."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.75 or more, the one with the smallest doc_id stays."""
    return jaccard.keep_smallest(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text; keeps every document."""
    return secrets.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text, their numbers, and whether they decode to the text."""
    return pieces.encoded_and_checked(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scans", hide_secrets),
    ("sentence_pieces", encode),
]

#: SQL has neither the learned scores of the first stage nor the ids of the last; tests/llm/test_pipeline.py
#: compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
