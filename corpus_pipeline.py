"""Documents to packed training sequences, in five stages, each an operator of ``quarry.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of documents. Stages lower the session's bounds on batches
for Python workers, where the user set none, so that neither JVM nor workers hold a whole partition's texts. Null texts,
empty tables, repeated rows and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, packing, secretscan
from quarry.llm.common import discard, documents, materialised, scratch, small_batches, table
from quarry.llm.queries import word_tokenizer
from quarry.llm.nearcopies import keep_one_of_each


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt, ``lang`` set to what the parse finds; texts that no language explains go.

    What is learnt comes from the ``documents`` table's rows that are not held out.
    """
    small_batches(spark)
    return langid.keep_identified(docs, langid.learn(table(spark, sf_dir, "documents")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8): the one with the smallest id."""
    small_batches(spark)
    return keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    small_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` renewed where something was."""
    small_batches(spark)
    return secretscan.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of 2048."""
    small_batches(spark)
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("packing", packed),
]
#: No SQL can tokenize; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written to the shared folder and read again but for the last.

    What a stage wrote for itself, and what it read, are deleted once its result is written.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs, path = materialised(stage(spark, docs, sf_dir), name)
            made.remove(path)
        if before:
            discard(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
