"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``, and any others that there are.
What a stage does with nulls, empty and long texts, ties, repeated rows and
empty tables is said at its function.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import shared_dir
from lodeframe.llm.exact_dedup import drop_exact_copies
from lodeframe.llm.langid import keep_identified
from lodeframe.llm.mixing import mixed_documents
from lodeframe.llm.overlap import drop_similar
from lodeframe.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network cannot place go: a null text, one without a letter, or a best score under 0.4.

    All windows of a long text count. Rows that repeat score alike, so all of them stay or go; a null language or
    identifier is no reason to go. Without any labelled text, and so for an empty table, nothing stays.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, one with a null only where there is no other.

    Null and empty texts are equal; of rows that repeat both identifier and text one stays; no rows give no rows.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 or more of their five-word shingles (Jaccard) the smallest doc_id stays.

    SimHash and its BK-trees find candidates, MinHash keys those that no radius reaches, and each link is checked on the
    words. Null and blank texts are copies of each other; a text of under five words is one shingle; rows that repeat
    are copies; a null identifier stays only where there is no other; no rows give no rows.
    """
    return drop_similar(docs, shingle=5, least=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays once for each whole pass of its source, and once more with its drawn blocks as its text, so doc_id repeats.

    Texts without words go, as nothing is taken of them; a null source is a source; rows that repeat are drawn one by one; no
    rows give no rows.
    """
    out = mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents in sequences of 2,048 words; the repeats of one document never share a sequence with a rest of theirs.

    A long text is cut into full sequences and a rest. A text without words has no sequence. A null doc_id conflicts with
    none; no rows give no rows.
    """
    return pack(docs, cluster=F.col("doc_id"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

#: A trained network and random draws have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
