"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of bytes other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN)
#: str.translate table that lowers A-Z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. A local master may leave that
    unset (tests do): then a folder under /tmp serves, as one machine runs
    everything. On a cluster an unset folder is an error, never a guess.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/lodeframe"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written.

    This cuts the lineage, survives lost executors and freezes values such as
    row numbers. The tables stay until the folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_scan(docs: DataFrame) -> bool:
    """Whether the plan only reads files, row by row, so that every reading gives the same rows in the same places."""
    node = docs._jdf.queryExecution().optimizedPlan()
    if not node.deterministic():
        return False
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.nodeName().startswith("LogicalRelation")


def numbered(docs: DataFrame) -> DataFrame:
    """``row``, a number that is one row's alone, and ``kept``, the columns of ``docs`` as a struct.

    Every reading of the result gives a row the same number: files that are
    read as they are keep their order, and what any other plan gives is written.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    return rows if is_scan(docs) else staged(rows, "numbered")


def kept_rows(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of ``numbered`` whose number is in ``numbers``, as they came. The rows are shuffled once, and no key is hot."""
    return rows.join(numbers.select("row"), "row", "left_semi").select("kept.*")


def input_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """About how many bytes the table takes as stored.

    For a plain scan of files Catalyst knows their size and no data are read.
    Of any other plan the text is measured, and halved for the compression.
    """
    if is_scan(docs):
        return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0) // 2


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed to the keywords, so that others cannot clash."""
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def text_of(column: str = "text"):
    """The text, a null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_fold(column: str, modulus: int):
    """crc32 of the identifier's decimal text, modulo ``modulus``; a null identifier counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
