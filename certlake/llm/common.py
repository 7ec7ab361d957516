"""What several of the text operators need: stored intermediate tables and word expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: space and the five ASCII controls that `bytes.split` knows too.
BLANKS = r"[\x20\x09-\x0D]+"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """Writes `df` below the cluster's shared folder and reads it back.

    The plan is cut there, and a lost executor repeats only what comes after. With
    `free_shuffles` the files of the shuffles that made the table go as soon as it is written; else
    they stay until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP)
    if free_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; empty and all-blank texts have none."""
    parts = F.size(F.split(text, BLANKS, -1))
    at_ends = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(0)).otherwise(parts - at_ends).cast("long")


def doc_crc(doc_id: Column) -> Column:
    """CRC-32 of the identifier's decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def largest(df: DataFrame, by: str, most: int) -> DataFrame:
    """Rows with the largest positive values of `by`, as many as come to at most `most`.

    A sort with a limit would send `most` rows of every task to the driver. Here a histogram over
    sixteenths of powers of two finds the value from which on few enough are left; rows
    that are about equal stay or go together.
    """
    bucket = F.floor(F.log2(F.col(by).cast("double")) * 16).cast("int")
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # the powers that a double has
    total, cut = 0, None
    for row in sorted((r for r in counts if r["bucket"] is not None), key=lambda r: -r["bucket"]):
        total += row["n"]
        if total > most:
            break
        cut = row["bucket"]
    return df.where(F.lit(False)) if cut is None else df.where(bucket >= cut)
