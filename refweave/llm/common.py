"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions.lineage import cut, shared_dir  # noqa: F401

#: The ASCII letters, white space as the contracts define it, and the word patterns.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTER_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that travel to and from Python at once.
BATCH_ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python ``BATCH_ROWS`` rows at once at most, so that the memory of a batch of long texts is bounded; a smaller number that was set stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once for each row.

    A lambda variable is a slot in the row, so nested lambdas that capture it never
    evaluate the expression behind it again, whatever projections are collapsed.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character, dotted or accented, stays."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, pattern: str = SPACE_WORD) -> Column:
    """All matches of the word pattern; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
