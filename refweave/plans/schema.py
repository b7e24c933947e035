"""The unified record and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIST = T.ArrayType(T.StringType())
UNIFIED = T.StructType(
    [
        T.StructField("title", T.StringType(), False),
        T.StructField("authors", _LIST, False),
        T.StructField("abstract", T.StringType(), False),
        T.StructField("keywords", _LIST, False),
        T.StructField("journal", T.StringType(), False),
        T.StructField("source_database", T.StringType(), False),
        T.StructField("doi", T.StringType(), False),
        T.StructField("pubmed_id", T.LongType(), True),
        T.StructField("year", T.LongType(), True),
    ]
)
REFERENCES = "citing_omid string, citing_doi string, cited_dois array<string>, cited_omids array<string>"
ERRORS = "error_omid string, error_doi string, error_message string"


class SchemaViolation(ValueError):
    pass


def check_columns(df: DataFrame, schema: T.StructType = UNIFIED) -> None:
    """Column names, their order and types, without reading any row."""
    want, got = [(f.name, f.dataType.simpleString()) for f in schema], df.dtypes
    if want != got:
        raise SchemaViolation(f"columns are {got}, not {want}")


def violations(df: DataFrame, schema: T.StructType = UNIFIED, patterns: dict[str, str] | None = None) -> DataFrame:
    """One row: the number of nulls in each required column, and of values off each pattern."""
    patterns = {"doi": "^[^A-Z]*$"} if patterns is None else patterns
    nulls = [F.count_if(F.col(f.name).isNull()).alias(f"{f.name}_null") for f in schema if not f.nullable]
    off = [F.count_if(~F.col(c).rlike(p)).alias(f"{c}_pattern") for c, p in patterns.items()]
    return df.agg(*nulls, *off)


def validated(df: DataFrame, schema: T.StructType = UNIFIED) -> DataFrame:
    """``df`` if it is valid; one aggregation over it. Raises with the counts otherwise."""
    check_columns(df, schema)
    found = {k: v for k, v in violations(df, schema).first().asDict().items() if v}
    if found:
        raise SchemaViolation(f"invalid rows: {found}")
    return df
