"""Readers of publication exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refweave.operators.unify import union_by_name


def _first_line(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no header")
    return first[0][0]


def _without_long_rows(reader: DataFrameReader, path: str | list[str], schema: T.StructType, cells: Callable[[Column], Column]) -> DataFrame:
    """The rows by position, those with more cells than the schema left out; shorter ones end in nulls. ``cells`` counts the cells of a raw row."""
    raw = "_raw"
    while raw in schema.names:
        raw = "_" + raw
    rows = reader.option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", raw).schema(T.StructType([*schema, T.StructField(raw, T.StringType())])).csv(path)
    # A row of another length, or with a value of another type, has its text in this column. Spark reads it with another column only, so that nothing of one is added.
    text = F.concat_ws("", F.col(raw), F.substring(F.col(f"`{schema.names[0]}`").cast("string"), 1, 0))
    return rows.filter(F.col(raw).isNull() | (cells(text) <= len(schema))).drop(raw)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, keep_empty: bool = False) -> DataFrame:
    """Comma-separated text with a header, doubled quotes and line breaks in cells; all columns strings unless a schema is given.

    Rows with more cells than the header are left out, shorter ones end in nulls. Empty cells are nulls; with ``keep_empty`` those in quotes are empty texts, as ``write_csv`` writes them.
    """
    # Spark takes for null what equals this text, an empty one by default; a cell without text or quotes is null in either case.
    null = uuid.uuid4().hex if keep_empty else ""

    def reader() -> DataFrameReader:
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", null)

    names = reader().csv(path).columns
    shape = T.StructType.fromDDL(schema) if schema else T.StructType([T.StructField(n, T.StringType()) for n in names])
    # Quoted cells begin at a comma or the row's start; without them every comma ends a cell.
    return _without_long_rows(reader(), path, shape, lambda raw: F.size(F.split(F.regexp_replace(raw, r'(?s)(^|,)"(?:[^"]|"")*+"', "$1"), ",")))


def read_literal_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text whose quotes mean nothing: rows with more cells than the header are left out, shorter ones end in nulls."""
    header = _first_line(spark, path).lstrip("\ufeff").rstrip("\r").split("\t")
    shape = T.StructType([T.StructField(n, T.StringType()) for n in header])
    return _without_long_rows(spark.read.option("header", True).option("sep", "\t").option("quote", ""), path, shape, lambda raw: F.size(F.split(raw, "\t")))


def read_all(spark: SparkSession, paths: list[str], reader) -> DataFrame:
    """The union of all files that can be read, with ``source_file``; at least one must be."""
    parts, failed = [], []
    for path in paths:
        try:
            parts.append(reader(spark, path).withColumn("source_file", F.lit(path)))
        except (AnalysisException, ValueError) as error:
            failed.append(f"{path}: {str(error).splitlines()[0]}")
    if not parts:
        raise ValueError("; ".join(failed) or "no files")
    return union_by_name(parts)


def read_parquet(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """``position`` adds ``source_pos``: file and row number, the order of the stored rows."""
    if not path.rstrip("/").endswith(".parquet"):
        raise ValueError(f"{path} is not a .parquet path")
    df = spark.read.parquet(path)
    return df.withColumn("source_pos", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))) if position else df


def with_metadata(df: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """What a loader gives: the table, and its file's metadata with its columns."""
    return df, file_metadata(df.sparkSession, path) | {"columns": df.columns, "schema": df.schema.simpleString()}


def with_position(df: DataFrame) -> DataFrame:
    """``df`` with ``source_pos``, as ``read_parquet`` gives it, for texts: file, and a number that rises within the file (one split a file with ``multiLine``)."""
    return df.withColumn("source_pos", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has the path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def make_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders in ``path``; none if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().toString() for x in fs.listStatus(hadoop) if x.isDirectory()] if fs.exists(hadoop) else []


def file_metadata(spark: SparkSession, path: str) -> dict:
    """Path, bytes and time of change of a file or folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return {"path": path, "size": fs.getContentSummary(hadoop).getLength(), "modified": fs.getFileStatus(hadoop).getModificationTime() / 1000}
