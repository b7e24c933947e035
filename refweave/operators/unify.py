"""Union of the sources in their priority, and one row for each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.functions.lineage import cut, fresh


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows; columns that a part lacks are null there. No part at all is an error."""
    if not parts:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unify(sources: list[DataFrame]) -> DataFrame:
    """The sources' rows with ``source_priority``, their number in the list."""
    return union_by_name([df.withColumn("source_priority", F.lit(k)) for k, df in enumerate(sources)])


def fill_first(df: DataFrame, key: str, order: list[str], columns: list[str] | None = None, blank_is_null: bool = True) -> DataFrame:
    """One row for each key that is not null: in every column the first value that is not null, in the order.

    The same as filling each group forwards and backwards, then keeping its first row. One
    aggregation, combined before the shuffle. ``blank_is_null`` takes the empty key for a missing one.
    """
    columns = [c for c in df.columns if c not in (key, *order)] if columns is None else columns
    known = df.filter(F.col(key).isNotNull() & (F.col(key) != "")) if blank_is_null and dict(df.dtypes)[key] == "string" else df.filter(F.col(key).isNotNull())
    place = F.struct(*order)
    return known.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def distinct_on(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's first row in the order, by an aggregation instead of a sort."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(key, "_row.*").select(*df.columns)


def duplicate_report(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of keys with several rows, with ``copies`` and ``is_first``."""
    by_key = Window.partitionBy(key)
    marked = df.withColumns({"copies": F.count("*").over(by_key), "is_first": F.row_number().over(by_key.orderBy(*order)) == 1})
    return marked.filter(F.col("copies") > 1)


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys of one side only, with ``side``; empty if the sets agree."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).union(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def merge_precedence(winner: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """All keys of both, with the winner's value where it has the key."""
    w = winner.select(F.col(key), F.struct(value).alias("_w"))
    o = other.select(F.col(key), F.struct(value).alias("_o"))
    return w.join(o, key, "full").select(key, F.coalesce("_w", "_o")[value].alias(value))


def ordered_list(value: Column, order: Column) -> Column:
    """Aggregate: the values that are not null, in the order."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"])


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank``, numbers from 0 in the order. Rows are dealt by ranges, ranked within each, and shifted by the sizes of the ranges before, so no task sorts all."""
    part, at = fresh(df, "part"), fresh(df, "at")
    ranged = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).count()
    shift = sizes.select(F.col(part).alias(at), (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias("shift"))  # a row for each partition
    numbered = ranged.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return numbered.join(F.broadcast(shift), F.col(part) == F.col(at)).select(*df.columns, (F.col("rank") - 1 + F.col("shift")).cast("long").alias("rank"))
