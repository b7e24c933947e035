"""Incremental refresh of the reference table from a folder of new publication files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refweave.operators.references import Transport, cleaned_keys, fetch, keys_to_query, parse_pairs
from refweave.sources.readers import subfolders


def loaded_batches(spark: SparkSession, references: str, but: int | None = None) -> DataFrame | None:
    """The references of all batches, or of all but one; None if there are none."""
    folders = [x for x in subfolders(spark, references) if x.rsplit("/", 1)[-1] != f"batch-{but}"]
    return spark.read.parquet(*folders) if folders else None


def refresh(spark: SparkSession, incoming: str, references: str, errors: str, checkpoint: str, transport: Transport, schema: str = "doi string", **pacing) -> None:
    """Takes every file that came since the last call; asks for keys that have no answer yet and appends what comes.

    Each micro-batch is a folder of its own, overwritten if it repeats. A batch never counts its own folder, so one that failed
    after it wrote answers, but before it was committed, asks again for all its keys and loses none.
    """

    def batch(df: DataFrame, number: int) -> None:
        found, failed = parse_pairs(fetch(keys_to_query(cleaned_keys(df), loaded_batches(spark, references, number)), transport, **pacing))
        found.write.mode("overwrite").parquet(f"{references}/batch-{number}")
        failed.write.mode("overwrite").parquet(f"{errors}/batch-{number}")

    stream = spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
