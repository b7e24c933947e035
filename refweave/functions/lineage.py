"""Cutting lineage through files that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir, unless setCheckpointDir has since named another one: files and checkpoints stay together. Where neither is
    set, a local session gets a temporary folder of its own; on a cluster that raises, as executors would not see it.
    """
    context = spark.sparkContext
    named, held = context.getConf().get("spark.checkpoint.dir"), context.getCheckpointDir()
    if held and not (named and _uri(held).startswith(_uri(named).rstrip("/"))):
        return _uri(held)
    if named:
        if not held:
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="refweave-")
    context.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from files in the shared folder: lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it a name that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
