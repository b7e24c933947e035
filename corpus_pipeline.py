"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``. Cases: null and empty texts pass every stage as documents without
words (and are taken no times or more by the last, which multiplies nothing); null ids stay; rows that repeat an id are one document for the
near copies; ties go to the least id; very long texts are whole; an empty table passes as empty;
further columns, whatever their names, are dropped by ``documents``' own column list.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm import decontamination, mixing, ngram_join, pii, toxicity
from refweave.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the model fitted on the labelled ones among them."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.with_scores(docs, model)
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).drop("toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    return ngram_join.one_per_component(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [kind] in place of personal data."""
    return pii.redacted(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by ``copy``."""
    return mixing.emit_mix(mixing.plan_mix(docs.select(*COLUMNS)))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: The toxicity model is fitted, which SQL cannot express; tests/llm/test_pipeline.py holds the whole run against a brute-force one.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage read goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        if k:
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
