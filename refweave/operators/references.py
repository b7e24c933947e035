"""Incremental resolution of references over a transport.

A transport is a function from a list of keys to a list of (key, status, body); it is called on
the executors in batches. Answers are written to a table of their own before anything is
parsed, so no retry of a later stage asks again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions import text as X
from refweave.functions.lineage import cut, fresh
from refweave.operators.unify import symmetric_difference, union_by_name

Transport = Callable[[list[str]], list[tuple[str, int, str | None]]]
PAIRS = "array<struct<citing:string,cited:string>>"
WORK = "struct<message:struct<DOI:string,reference:array<struct<DOI:string>>>>"


def cleaned_keys(database: DataFrame, key: str = "doi", literal: bool = False) -> DataFrame:
    """Lower-cased keys that are neither null nor "UNKNOWN"; by default distinct and without the empty one."""
    out = database.filter(F.col(key).isNotNull() & (F.col(key) != "UNKNOWN")).select(F.lower(key).alias(key))
    return out if literal else out.filter(F.col(key) != "").distinct()


def keys_to_query(cleaned: DataFrame, loaded: DataFrame | None = None, key: str = "doi") -> DataFrame:
    """The keys without an answer among ``loaded`` (citing_doi)."""
    return cleaned if loaded is None else cleaned.join(loaded.select(F.lower("citing_doi").alias(key)), key, "left_anti")


def drift(errors: DataFrame, to_query: DataFrame, key: str = "doi") -> DataFrame:
    """Keys that failed before or are to be asked, but not both; empty if the sets agree."""
    return symmetric_difference(errors.select(F.lower("error_doi").alias(key)), to_query, key)


def fetch(keys: DataFrame, transport: Transport, key: str = "doi", batch: int = 1, pause: float = 0.5, retries: int = 0, retry_pause: float = 5.0, lanes: int = 1) -> DataFrame:
    """(doi, status, body), written. ``lanes`` tasks ask at a time, each with its own pauses, so the rate is ``lanes`` times one task's; failures become status 0."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = list(part[key])
            for lo in range(0, len(own), batch):
                asked = own[lo : lo + batch]
                for attempt in range(retries + 1):
                    try:
                        got = transport(asked)
                        break
                    except Exception as error:  # whatever a transport raises is an answer too
                        got = [(k, 0, str(error)) for k in asked]
                        if attempt < retries:
                            time.sleep(retry_pause)
                found = {k for k, _, _ in got}
                got += [(k, 404, "not found") for k in asked if k not in found]
                yield pd.DataFrame(got, columns=["doi", "status", "body"])
                time.sleep(pause)

    return cut(keys.select(key).repartition(lanes).mapInPandas(ask, "doi string, status int, body string"))


def parse_pairs(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, errors) of answers whose body lists pairs of citing and cited ids. An empty list is an answer without references."""
    parsed = answers.withColumn("pairs", F.when(F.col("status") == 200, F.from_json("body", PAIRS)))

    def cited(of: Callable):
        return F.filter(F.transform("pairs", lambda p: of(p["cited"])), lambda x: x.isNotNull())

    ok = parsed.filter(F.col("pairs").isNotNull())
    references = ok.select(X.omid_of(F.get("pairs", F.lit(0))["citing"]).alias("citing_omid"), F.col("doi").alias("citing_doi"), cited(X.doi_of).alias("cited_dois"), cited(X.omid_of).alias("cited_omids"))
    message = F.when(F.col("status") == 200, F.lit("unexpected body")).otherwise(F.concat(F.lit("status "), F.col("status").cast("string"), F.lit(": "), X.blank_if_null(F.col("body"))))
    errors = parsed.filter(F.col("pairs").isNull()).select(F.lit(None).cast("string").alias("error_omid"), F.col("doi").alias("error_doi"), message.alias("error_message"))
    return references, errors


def parse_works(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, errors) of answers whose body is a work with a list of references; those without a DOI are left out."""
    parsed = answers.withColumn("work", F.when(F.col("status") == 200, F.from_json("body", WORK)["message"]))
    listed = F.coalesce(F.transform(F.filter("work.reference", lambda r: r["DOI"].isNotNull()), lambda r: r["DOI"]), F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    references = parsed.filter(F.col("work").isNotNull()).select(none.alias("citing_omid"), F.lower(F.coalesce("work.DOI", "doi")).alias("citing_doi"), listed.alias("cited_dois"), F.array().cast("array<string>").alias("cited_omids"))
    errors = parsed.filter(F.col("work").isNull()).select(none.alias("error_omid"), F.col("doi").alias("error_doi"), X.blank_if_null(F.col("body")).alias("error_message"))
    return references, errors


def from_dump(keys: DataFrame, dump: DataFrame, key: str = "doi") -> DataFrame:
    """(citing_doi, cited_dois) from a local table of (citing, cited)."""
    listed = dump.groupBy(F.lower("citing").alias("citing_doi")).agg(F.array_sort(F.collect_set("cited")).alias("cited_dois"))
    return keys.select(F.col(key).alias("citing_doi")).join(listed, "citing_doi", "left").withColumn("cited_dois", X.list_if_null(F.col("cited_dois")))


def append_new(loaded: DataFrame | None, fetched: DataFrame) -> DataFrame:
    return fetched if loaded is None else loaded.unionByName(fetched)


def union_errors(parts: list[DataFrame]) -> DataFrame:
    """All error rows of several fetches, repeats included."""
    return union_by_name(parts)


def attach_references(database: DataFrame, references: DataFrame, key: str = "doi") -> DataFrame:
    """``database`` with ``references``, the cited DOIs of the row's key in any case; an empty list without an answer. Keys with several answers have the one that sorts first."""
    of = fresh(database, "attached_to")
    answers = references.filter(F.col("citing_doi").isNotNull() & F.col("cited_dois").isNotNull())
    listed = answers.groupBy(F.lower("citing_doi").alias(of)).agg(F.min("cited_dois").alias("references"))
    kept = database.select(*[c for c in database.columns if c != "references"])
    return kept.join(listed, F.lower(F.col(key)) == F.col(of), "left").select(*kept.columns, X.list_if_null(F.col("references")).alias("references"))


def enrich_terms(database: DataFrame, terms: DataFrame, key: str = "doi") -> DataFrame:
    """``database`` with ``terms``, the sorted distinct terms that a table (of the key, term) has for the row's key in any case."""
    of = fresh(database, "terms_of")
    listed = terms.groupBy(F.lower(key).alias(of)).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    kept = database.select(*[c for c in database.columns if c != "terms"])
    return kept.join(listed, F.lower(F.col(key)) == F.col(of), "left").select(*kept.columns, X.list_if_null(F.col("terms")).alias("terms"))
