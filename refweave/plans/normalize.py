"""Cleaners: each source's export as the unified record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions import text as X
from refweave.plans.schema import UNIFIED, check_columns

#: Column names of the exports.
SCOPUS = {"Title": "title", "Author full names": "authors", "Abstract": "abstract", "Author Keywords": "keywords", "Source title": "journal", "Source": "source_database", "DOI": "doi", "PubMed ID": "pubmed_id", "Year": "year"}
WEB_OF_SCIENCE = {"TI": "title", "AU": "authors", "AB": "abstract", "DE": "keywords", "SO": "journal", "DI": "doi", "PM": "pubmed_id", "PY": "year"}
EBSCO = {"title": "title", "contributors": "authors", "abstract": "abstract", "subjects": "keywords", "source": "journal", "longDBName": "source_database", "doi": "doi", "publicationDate": "year"}
PUBMED = {"title": "title", "authors": "authors", "abstract": "abstract", "keywords": "keywords", "journal": "journal", "doi": "doi", "pubmed_id": "pubmed_id", "publication_date": "year"}


def _shaped(df: DataFrame, columns: dict) -> DataFrame:
    """The unified columns, each from its expression; the position of the row in its source stays as ``source_pos`` if it is there."""
    extra = [F.col("source_pos")] if "source_pos" in df.columns else []
    out = df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in UNIFIED], *extra)
    check_columns(out.select(*UNIFIED.names))
    return out


def _named(df: DataFrame, names: dict) -> DataFrame:
    return df.select(*[F.col(f"`{raw}`").alias(name) for raw, name in names.items()], *[c for c in df.columns if c == "source_pos"])


def clean_scopus(df: DataFrame) -> DataFrame:
    df = _named(df, SCOPUS)
    c = {n: X.nan_to_blank(F.col(n)) for n in SCOPUS.values()}
    c |= {"doi": F.lower(c["doi"]), "keywords": X.split_list(c["keywords"]), "authors": X.split_list(X.without_ids(c["authors"]))}
    return _shaped(df, c | {"pubmed_id": X.whole_number(c["pubmed_id"]), "year": X.whole_number(c["year"])})


def clean_web_of_science(df: DataFrame) -> DataFrame:
    df = _named(df, WEB_OF_SCIENCE)
    c = {n: X.nan_to_blank(F.col(n)) for n in WEB_OF_SCIENCE.values()}
    c |= {"doi": F.lower(c["doi"]), "keywords": X.split_list(X.without_tags(c["keywords"])), "authors": X.split_list(c["authors"]), "source_database": F.lit("Web of Science")}
    return _shaped(df, c | {"pubmed_id": X.whole_number(c["pubmed_id"]), "year": X.whole_number(c["year"])})


def clean_pubmed(df: DataFrame, literal: bool = False) -> DataFrame:
    df = _named(df, PUBMED)
    c = {n: F.col(n) for n in PUBMED.values()}
    c |= {n: X.blank_if_null(F.col(n)) for n in ("title", "abstract", "journal")}
    c |= {"authors": X.list_if_null(X.full_names(F.col("authors"), literal)), "keywords": X.list_if_null(F.col("keywords")), "doi": F.lower(X.blank_if_null(F.col("doi"))), "source_database": F.lit("PubMed")}
    return _shaped(df, c | {"pubmed_id": X.whole_number(F.col("pubmed_id").cast("string")), "year": X.year_of(F.col("year"))})


def clean_ebsco(df: DataFrame) -> DataFrame:
    df = _named(df, EBSCO)
    c = {n: X.nan_to_blank(F.col(n)) for n in ("title", "abstract", "journal", "source_database")}
    c |= {"doi": F.lower(X.nan_to_blank(F.col("doi")))}
    c |= {n: X.list_if_null(X.split_list(F.col(n))) for n in ("authors", "keywords")}
    return _shaped(df, c | {"pubmed_id": F.lit(None), "year": X.year_of(F.col("year"))})


def scopus_author_ids(df: DataFrame) -> DataFrame:
    """(authors, author_ids): a row for each author of the rows that have as many ids as names."""
    names = X.split_list(X.without_ids(X.nan_to_blank(F.col("`Author full names`"))))
    ids = X.split_list(X.nan_to_blank(F.col("`Author(s) ID`")))
    paired = df.select(names.alias("a"), ids.alias("i")).filter(F.size("a") == F.size("i"))
    rows = paired.select(F.inline_outer(F.arrays_zip(F.col("a").alias("authors"), F.col("i").alias("author_ids"))))
    return rows.select("authors", X.whole_number(F.col("author_ids")).alias("author_ids"))
