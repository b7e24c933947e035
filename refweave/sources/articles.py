"""The remote source of articles: a search, whose ids are dealt to tasks that fetch the records."""

from __future__ import annotations

import json
import time
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions.lineage import cut
from refweave.sources.clients import PUBMED_FETCH, PUBMED_SEARCH, Get, http_get
from refweave.sources.sinks import write_parquet

MAX_RESULTS = 17_000
PAGE, BATCH = 5_000, 200
ARTICLES = "pubmed_id string, title string, abstract string, keywords array<string>, journal string, publication_date string, authors array<struct<lastname:string,firstname:string,initials:string,affiliation:string>>, doi string"


def search(query: str, email: str, max_results: int = MAX_RESULTS, get: Get = http_get, seconds: float = 60.0) -> list[str]:
    """The ids that the query finds, at most ``max_results``: a cap that is the source's feature."""
    found: list[str] = []
    while len(found) < max_results:
        asked = {"db": "pubmed", "term": query, "retmode": "json", "retstart": len(found), "retmax": min(PAGE, max_results - len(found)), "tool": "refweave", "email": email}
        status, body = get(f"{PUBMED_SEARCH}?{urllib.parse.urlencode(asked)}", {}, seconds)
        if status != 200:
            raise OSError(f"the search answers with status {status}")
        page = json.loads(body)["esearchresult"].get("idlist", [])
        found += page
        if len(page) < asked["retmax"]:
            break
    return found


def _text(node: ET.Element | None) -> str | None:
    return "".join(node.itertext()).strip() or None if node is not None else None


def _date(node: ET.Element | None) -> str | None:
    """year-month-day, with 01 for parts that are missing or words that aren't months."""
    if node is None or not node.findtext("Year"):
        return None
    month = node.findtext("Month") or "1"
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    number = names.index(month[:3].lower()) + 1 if month[:3].lower() in names else int(month) if month.isdigit() else 1
    day = node.findtext("Day") or "1"
    return f"{node.findtext('Year')}-{number:02d}-{int(day) if day.isdigit() else 1:02d}"


def parse_articles(body: str) -> list[dict]:
    """The records of a fetched document."""
    out = []
    for record in ET.fromstring(body).iter("PubmedArticle"):
        article = record.find(".//Article")
        dois = [x.text for x in record.findall(".//PubmedData/ArticleIdList/ArticleId") if x.get("IdType") == "doi"] or [x.text for x in record.findall(".//ELocationID") if x.get("EIdType") == "doi"]
        people = [{"lastname": p.findtext("LastName"), "firstname": p.findtext("ForeName"), "initials": p.findtext("Initials"), "affiliation": p.findtext(".//Affiliation")} for p in record.findall(".//AuthorList/Author")]
        parts = [_text(x) for x in record.findall(".//Abstract/AbstractText")]
        out.append(
            {
                "pubmed_id": record.findtext(".//PMID"),
                "title": _text(article.find("ArticleTitle")) if article is not None else None,
                "abstract": " ".join(x for x in parts if x) or None,
                "keywords": [x for k in record.findall(".//Keyword") if (x := _text(k))],
                "journal": record.findtext(".//Journal/Title"),
                "publication_date": _date(record.find(".//JournalIssue/PubDate")),
                "authors": people,
                "doi": dois[0] if dois else None,
            }
        )
    return out


def fetch_articles(spark: SparkSession, ids: list[str], email: str, get: Get = http_get, lanes: int = 1, pause: float = 0.34, seconds: float = 60.0) -> DataFrame:
    """``ARTICLES`` of the ids, written. ``lanes`` tasks ask at a time, for ``BATCH`` records each; an answer with another status than 200 raises, so the task repeats."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = list(part["id"])
            for lo in range(0, len(own), BATCH):
                asked = {"db": "pubmed", "id": ",".join(own[lo : lo + BATCH]), "retmode": "xml", "tool": "refweave", "email": email}
                status, body = get(f"{PUBMED_FETCH}?{urllib.parse.urlencode(asked)}", {}, seconds)
                if status != 200:
                    raise OSError(f"the fetch answers with status {status}")
                yield pd.DataFrame(parse_articles(body), columns=["pubmed_id", "title", "abstract", "keywords", "journal", "publication_date", "authors", "doi"])
                time.sleep(pause)

    listed = spark.createDataFrame([(x,) for x in ids], "id string")  # at most max_results short texts
    return cut(listed.repartition(lanes).mapInPandas(ask, ARTICLES))


def save_articles(articles: DataFrame, path: str) -> dict:
    """A table with a column for each attribute; dates as text."""
    return write_parquet(articles.withColumn("publication_date", F.col("publication_date").cast("string")), path)
