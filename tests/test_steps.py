"""The runs from end to end on small exports, with recorded answers; clients, settings, tracker and cache."""

import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F
from refweave.operators import references as R
from refweave.plans import steps
from refweave.plans.pipeline import Pipeline, RunTracker, TableCache
from refweave.plans.schema import UNIFIED
from refweave.plans.settings import REQUIRED, Settings, SettingsError, read_env_file
from refweave.sources import articles, clients, sinks

ENV = {name: f"value of {name}" for name in REQUIRED}


@pytest.fixture
def settings(spark, tmp_path):
    out = Settings.of(f"file://{tmp_path}", ENV)
    out.make_folders(spark)
    return out


def _exports(spark, settings):
    at = settings.path
    scopus = [("T1", "Doe, J. (1)", "1", None, "k; l", "J", "Scopus", "10.1/A", None, "2001"), ("T2", "Roe, R. (2)", "2", "abs", None, "J", "Scopus", "10.1/B", "5.0", None)]
    names = ["Title", "Author full names", "Author(s) ID", "Abstract", "Author Keywords", "Source title", "Source", "DOI", "PubMed ID", "Year"]
    spark.createDataFrame(scopus, ", ".join(f"`{n}` string" for n in names)).coalesce(1).write.parquet(at("processed", "scopus_database.parquet"))
    wos = [("T1 again", "Doe, J.", "an abstract", "<b>k</b>", "J2", "10.1/a", "7", "2002")]
    spark.createDataFrame(wos, "TI string, AU string, AB string, DE string, SO string, DI string, PM string, PY string").coalesce(1).write.parquet(at("processed", "wos_database.parquet"))
    pub = [("9", "T3", "a3", ["m"], "J3", "2010-05-06", [("Roe", "Rita", "R", None)], "10.1/C")]
    spark.createDataFrame(pub, articles.ARTICLES).coalesce(1).write.parquet(at("processed", "medline_database.parquet"))
    with open(at("raw", "ebsco_ASU_all_until_2025.csv").removeprefix("file://"), "w") as out:
        out.write('title,contributors,abstract,subjects,source,longDBName,doi,publicationDate\nT4,"A; B",,s,J4,DB,10.1/D,20200101\nT5,,,,,DB,,\n')


def test_exports_to_network_and_communities(spark, settings):
    _exports(spark, settings)
    tracker = RunTracker("unify", {"environment": "TEST"})
    unification = steps.unification(settings)
    unification.adapters.append(tracker)
    got = unification.execute(["merged_dataframes_parquet", "scopus_author_ids_parquet"], {"spark": spark})
    assert got["merged_dataframes_parquet"]["size"] > 0
    assert [r.step for r in tracker.table(spark).filter("kind = 'sink'").collect()] == ["merged_dataframes_parquet", "scopus_author_ids_parquet"]
    assert tracker.table(spark).filter("outcome <> 'done'").count() == 0
    tracker.save(spark, settings.path("processed", "runs.parquet"))
    steps.cleaning(settings).execute(["clean_database_parquet"], {"spark": spark})
    clean = spark.read.parquet(settings.path("processed", "clean_unified_database.parquet"))
    assert clean.columns == UNIFIED.names
    rows = {r.doi: r for r in clean.collect()}
    assert rows.keys() == {"10.1/a", "10.1/b", "10.1/c", "10.1/d"}
    # The first source wins, its gaps are filled by the next; an empty text is no gap.
    assert (rows["10.1/a"].title, rows["10.1/a"].pubmed_id, rows["10.1/a"].year, rows["10.1/a"].abstract) == ("T1", 7, 2001, "")

    cites = {"10.1/a": ["10.1/B", "10.1/c"], "10.1/b": ["10.1/a"], "10.1/c": [], "10.1/d": ["10.9/z"]}
    asked = spark.sparkContext.accumulator(0)

    def answer(keys):
        asked.add(len(keys))
        return [(k, 200, json.dumps([{"citing": f"omid:br/{k[-1]} doi:{k}", "cited": f"omid:br/9 doi:{c}"} for c in cites[k]])) if k != "10.1/d" else (k, 500, "no") for k in keys]

    for round_, (calls, errors) in enumerate([(4, 1), (5, 1)]):
        config = settings.references_mode(spark)
        assert config == {"references_on_disk": bool(round_), "references_source": "opencitations"}
        if round_:
            drifted = steps.resolution(settings, config, answer).execute(["drifted_dois"], {"spark": spark})["drifted_dois"]
            assert drifted.count() == 0
        steps.save_resolution(spark, settings, config, answer, {"pause": 0})
        assert asked.value == calls  # the failed one is asked again, the others aren't
        assert spark.read.parquet(settings.path("processed", "references_opencitations.parquet")).count() == 3
        assert spark.read.parquet(settings.path("processed", "error_references_opencitations.parquet")).count() == errors

    network = steps.network(settings, rounds=20)
    network.execute(["save_citation_network_as_graphml", "plot_citation_network", "vertices_parquet", "edges_parquet"], {"spark": spark})
    edges = spark.read.parquet(settings.path("processed", "citation_network_edges.parquet"))
    assert sorted((r.src, r.dst, r.src_id, r.dst_id) for r in edges.collect()) == [("10.1/a", "10.1/b", 0, 1), ("10.1/a", "10.1/c", 0, 2), ("10.1/b", "10.1/a", 1, 0)]
    drawn = "\n".join(r.value for r in spark.read.text(settings.path("figures", "citation_network.svg")).collect())
    assert drawn.count("<line") == 3 and drawn.count("<circle") == 3

    found = steps.network_communities(settings, [0.01, 5.0]).execute(["communities_parquet", "keywords_parquet"], {"spark": spark})
    assert found["communities_parquet"]["columns"] == ["resolution", "doi", "community_id", "community_size"]
    table = spark.read.parquet(settings.path("processed", "communities.parquet"))
    assert sorted((r.resolution, r.community_size) for r in table.collect()) == [(0.01, 3)] * 3 + [(5.0, 1)] * 3

    steps.exports(settings).execute(["bibtex_lines"], {"spark": spark})
    text = "\n".join(r.value for r in spark.read.text(settings.path("processed", "bibtex_with_references")).collect())
    assert "  references={10.1/B; 10.1/c}," in text and text.count("@ARTICLE{") == 4 and text.count("references={") == 2


def test_crossref_and_dump_are_other_sources_of_answers(spark, settings):
    keys = spark.createDataFrame([("10.1/a", "t"), ("10.1/b", "t")], "doi string, title string")
    keys.write.parquet(settings.path("processed", "clean_unified_database.parquet"))

    def works(asked):
        return [(k, 200, json.dumps({"message": {"DOI": k.upper(), "reference": [{"DOI": "10.2/q"}, {"key": "n"}]}})) for k in asked if k != "10.1/b"]

    steps.save_resolution(spark, settings, settings.references_mode(spark, "crossref"), works, {"pause": 0, "retry_pause": 0})
    assert [tuple(r) for r in spark.read.parquet(settings.path("processed", "references_crossref.parquet")).select("citing_doi", "cited_dois").collect()] == [("10.1/a", ["10.2/q"])]
    assert [r.error_doi for r in spark.read.parquet(settings.path("processed", "error_references_crossref.parquet")).collect()] == ["10.1/b"]
    dump = spark.createDataFrame([("10.1/A", "10.3/x"), ("10.1/a", "10.3/y")], "citing string, cited string")
    out = steps.resolution(settings, {"references_on_disk": False, "references_source": "dump"}).execute(["all_references"], {"spark": spark, "dump": dump})["all_references"]
    assert sorted((r.citing_doi, r.cited_dois) for r in out.collect()) == [("10.1/a", ["10.3/x", "10.3/y"]), ("10.1/b", [])]


def test_addresses_headers_and_statuses():
    seen = []

    def get(url, headers, seconds):
        seen.append((url, dict(headers)))
        if "bad" in url:
            raise OSError("down")
        return (404 if "none" in url else 200), "[]"

    assert clients.opencitations("TOKEN", get)(["10.1/a b", "bad", "none"]) == [("10.1/a b", 200, "[]"), ("bad", 0, "down"), ("none", 404, "[]")]
    assert seen[0] == ("https://api.opencitations.net/index/v2/references/doi:10.1/a%20b", {"authorization": "TOKEN"})
    clients.crossref("me@example.org", get)(["10.1/x?y"])
    assert seen[-1][0] == "https://api.crossref.org/works/10.1/x%3Fy" and "mailto:me@example.org" in seen[-1][1]["User-Agent"]


def test_http_get_makes_errors_answers(monkeypatch):
    class Answer:
        status = 200

        def read(self):
            return b"ok"

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    def opened(request, timeout):
        assert timeout == 3
        if request.full_url.endswith("none"):
            raise urllib.error.HTTPError(request.full_url, 404, "gone", {}, __import__("io").BytesIO(b"gone"))
        assert request.get_header("Authorization") == "T"
        return Answer()

    monkeypatch.setattr(urllib.request, "urlopen", opened)
    assert clients.http_get("http://x/a", {"authorization": "T"}, 3) == (200, "ok")
    assert clients.http_get("http://x/none", {}, 3) == (404, "gone")


RECORD = """<PubmedArticle><MedlineCitation><PMID>{id}</PMID><Article><Journal><JournalIssue><PubDate><Year>2011</Year><Month>Feb</Month></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>On <i>it</i> {id}</ArticleTitle><Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName><Initials>J</Initials></Author></AuthorList></Article><KeywordList><Keyword>k</Keyword></KeywordList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.5/{id}</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""


@pytest.fixture
def service():
    record = RECORD

    def get(url, headers, seconds):
        from urllib.parse import parse_qs, urlparse

        asked = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
        if "esearch" in url:
            lo, n = int(asked["retstart"]), int(asked["retmax"])
            return 200, json.dumps({"esearchresult": {"idlist": [str(k) for k in range(lo, min(lo + n, 12))]}})
        return 200, "<PubmedArticleSet>" + "".join(record.format(id=k) for k in asked["id"].split(",")) + "</PubmedArticleSet>"

    return get


def test_articles_from_the_search_and_from_the_table(spark, settings, service):
    assert articles.search("q", "e", 7, service) == [str(k) for k in range(7)]  # the cap of the source
    assert len(articles.search("q", "e", 100, service)) == 12
    assert settings.articles_mode(spark) == {"loading_from": "online"}
    steps.pubmed(settings, settings.articles_mode(spark), service).execute(["medline_database_parquet", "bibtex_lines", "medline_lines"], {"spark": spark, "query": "q"})
    table = spark.read.parquet(settings.path("processed", "medline_database.parquet"))
    r = table.orderBy(F.col("pubmed_id").cast("int")).first()
    assert table.count() == 12 and (r.title, r.abstract, r.publication_date, r.doi, r.keywords, r.authors[0].firstname) == ("On it 0", "One. Two.", "2011-02-01", "10.5/0", ["k"], "Jane")
    text = [r.value for r in spark.read.text(settings.path("processed", "pubmed_results.bib")).collect()]
    assert text.count("  date = {2011-02-01},") == 12
    assert settings.articles_mode(spark) == {"loading_from": "local"}
    assert steps.pubmed(settings, {"loading_from": "local"}).execute(["articles"], {"spark": spark})["articles"].count() == 12


def test_settings(tmp_path):
    with pytest.raises(SettingsError, match="MY_EMAIL.*TEAM_NAME"):
        Settings.of("/x", {})
    (tmp_path / ".env").write_text("# no=1\nMY_EMAIL='a@b'\nexport TEAM_NAME = t \n\n")
    assert read_env_file(str(tmp_path / ".env")) == {"MY_EMAIL": "a@b", "TEAM_NAME": "t"}


def test_tracker_cache_and_drawing(spark, tmp_path):
    calls = []

    def base(spark):
        calls.append("base")
        return spark.range(3)

    def broken(base):
        raise ValueError("no")

    def made():
        p = Pipeline(cache=TableCache(spark, f"file://{tmp_path}/cache", "v1"))
        tracker = RunTracker("p")
        p.adapters.append(tracker)
        return p.add(base).add(broken), tracker

    for _ in range(2):  # the second run reads the stored table
        p, tracker = made()
        assert p.execute(["base"], {"spark": spark})["base"].count() == 3
    assert calls == ["base"] and len(p.cache) == 1
    p, tracker = made()
    with pytest.raises(ValueError):
        p.execute(["broken"], {"spark": spark})
    assert tracker.table(spark).filter("outcome like 'ValueError%'").count() == 1
    assert '"spark of base"' in p.dot(deduplicate_inputs=False) and '"spark of base"' not in p.dot()


def test_metadata_of_loaders(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    p = Pipeline().source("raw", f"{tmp_path}/x.csv", "csv", metadata=True)
    got = p.execute(["raw", "raw_metadata"], {"spark": spark})
    assert got["raw"].count() == 1 and got["raw_metadata"]["size"] == 8 and got["raw_metadata"]["columns"][:2] == ["a", "b"]


def test_attached_references_and_terms(spark):
    database = spark.createDataFrame([("10.1/A", 1), ("10.1/b", 2), (None, 3)], "doi string, attached_to int")
    references = spark.createDataFrame([("10.1/a", ["x", "y"]), ("10.1/a", ["b"]), (None, ["z"])], "citing_doi string, cited_dois array<string>")
    got = {r.doi: r.references for r in R.attach_references(database, references).collect()}
    assert got == {"10.1/A": ["b"], "10.1/b": [], None: []}
    terms = spark.createDataFrame([("10.1/a", "t"), ("10.1/A", "s"), ("10.1/A", "s")], "doi string, term string")
    assert {r.doi: r.terms for r in R.enrich_terms(database, terms).collect()} == {"10.1/A": ["s", "t"], "10.1/b": [], None: []}
    errors = spark.createDataFrame([(None, "a", "m")], "error_omid string, error_doi string, error_message string")
    assert R.union_errors([errors, errors]).count() == 2
    assert "<circle" in sinks.scatter_html([(1, 4), (2, 5)], "a < b") and "a &lt; b" in sinks.scatter_html([], "a < b")
