"""The steps of the runs: tables in, tables out; nothing is computed before a sink asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.operators import graph, unify
from refweave.operators import references as R
from refweave.plans import normalize
from refweave.plans.pipeline import Pipeline
from refweave.plans.schema import REFERENCES, UNIFIED
from refweave.plans.settings import Settings
from refweave.sources import articles, clients, sinks


def merged_dataframes(scopus_df_clean: DataFrame, wos_df_clean: DataFrame, pubmed_df_clean: DataFrame, ebsco_df_clean: DataFrame) -> DataFrame:
    """The four sources in their priority, with their place in it and in their files."""
    return unify.unify([scopus_df_clean, wos_df_clean, pubmed_df_clean, ebsco_df_clean])


def clean_merged_dataframes(merged_dataframes: DataFrame) -> DataFrame:
    """One record for each DOI, filled in the order of the sources."""
    order = ["source_priority", *(c for c in ("source_pos",) if c in merged_dataframes.columns)]
    return unify.fill_first(merged_dataframes, "doi", order, [c for c in UNIFIED.names if c != "doi"]).select(*UNIFIED.names)


def full_db(scopus_db: DataFrame, pubmed_db: DataFrame, web_of_science_db: DataFrame) -> DataFrame:
    """Three databases as one, a record for each DOI."""
    return clean_merged_dataframes(unify.unify([scopus_db, pubmed_db, web_of_science_db]))


def unification(settings: Settings) -> Pipeline:
    """Exports to one table, and the ids of authors."""
    at = settings.path
    steps = Pipeline()
    steps.source("scopus_df", at("processed", "scopus_database.parquet"), position=True).source("wos_df", at("processed", "wos_database.parquet"), position=True)
    steps.source("pubmed_df", at("processed", "medline_database.parquet"), position=True).source("ebsco_df", at("raw", "ebsco_ASU_all_until_2025.csv"), "csv", position=True)
    steps.add(normalize.clean_scopus, "scopus_df_clean", bind={"df": "scopus_df"}).add(normalize.clean_web_of_science, "wos_df_clean", bind={"df": "wos_df"})
    steps.add(normalize.clean_pubmed, "pubmed_df_clean", bind={"df": "pubmed_df"}).add(normalize.clean_ebsco, "ebsco_df_clean", bind={"df": "ebsco_df"})
    steps.add(merged_dataframes).add(normalize.scopus_author_ids, bind={"df": "scopus_df"})
    return steps.sink("merged_dataframes_parquet", "merged_dataframes", at("processed", "unified_database.parquet")).sink("scopus_author_ids_parquet", "scopus_author_ids", at("processed", "scopus_author_ids.parquet"))


def cleaning(settings: Settings) -> Pipeline:
    steps = Pipeline().source("merged_dataframes", settings.path("processed", "unified_database.parquet"))
    return steps.add(clean_merged_dataframes).sink("clean_database_parquet", "clean_merged_dataframes", settings.path("processed", "clean_unified_database.parquet"))


def resolution(settings: Settings, config: dict, transport: R.Transport | None = None, pacing: dict | None = None) -> Pipeline:
    """Keys without an answer, asked for and appended. ``config``: references_on_disk and references_source (opencitations, crossref or dump; the latter takes the input ``dump``)."""
    source = config["references_source"]
    here = {x: {"references_source": x} for x in ("opencitations", "crossref", "dump")}
    pacing = {"opencitations": {"batch": 1, "pause": 0.5}, "crossref": {"batch": 100, "pause": 0.1, "retries": 1}}.get(source, {}) | (pacing or {})
    steps = Pipeline(dict(config)).source("database", settings.path("processed", "clean_unified_database.parquet"))

    def cleaned_dois(database):
        return R.cleaned_keys(database)

    def dois_to_query(cleaned_dois, loaded_references=None):
        return R.keys_to_query(cleaned_dois, loaded_references)

    def drifted_dois(loaded_error_references, dois_to_query):
        return R.drift(loaded_error_references, dois_to_query)

    def answers(dois_to_query):
        ask = transport or (clients.opencitations(settings.opencitations_token) if source == "opencitations" else clients.crossref(settings.email))
        return R.fetch(dois_to_query, ask, **pacing)

    def resolved__pairs(answers):
        return R.parse_pairs(answers)

    def resolved__works(answers):
        return R.parse_works(answers)

    def resolved__dump(dois_to_query, dump):
        found = R.from_dump(dois_to_query, dump)
        none = found.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in ("error_omid", "error_doi", "error_message")])
        return found.select(F.lit(None).cast("string").alias("citing_omid"), "citing_doi", "cited_dois", F.array().cast("array<string>").alias("cited_omids")), none

    def all_references(fetched_references, loaded_references=None):
        return R.append_new(loaded_references, fetched_references)

    kept = {"references_on_disk": True}
    if config["references_on_disk"]:
        steps.source("loaded_references", settings.path("processed", f"references_{source}.parquet")).source("loaded_error_references", settings.path("processed", f"error_references_{source}.parquet"))
    steps.add(cleaned_dois).add(dois_to_query).add(drifted_dois, when=kept).add(answers)
    parts = ("fetched_references", "error_references")
    steps.add(resolved__pairs, "resolved", here["opencitations"], parts).add(resolved__works, "resolved", here["crossref"], parts).add(resolved__dump, "resolved", here["dump"], parts)
    return steps.add(all_references)


def save_resolution(spark, settings: Settings, config: dict, transport: R.Transport | None = None, pacing: dict | None = None, inputs: dict | None = None) -> dict:
    """Runs ``resolution`` and puts its tables in place of the old ones: new versions are written beside them first, as they are read meanwhile."""
    source = config["references_source"]
    out = resolution(settings, config, transport, pacing).execute(["all_references", "error_references"], {"spark": spark, **(inputs or {})})
    names = {"all_references": f"references_{source}.parquet", "error_references": f"error_references_{source}.parquet"}
    columns = [x.split()[0] for x in REFERENCES.split(", ")]
    wanted = {k: out[k].select(*columns) if k == "all_references" else out[k] for k in names}
    return {k: sinks.replace_parquet(wanted[k], settings.path("processed", name)) for k, name in names.items()}


def citation_network(clean_database: DataFrame, references: DataFrame):
    return graph.citation_network(clean_database, references)


def network(settings: Settings, source: str = "opencitations", rounds: int = 500) -> Pipeline:
    """The giant component of the citations with its layout, as GraphML and tables."""
    at = settings.path
    steps = Pipeline().source("clean_database", at("processed", "clean_unified_database.parquet")).source("references", at("processed", f"references_{source}.parquet"))
    steps.add(citation_network, fields=("network_vertices", "network_edges"))

    def citation_network_with_layout(network_vertices, network_edges):
        return network_vertices.join(graph.layout(network_edges.select("src", "dst"), rounds), "name")

    def save_citation_network_as_graphml(citation_network_with_layout, network_edges):
        return sinks.write_graphml(citation_network_with_layout, network_edges, at("processed", "citation_network.graphml"))

    def plot_citation_network(citation_network_with_layout, network_edges):
        return sinks.write_svg(citation_network_with_layout, network_edges, at("figures", "citation_network.svg"))

    steps.add(citation_network_with_layout).add(save_citation_network_as_graphml, kind="sink").add(plot_citation_network, kind="sink")
    return steps.sink("vertices_parquet", "citation_network_with_layout", at("processed", "citation_network_vertices.parquet")).sink("edges_parquet", "network_edges", at("processed", "citation_network_edges.parquet"))


def network_communities(settings: Settings, resolutions: list[float]) -> Pipeline:
    """Communities of the stored network at every resolution, their table and their characteristic keywords."""
    at = settings.path
    steps = Pipeline().source("edges", at("processed", "citation_network_edges.parquet")).source("database", at("processed", "clean_unified_database.parquet"))

    def leiden_communities(edges):
        return graph.communities(edges.select("src", "dst"), resolutions)

    def communities_table(leiden_communities):
        return unify.union_by_name([graph.community_table(leiden_communities.filter(F.col("resolution") == r).select("name", "label")).select(F.lit(float(r)).alias("resolution"), F.col("name").alias("doi"), "community_id", "community_size") for r in resolutions])

    def characteristic_keywords(communities_table, database):
        terms = database.select("doi", F.explode("keywords").alias("term")).filter("term <> ''")
        placed = communities_table.join(terms, "doi").select(F.concat_ws(":", "resolution", "community_id").alias("community"), "term")
        return graph.tfidf(placed, "community", "term")

    steps.add(leiden_communities).add(communities_table).add(characteristic_keywords)
    return steps.sink("communities_parquet", "communities_table", at("processed", "communities.parquet")).sink("keywords_parquet", "characteristic_keywords", at("processed", "characteristic_keywords.parquet"))


def exports(settings: Settings, source: str = "opencitations") -> Pipeline:
    """The database as BibTeX records with their references."""
    at = settings.path
    steps = Pipeline().source("database", at("processed", "clean_unified_database.parquet")).source("references", at("processed", f"references_{source}.parquet"))

    def bibtex_with_references(database, references):
        joined = R.attach_references(database, references)
        people = F.transform("authors", lambda name: F.struct(F.lit(None).cast("string").alias("firstname"), name.alias("lastname")))
        record = sinks.bibtex_with_references(F.col("doi"), F.col("title"), people, F.col("journal"), F.col("year").cast("string"), F.col("abstract"), F.col("keywords"), F.col("doi"), F.col("references"))
        return joined.select(record.alias("value"))

    return steps.add(bibtex_with_references).sink("bibtex_lines", "bibtex_with_references", at("processed", "bibtex_with_references"), "lines")


def pubmed(settings: Settings, config: dict, get: clients.Get = clients.http_get) -> Pipeline:
    """Articles from the stored table or the search (the inputs ``spark`` and ``query``), as a table and as BibTeX and MEDLINE records."""
    at = settings.path
    steps = Pipeline(dict(config))

    def articles__local(spark):
        return spark.read.parquet(at("processed", "medline_database.parquet"))

    def articles__online(spark, query):
        return articles.fetch_articles(spark, articles.search(query, settings.email, get=get), settings.email, get, pause=0.34 if get is clients.http_get else 0.0)

    def medline_database_parquet(articles):
        return save(articles, at("processed", "medline_database.parquet"))

    def bibtex_articles(articles):
        day = F.try_to_date(F.col("publication_date"), "yyyy-MM-dd")
        return articles.select(sinks.bibtex(F.col("pubmed_id"), F.col("title"), F.col("authors"), F.col("journal"), day, F.col("abstract"), F.col("keywords"), F.col("doi")).alias("value"))

    def medline_articles(articles):
        day = F.try_to_date(F.col("publication_date"), "yyyy-MM-dd")
        return articles.select(sinks.medline(F.col("pubmed_id"), day, F.col("journal"), F.col("title"), F.col("authors"), F.col("abstract"), F.col("doi"), F.col("keywords")).alias("value"))

    save = articles.save_articles
    steps.add(articles__local, when={"loading_from": "local"}).add(articles__online, when={"loading_from": "online"})
    steps.add(medline_database_parquet, when={"loading_from": "online"}, kind="sink").add(bibtex_articles).add(medline_articles)
    return steps.sink("bibtex_lines", "bibtex_articles", at("processed", "pubmed_results.bib"), "lines").sink("medline_lines", "medline_articles", at("processed", "medline_articles.txt"), "lines")
