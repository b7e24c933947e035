"""Named queries over the supplied tables, with their DuckDB equivalents.

The tables hold no publications, so each operator runs on an analogue: orders cite parts,
documents with equal texts are copies of one record, labels are what is already resolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refweave.functions import text as X
from refweave.functions.lineage import cut
from refweave.operators import graph, unify
from refweave.operators.components import component_labels, labels_by_forests
from refweave.operators.references import keys_to_query
from refweave.sources import sinks

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A part cites another if an order has the first on line 1, the second on a later line.
def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = lines.filter("l_linenumber = 1").alias("a"), lines.filter("l_linenumber > 1").alias("b")
    return a.join(b, F.col("a.l_orderkey") == F.col("b.l_orderkey")).select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))


_E = """e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  WHERE a.l_linenumber = 1 AND b.l_linenumber > 1)"""
_C = f"""RECURSIVE {_E},
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
c(v, label) USING KEY (v) AS (SELECT DISTINCT a, a FROM u
  UNION (SELECT u.b, min(c.label) FROM c JOIN u ON c.v = u.a JOIN recurring.c AS o ON o.v = u.b WHERE c.label < o.label GROUP BY u.b))"""
_G = f"""{_C}, best AS (SELECT label FROM c GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)"""


@query(f"WITH {_E} SELECT * FROM e")
def citation_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    first = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").cast("string").alias("citing_doi"))
    cited = lines.filter("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("cited_dois"))
    references = first.join(cited, F.col("l_orderkey") == F.col("o"))
    valid = graph.valid_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doi")))
    return graph.citation_edges(references, valid).select(F.col("src").cast("long"), F.col("dst").cast("long"))


@query("SELECT p_partkey AS name, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part")
def vertex_ids(spark, sf_dir):
    return graph.vertex_ids(_parts(spark, sf_dir))


@query(
    f"""WITH {_E}, ids AS (SELECT p_partkey AS name, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part)
SELECT a.id AS src_id, b.id AS dst_id FROM e JOIN ids a ON e.src = a.name JOIN ids b ON e.dst = b.name"""
)
def edges_by_id(spark, sf_dir):
    return graph.edges_by_id(_edges(spark, sf_dir), graph.vertex_ids(_parts(spark, sf_dir))).select("src_id", "dst_id")


@query(f"WITH {_E} SELECT name, count(*) AS degree FROM (SELECT src AS name FROM e UNION ALL SELECT dst FROM e) GROUP BY name")
def vertex_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"WITH {_E} SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def isolated_vertices(spark, sf_dir):
    return graph.isolated(_parts(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_C} SELECT v AS id, label FROM c")
def components(spark, sf_dir):
    return component_labels(_edges(spark, sf_dir))


@query(f"WITH {_G} SELECT v AS name, label FROM c WHERE label = (SELECT label FROM best)")
def giant_component(spark, sf_dir):
    return graph.giant_component(_edges(spark, sf_dir))


@query(
    f"""WITH {_G}, ids AS (SELECT p_partkey AS name, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part)
SELECT a.id AS src_id, b.id AS dst_id FROM e JOIN c ON e.src = c.v JOIN ids a ON e.src = a.name JOIN ids b ON e.dst = b.name WHERE c.label = (SELECT label FROM best)"""
)
def citation_network(spark, sf_dir):
    """The edges of the whole composite: valid keys, edges among them, ids, giant component."""
    lines = table(spark, sf_dir, "lineitem")
    first = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").cast("string").alias("citing_doi"))
    cited = lines.filter("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("cited_dois"))
    # Ids are ranks of names as text; the digits in front make that the order of the numbers.
    wide = lambda c: F.lpad(c, 12, "0")
    references = first.join(cited, F.col("l_orderkey") == F.col("o")).select(wide(F.col("citing_doi")).alias("citing_doi"), F.transform("cited_dois", wide).alias("cited_dois"))
    database = table(spark, sf_dir, "part").select(wide(F.col("p_partkey").cast("string")).alias("doi"))
    return graph.citation_network(database, references)[1].select("src_id", "dst_id")


# A graph of many components: each document cites the copy of its text before it.
def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("doc_id").over(Window.partitionBy("key").orderBy("doc_id"))
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return keyed.select(F.col("doc_id").alias("src"), before.alias("dst")).filter(F.col("dst").isNotNull())


@query("SELECT id, label FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS label, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def copy_components(spark, sf_dir):
    return component_labels(_copies(spark, sf_dir))


@query("SELECT doc_id AS name FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1")
def isolated_documents(spark, sf_dir):
    return graph.isolated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name")), _copies(spark, sf_dir))


@query(
    """WITH g AS (SELECT min(doc_id) AS label, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) - 1 AS id FROM g),
d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS label FROM documents)
SELECT doc_id AS name, id AS community_id, n AS community_size FROM d JOIN k USING (label)"""
)
def copy_community_table(spark, sf_dir):
    return graph.community_table(component_labels(_copies(spark, sf_dir)).withColumnRenamed("id", "name"))


@query(f"WITH {_E} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e")
def undirected_projection(spark, sf_dir):
    return graph.undirected(_edges(spark, sf_dir))


@query(
    f"""WITH {_G}, g AS (SELECT v FROM c WHERE label = (SELECT label FROM best))
SELECT 'all' AS stage, (SELECT count(*) FROM part) AS vertices, (SELECT count(*) FROM e) AS edges
UNION ALL SELECT 'connected', (SELECT count(*) FROM c), (SELECT count(*) FROM e)
UNION ALL SELECT 'giant', (SELECT count(*) FROM g), (SELECT count(*) FROM e WHERE src IN (SELECT v FROM g))"""
)
def graph_stage_stats(spark, sf_dir):
    return graph.stage_stats(_parts(spark, sf_dir), _edges(spark, sf_dir))


@query(
    f"""WITH {_C}, s AS (SELECT label, count(*) AS n FROM c GROUP BY label),
k AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) - 1 AS id FROM s)
SELECT v AS name, id::BIGINT AS community_id, n AS community_size FROM c JOIN k USING (label)"""
)
def community_table(spark, sf_dir):
    return graph.community_table(component_labels(_edges(spark, sf_dir)).withColumnRenamed("id", "name"))


@query(f"WITH {_C} SELECT count(DISTINCT label) AS communities, count(*) AS members FROM c")
def community_counts(spark, sf_dir):
    return graph.community_counts(graph.community_table(component_labels(_edges(spark, sf_dir)).withColumnRenamed("id", "name")))


@query(
    f"""WITH {_C}, s AS (SELECT label, count(*) AS n FROM c GROUP BY label),
i AS (SELECT a.label, count(*) AS n FROM e JOIN c a ON e.src = a.v JOIN c b ON e.dst = b.v AND a.label = b.label GROUP BY a.label)
SELECT round(sum(coalesce(i.n, 0) - 0.05::DOUBLE * s.n * (s.n - 1)), 6) AS quality FROM s LEFT JOIN i USING (label)"""
)
def cpm_quality(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    labels = component_labels(edges).withColumnRenamed("id", "name")
    return graph.cpm_quality(edges, labels, 0.05).select(F.round("quality", 6).alias("quality"))


@query()
def communities_cpm(spark, sf_dir):
    return graph.communities(_edges(spark, sf_dir), [0.05])


@query(f"""WITH {_E} SELECT 0.05::DOUBLE AS resolution, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS members, true AS above_single, true AS connected""")
def community_invariants(spark, sf_dir):
    """That the communities found have a quality over that of single vertices, and that each is connected."""
    edges = cut(_edges(spark, sf_dir))
    found = cut(graph.communities(edges, [0.05]).select("name", "label"))
    a, b = found.select(F.col("name").alias("src"), F.col("label").alias("a")), found.select(F.col("name").alias("dst"), F.col("label").alias("b"))
    inside = cut(edges.join(a, "src").join(b, "dst").filter(F.col("a") == F.col("b")).select("src", "dst"))
    quality = graph.cpm_quality(inside, found, 0.05).first()["quality"]  # no other edge counts
    parts = found.join(labels_by_forests(inside).select(F.col("id").alias("name"), F.col("label").alias("part")), "name", "left").withColumn("part", F.coalesce("part", "name"))
    whole = parts.agg(F.count("*").alias("members"), F.count_distinct("label").alias("n"), F.count_distinct("label", "part").alias("k"))
    return whole.select(F.lit(0.05).alias("resolution"), "members", F.lit(quality > 0).alias("above_single"), (F.col("n") == F.col("k")).alias("connected"))


@query()
def layout_xy(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    giant = graph.giant_component(edges).select(F.col("name").alias("src"))
    return graph.layout(edges.join(giant, "src", "left_semi"))


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("text", "doc_id", "lang", "quality", "toxic")


@query(
    """WITH d AS (SELECT text, d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE text <> '')
SELECT md5(text) AS text_md5, arg_min(lang, doc_id) FILTER (WHERE lang IS NOT NULL) AS lang, arg_min(quality, doc_id) FILTER (WHERE quality IS NOT NULL) AS quality,
  arg_min(toxic, doc_id) FILTER (WHERE toxic IS NOT NULL) AS toxic FROM d GROUP BY text"""
)
def fill_first_nonnull(spark, sf_dir):
    filled = unify.fill_first(_labelled(spark, sf_dir), "text", ["doc_id"])
    return filled.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "quality", "toxic")


@query("SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def distinct_on_key(spark, sf_dir):
    return unify.distinct_on(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", ["doc_id"]).select("doc_id", "lang")


@query(
    """SELECT doc_id, copies, is_first FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_first FROM documents) WHERE copies > 1"""
)
def duplicate_report(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return unify.duplicate_report(keyed, "key", ["doc_id"]).select("doc_id", "copies", "is_first")


@query(
    """SELECT c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment, 0 AS source_priority FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, 1 FROM supplier"""
)
def unify_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    return unify.unify([c, s])


@query("SELECT DISTINCT doc_id::VARCHAR AS doi FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def to_query(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doi")).distinct()
    return keys_to_query(keys, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("citing_doi")))


@query(
    """WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en')
SELECT doc_id, 'left' AS side FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'right' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)"""
)
def drift_check(spark, sf_dir):
    return unify.symmetric_difference(table(spark, sf_dir, "labels").filter("quality = 1"), table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id")


@query(
    """SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::BIGINT ELSE d.n_chars::BIGINT END AS v
FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id"""
)
def merge_precedence(spark, sf_dir):
    winner = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("v"))
    return unify.merge_precedence(winner, table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("v")), "doc_id", "v")


@query("SELECT l_orderkey AS o, list(DISTINCT l_partkey ORDER BY l_partkey)::VARCHAR[] AS cited, min(l_partkey)::VARCHAR AS first FROM lineitem GROUP BY l_orderkey")
def adjacency_lists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_partkey").distinct()
    listed = lines.groupBy("o").agg(unify.ordered_list(F.col("l_partkey").cast("string"), F.col("l_partkey")).alias("cited"))
    return listed.withColumn("first", F.get("cited", F.lit(0)))


@query("SELECT l_orderkey AS o, l_partkey AS part, l_suppkey AS supplier, count(*) AS n FROM lineitem GROUP BY ALL")
def explode_zip(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_list(F.struct("l_partkey", "l_suppkey")).alias("x"))
    lists = lines.select("o", F.col("x.l_partkey").alias("part"), F.col("x.l_suppkey").alias("supplier")).filter(F.size("part") == F.size("supplier"))
    return lists.select("o", X.zipped_rows(F.col("part"), F.col("supplier"))).groupBy("o", "part", "supplier").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS n, string_split(p_name, ' ')[-1] AS last FROM part")
def split_list(spark, sf_dir):
    parts = X.split_list(F.replace("p_name", F.lit(" "), F.lit("; ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(parts).cast("long").alias("n"), F.element_at(parts, -1).alias("last"))


@query("SELECT doc_id, md5(lower(text)) AS key FROM documents")
def lower_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower("text").cast("binary")).alias("key"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^\\n]*?>', '', 'g'), ' \\([^\\n]*?\\)', '', 'g')) AS stripped FROM pages")
def regex_delete(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.without_ids(X.without_tags(F.col("html"))).cast("binary")).alias("stripped"))


@query("SELECT page_id, nullif(regexp_extract(url, 'ref=(\\S+)', 1), '') AS ref, nullif(regexp_extract('doi:' || url || ' omid:x', 'doi:(\\S+)', 1), '') AS doi FROM pages")
def regex_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.extract_or_null(F.col("url"), r"ref=(\S+)").alias("ref"), X.doi_of(F.concat(F.lit("doi:"), "url", F.lit(" omid:x"))).alias("doi"))


@query("SELECT o_orderkey, year(o_orderdate)::BIGINT AS year, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS even FROM orders")
def year_cast(spark, sf_dir):
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.year_of(F.col("o_orderdate")).alias("year"), X.whole_number(mixed).alias("even"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS event_type FROM events")
def nan_replace(spark, sf_dir):
    staged = F.when(F.col("event_type") == "click", F.lit("nan")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.nan_to_blank(staged).alias("event_type"))


@query("SELECT c_nationkey AS nation, string_agg(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment || ' ' END || c_name, ' and ' ORDER BY c_name) AS names FROM customer GROUP BY c_nationkey")
def struct_names(spark, sf_dir):
    person = F.struct(F.col("c_name").alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("firstname"), F.col("c_name").alias("lastname"))
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(person)).alias("p"))
    return people.select("nation", F.array_join(X.full_names(F.col("p")), " and ").alias("names"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


@query(
    """SELECT d.doc_id, md5('@ARTICLE{' || d.doc_id || ',' || chr(10) || '  title={' || coalesce(text, '') || '},' || chr(10) || '  author={' || coalesce(source, '') || ', ' || coalesce(lang, '') || '},' || chr(10)
  || '  journal={' || coalesce(source, '') || '},' || chr(10) || CASE WHEN quality IS NULL THEN '' ELSE '  year={' || quality || '},' || chr(10) END
  || '  keywords={' || lang || '; ' || source || '},' || chr(10) || '  doi={' || d.doc_id || '}' || chr(10) || '}' || chr(10)) AS entry
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def bibtex_records(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    key = F.col("doc_id").cast("string")
    people = F.array(F.struct(F.col("lang").alias("firstname"), F.col("source").alias("lastname")))
    none = F.lit(None).cast("string")
    entry = sinks.bibtex_with_references(key, F.col("text"), people, F.col("source"), F.col("quality").cast("string"), none, F.array("lang", "source"), key, F.array().cast("array<string>"))
    return df.select("doc_id", F.md5(entry.cast("binary")).alias("entry"))


@query(
    """SELECT o_orderkey, 'PMID- ' || o_orderkey || chr(10) || 'OWN - NLM' || chr(10) || 'STAT- PubMed' || chr(10) || 'DA  - ' || year(o_orderdate) || chr(10)
  || 'TA  - ' || o_orderpriority || chr(10) || 'JT  - ' || o_orderpriority || chr(10) || 'DP  - ' || year(o_orderdate) || chr(10) || 'TI  - ' || o_orderstatus || chr(10)
  || 'FAU - ' || c_name || ', ' || c_mktsegment || chr(10) || 'AU  - ' || c_name || ' ' || left(c_mktsegment, 1) || chr(10)
  || 'LID - ' || o_orderkey || ' [doi]' || chr(10) || 'OT  - ' || c_mktsegment || chr(10) || 'LA  - eng' || chr(10) || 'PT  - Journal Article' || chr(10) AS record
FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def medline_records(spark, sf_dir):
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    people = F.array(F.struct(F.col("c_mktsegment").alias("firstname"), F.col("c_name").alias("lastname")))
    key = F.col("o_orderkey").cast("string")
    return df.select("o_orderkey", sinks.medline(key, F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus"), people, F.lit(None).cast("string"), key, F.array("c_mktsegment")).alias("record"))


@query("SELECT count(*) FILTER (WHERE quality IS NULL) AS quality_null, count(*) FILTER (WHERE lang IS NULL) AS lang_null, count(*) FILTER (WHERE NOT regexp_matches(text, '^[^A-Z]*$')) AS text_pattern FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def schema_violations(spark, sf_dir):
    from pyspark.sql import types as T

    from refweave.plans.schema import violations

    required = T.StructType([T.StructField("quality", T.IntegerType(), False), T.StructField("lang", T.StringType(), False)])
    return violations(_labelled(spark, sf_dir), required, {"text": r"\A[^A-Z]*\z"})


@query(
    """WITH t AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS term FROM documents), tf AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT lang, md5(term) AS term, tf, round(tf * ln((SELECT count(DISTINCT lang) FROM t) / df::DOUBLE), 6) AS score FROM tf JOIN df USING (term)"""
)
def tfidf_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.lower("text"), F.lit(" "))).alias("term"))
    return graph.tfidf(terms, "lang", "term").select("lang", F.md5(F.col("term").cast("binary")).alias("term"), "tf", F.round("score", 6).alias("score"))
