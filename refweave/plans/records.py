"""Queries of cleaners, runs, answers, exporters, readers and sinks, on records made of the supplied tables' columns.

Every row of a table becomes a record; expressions on its numbers decide which cells are missing, as in real exports.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.functions import text as X
from refweave.functions.lineage import shared_dir
from refweave.operators import references as R
from refweave.operators import unify
from refweave.plans import normalize, steps
from refweave.plans.catalog import query, table
from refweave.plans.schema import UNIFIED
from refweave.sources import readers, sinks


def _none() -> Column:
    return F.lit(None).cast("string")


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _scopus_export(spark, sf_dir) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("Title"),
        F.concat("c_name", F.lit(" ("), _text(key), F.lit("); "), "c_mktsegment", F.lit(" ("), _text(nation), F.lit(")")).alias("Author full names"),
        F.when(key % 4 == 0, _text(key)).otherwise(F.concat(_text(key), F.lit("; "), _text(nation))).alias("Author(s) ID"),
        F.when(key % 7 == 0, "nan").when(key % 11 != 0, F.col("c_mktsegment")).alias("Abstract"),
        F.when(key % 5 != 0, F.concat("c_mktsegment", F.lit("; "), _text(nation))).alias("Author Keywords"),
        F.concat(F.lit("J"), _text(nation)).alias("Source title"),
        F.lit("Scopus").alias("Source"),
        F.when(key % 13 != 0, F.concat(F.lit("10.1/K"), _text(key))).alias("DOI"),
        F.when(key % 3 == 0, F.concat(_text(key), F.lit(".0"))).otherwise(F.lit("")).alias("PubMed ID"),
        F.when(key % 4 == 0, "nan").otherwise(_text(1990 + nation)).alias("Year"),
    )


_SCOPUS = """SELECT c_name AS title, [c_name, c_mktsegment] AS authors, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS abstract,
  CASE WHEN c_custkey % 5 = 0 THEN [''] ELSE [c_mktsegment, c_nationkey::VARCHAR] END AS keywords, 'J' || c_nationkey AS journal, 'Scopus' AS source_database,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '10.1/k' || c_custkey END AS doi, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END::BIGINT AS pubmed_id,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1990 + c_nationkey END::BIGINT AS year FROM customer"""


def _wos_export(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("TI"),
        F.concat("s_name", F.lit("; X")).alias("AU"),
        _none().alias("AB"),
        F.concat(F.lit("<b>k</b>"), _text("s_nationkey"), F.lit("; z")).alias("DE"),
        F.lit("W").alias("SO"),
        F.concat(F.lit("10.1/K"), _text(F.col("s_suppkey") * 3)).alias("DI"),
        F.lit("").alias("PM"),
        F.concat(_text(2000 + F.col("s_nationkey")), F.lit(".0")).alias("PY"),
    )


_WOS = """SELECT s_name AS title, [s_name, 'X'] AS authors, '' AS abstract, ['k' || s_nationkey, 'z'] AS keywords, 'W' AS journal, 'Web of Science' AS source_database,
  '10.1/k' || (s_suppkey * 3) AS doi, NULL::BIGINT AS pubmed_id, (2000 + s_nationkey)::BIGINT AS year FROM supplier"""


def _pubmed_export(spark, sf_dir) -> DataFrame:
    size = F.col("p_size")
    people = F.array(F.struct(F.col("p_brand").alias("firstname"), F.col("p_type").alias("lastname")), F.struct(_none().alias("firstname"), _none().alias("lastname")), F.struct(_none().alias("firstname"), F.lit("Q").alias("lastname")))
    return table(spark, sf_dir, "part").select(
        _text("p_partkey").alias("pubmed_id"),
        F.col("p_name").alias("title"),
        F.when(size % 2 == 0, F.col("p_type")).alias("abstract"),
        F.when(size % 3 != 0, F.array("p_brand")).alias("keywords"),
        _none().alias("journal"),
        F.when(size % 5 != 0, F.concat(_text(1950 + size), F.lit("-01-01"))).alias("publication_date"),
        people.alias("authors"),
        F.concat(F.lit("10.1/K"), _text(F.col("p_partkey") * 2)).alias("doi"),
    )


_PUBMED = """SELECT p_name AS title, [p_brand || ' ' || p_type, 'Q'] AS authors, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS abstract, CASE WHEN p_size % 3 <> 0 THEN [p_brand] ELSE [] END AS keywords,
  '' AS journal, 'PubMed' AS source_database, '10.1/k' || (p_partkey * 2) AS doi, p_partkey::BIGINT AS pubmed_id, CASE WHEN p_size % 5 <> 0 THEN 1950 + p_size END::BIGINT AS year FROM part"""


def _ebsco_export(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("title"),
        F.when(key % 2 == 0, F.concat("o_orderpriority", F.lit("; Z"))).alias("contributors"),
        F.when(key % 9 == 0, "nan").otherwise(F.col("o_orderpriority")).alias("abstract"),
        _none().alias("subjects"),
        F.lit("E").alias("source"),
        F.lit("ASU").alias("longDBName"),
        F.when(key % 10 != 0, F.concat(F.lit("10.1/K"), _text(key))).alias("doi"),
        F.when(key % 8 != 0, F.date_format("o_orderdate", "yyyyMMdd")).alias("publicationDate"),
    )


_EBSCO = """SELECT o_orderstatus AS title, CASE WHEN o_orderkey % 2 = 0 THEN [o_orderpriority, 'Z'] ELSE [] END AS authors, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS abstract, []::VARCHAR[] AS keywords,
  'E' AS journal, 'ASU' AS source_database, CASE WHEN o_orderkey % 10 <> 0 THEN '10.1/k' || o_orderkey ELSE '' END AS doi, NULL::BIGINT AS pubmed_id, CASE WHEN o_orderkey % 8 <> 0 THEN year(o_orderdate) END::BIGINT AS year FROM orders"""
_MERGED = " UNION ALL ".join(f"SELECT *, {k} AS source_priority FROM ({x})" for k, x in enumerate((_SCOPUS, _WOS, _PUBMED, _EBSCO)))
_CLEAN = f"""WITH m AS ({_MERGED}) SELECT doi, {", ".join(f"arg_min({c}, source_priority) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in UNIFIED.names if c != "doi")} FROM m WHERE doi <> '' GROUP BY doi"""


@query(_SCOPUS)
def clean_scopus(spark, sf_dir):
    return normalize.clean_scopus(_scopus_export(spark, sf_dir))


@query(_WOS)
def clean_web_of_science(spark, sf_dir):
    return normalize.clean_web_of_science(_wos_export(spark, sf_dir))


@query(_PUBMED)
def clean_pubmed(spark, sf_dir):
    return normalize.clean_pubmed(_pubmed_export(spark, sf_dir))


@query(_EBSCO)
def clean_ebsco(spark, sf_dir):
    return normalize.clean_ebsco(_ebsco_export(spark, sf_dir))


@query(
    """SELECT c_name AS authors, c_custkey::BIGINT AS author_ids FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT c_mktsegment, c_nationkey::BIGINT FROM customer WHERE c_custkey % 4 <> 0"""
)
def scopus_author_ids(spark, sf_dir):
    return normalize.scopus_author_ids(_scopus_export(spark, sf_dir))


def _merged(spark, sf_dir) -> DataFrame:
    return steps.merged_dataframes(clean_scopus(spark, sf_dir), clean_web_of_science(spark, sf_dir), clean_pubmed(spark, sf_dir), clean_ebsco(spark, sf_dir))


@query(_MERGED)
def merged_records(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(_CLEAN)
def clean_records(spark, sf_dir):
    return steps.clean_merged_dataframes(_merged(spark, sf_dir))


@query(f"WITH c AS ({_CLEAN}), q AS (SELECT DISTINCT '10.1/k' || l_orderkey AS doi FROM lineitem) SELECT doi FROM c WHERE doi NOT IN (SELECT doi FROM q)")
def keys_left_to_query(spark, sf_dir):
    answered = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("10.1/K"), _text("l_orderkey")).alias("citing_doi"))
    return R.keys_to_query(R.cleaned_keys(clean_records(spark, sf_dir)), answered)


@query("SELECT doi, md5(array_to_string(authors, ' and ')) AS people, 'https://api.opencitations.net/index/v2/references/doi:' || doi AS url FROM (" + _CLEAN + ")")
def lookup_addresses(spark, sf_dir):
    made = clean_records(spark, sf_dir)
    return made.select("doi", F.md5(F.array_join("authors", " and ").cast("binary")).alias("people"), X.url_for("https://api.opencitations.net/index/v2/references/doi:{doi}", F.col("doi")).alias("url"))


def _cited(spark, sf_dir, line) -> DataFrame:
    """(o, x): for each order its lines in order, each as ``line`` of them."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return lines.select("o", F.transform("x", line).alias("x"))


def _pair_answers(spark, sf_dir) -> DataFrame:
    def line(x):
        both = F.concat(F.lit("omid:br/"), _text(x["l_partkey"]), F.lit(" doi:10.2/P"), _text(x["l_partkey"]))
        return F.when(x["l_suppkey"] % 2 == 0, both).otherwise(F.concat(F.lit("omid:br/"), _text(x["l_partkey"])))

    listed = _cited(spark, sf_dir, line)
    me = F.concat(F.lit("omid:br/"), _text("o"), F.lit(" doi:10.1/"), _text("o"))
    body = F.to_json(F.transform("x", lambda c: F.struct(me.alias("citing"), c.alias("cited"))))
    status = F.when(F.col("o") % 97 == 0, 500).otherwise(200)
    body = F.when(F.col("o") % 97 == 0, "down").when(F.col("o") % 101 == 0, "[]").when(F.col("o") % 103 == 0, "no json").otherwise(body)
    return listed.select(F.concat(F.lit("10.1/"), _text("o")).alias("doi"), status.alias("status"), body.alias("body"))


_LINES = "l_orderkey AS o, list('10.2/P' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_suppkey % 2 = 0) AS dois, list('' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS omids FROM lineitem GROUP BY l_orderkey"


@query(
    f"""SELECT CASE WHEN o % 101 <> 0 THEN 'br/' || o END AS citing_omid, '10.1/' || o AS citing_doi, CASE WHEN o % 101 = 0 THEN [] ELSE coalesce(dois, []) END AS cited_dois,
  CASE WHEN o % 101 = 0 THEN [] ELSE list_transform(omids, lambda x: 'br/' || x) END AS cited_omids FROM (SELECT {_LINES}) WHERE o % 97 <> 0 AND (o % 101 = 0 OR o % 103 <> 0)"""
)
def resolved_pairs(spark, sf_dir):
    return R.parse_pairs(_pair_answers(spark, sf_dir))[0]


@query(
    """SELECT NULL::VARCHAR AS error_omid, '10.1/' || o AS error_doi, CASE WHEN o % 97 = 0 THEN 'status 500: down' ELSE 'unexpected body' END AS error_message
FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem) WHERE o % 97 = 0 OR (o % 103 = 0 AND o % 101 <> 0)"""
)
def resolution_errors(spark, sf_dir):
    return R.parse_pairs(_pair_answers(spark, sf_dir))[1]


@query(f"SELECT NULL::VARCHAR AS citing_omid, '10.1/a' || o AS citing_doi, coalesce(dois, []) AS cited_dois, []::VARCHAR[] AS cited_omids FROM (SELECT {_LINES}) WHERE o % 89 <> 0")
def resolved_works(spark, sf_dir):
    listed = _cited(spark, sf_dir, lambda x: F.struct(F.when(x["l_suppkey"] % 2 == 0, F.concat(F.lit("10.2/P"), _text(x["l_partkey"]))).alias("DOI"), F.lit("k").alias("key")))
    key = F.concat(F.lit("10.1/A"), _text("o"))
    body = F.to_json(F.struct(F.struct(key.alias("DOI"), F.col("x").alias("reference")).alias("message")))
    return R.parse_works(listed.select(key.alias("doi"), F.when(F.col("o") % 89 == 0, 404).otherwise(200).alias("status"), body.alias("body")))[0]


@query(
    f"""WITH r AS (SELECT {_LINES}) SELECT o_orderkey, md5('@ARTICLE{{K' || o_orderkey || ',' || chr(10) || '  title={{' || o_orderpriority || '}},' || chr(10) || '  author={{' || c_name || ', ' || c_mktsegment || '}},' || chr(10)
  || '  journal={{' || o_orderstatus || '}},' || chr(10) || '  year={{' || year(o_orderdate) || '}},' || chr(10) || '  abstract={{' || o_orderpriority || '}},' || chr(10) || '  keywords={{' || c_mktsegment || '; ' || o_orderstatus || '}},' || chr(10)
  || CASE WHEN len(coalesce(dois, [])) > 0 THEN '  references={{' || array_to_string(dois, '; ') || '}},' || chr(10) ELSE '' END || '  doi={{K' || o_orderkey || '}}' || chr(10) || '}}' || chr(10)) AS entry, len(coalesce(dois, []))::BIGINT AS cited
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN r ON r.o = o_orderkey"""
)
def bibtex_with_references(spark, sf_dir):
    listed = _cited(spark, sf_dir, lambda x: F.when(x["l_suppkey"] % 2 == 0, F.concat(F.lit("10.2/P"), _text(x["l_partkey"]))))
    references = listed.select(F.concat(F.lit("k"), _text("o")).alias("citing_doi"), F.filter("x", lambda c: c.isNotNull()).alias("cited_dois"))
    database = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("doi", F.concat(F.lit("K"), _text("o_orderkey")))
    joined = R.attach_references(database, references)
    people = F.array(F.struct(F.col("c_mktsegment").alias("firstname"), F.col("c_name").alias("lastname")))
    entry = sinks.bibtex_with_references(F.col("doi"), F.col("o_orderpriority"), people, F.col("o_orderstatus"), F.year("o_orderdate").cast("string"), F.col("o_orderpriority"), F.array("c_mktsegment", "o_orderstatus"), F.col("doi"), F.col("references"))
    return joined.select("o_orderkey", F.md5(entry.cast("binary")).alias("entry"), F.size("references").cast("long").alias("cited"))


@query(
    """SELECT o_orderkey, md5('@ARTICLE{PMID' || o_orderkey || ',' || chr(10) || '  title = {' || o_orderpriority || '},' || chr(10) || '  author = {' || c_mktsegment || ' ' || c_name || '},' || chr(10) || '  journal = {' || o_orderstatus || '},' || chr(10)
  || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '  date = {' || strftime(o_orderdate, '%Y-%m-%d') || '},' || chr(10) || '  year = {' || year(o_orderdate) || '},' || chr(10) END
  || '  abstract = {' || c_name || '},' || chr(10) || '  keywords = {' || c_mktsegment || '; q},' || chr(10) || '  doi = {10/x' || o_orderkey || '},' || chr(10) || '  PMID = {' || o_orderkey || '}' || chr(10) || '}') AS entry
FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def bibtex_entries(spark, sf_dir):
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    people = F.array(F.struct(F.col("c_mktsegment").alias("firstname"), F.col("c_name").alias("lastname")))
    key = _text("o_orderkey")
    entry = sinks.bibtex(key, F.col("o_orderpriority"), people, F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")), F.col("c_name"), F.array("c_mktsegment", F.lit("q")), F.concat(F.lit("10/X"), key))
    return df.select("o_orderkey", F.md5(entry.cast("binary")).alias("entry"))


# A word goes on the last line while that stays within 80 characters, else onto a new one behind six blanks.
_WRAP = r"""SELECT conv_id, turn, md5(CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x:
  CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(x) <= 80 THEN a || ' ' || x ELSE a || chr(10) || '      ' || x END) END) AS wrapped
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM conversations)"""


@query(_WRAP)
def wrapped_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.wrapped(F.col("text")).cast("binary")).alias("wrapped"))


@query("SELECT p_partkey, regexp_extract(trim(p_name), '\\S+$') AS last, p_brand || CASE WHEN p_type = '' THEN '' ELSE ' ' || left(p_type, 1) END AS short FROM part")
def name_forms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.last_token(F.col("p_name")).alias("last"), X.short_name(F.col("p_type"), F.col("p_brand")).alias("short"))


_HEAD, _TAIL = sinks.GRAPHML_HEAD.replace("'", "''"), sinks.GRAPHML_TAIL.replace("'", "''")


@query(
    f"""WITH e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber > 1)
SELECT 0 AS part, '' AS key, '{_HEAD}' AS value UNION ALL SELECT 3, '', '{_TAIL}'
UNION ALL SELECT 1, lpad(p_partkey::VARCHAR, 19, '0'), '    <node id="n' || p_partkey || '"><data key="v_name">' || replace(replace(replace(replace(p_name || ' <&"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')
  || '</data><data key="v_x">' || p_size::DOUBLE || '</data><data key="v_y">' || (p_size / 2)::DOUBLE || '</data></node>' FROM part
UNION ALL SELECT 2, lpad(src::VARCHAR, 19, '0') || lpad(dst::VARCHAR, 19, '0'), '    <edge source="n' || src || '" target="n' || dst || '"/>' FROM e"""
)
def graphml_document(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a, b = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src_id")), lines.filter("l_linenumber > 1").select("l_orderkey", F.col("l_partkey").alias("dst_id"))
    vertices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(' <&"')).alias("name"), F.col("p_size").cast("double").alias("x"), (F.col("p_size") / 2).alias("y"))
    return sinks.graphml_lines(vertices, a.join(b, "l_orderkey").select("src_id", "dst_id"))


@query("SELECT p_partkey AS doi, coalesce(list(DISTINCT l_returnflag || l_linestatus ORDER BY l_returnflag || l_linestatus) FILTER (WHERE l_partkey IS NOT NULL), []) AS terms FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def enriched_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "lineitem").select(_text("l_partkey").alias("doi"), F.concat("l_returnflag", "l_linestatus").alias("term"))
    return R.enrich_terms(table(spark, sf_dir, "part").select(_text("p_partkey").alias("doi")), terms).select(F.col("doi").cast("long"), "terms")


def _folder(spark, kind: str) -> str:
    return os.path.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text, source FROM documents")
def csv_round_trip(spark, sf_dir):
    """Whole texts, with quotes and line breaks, through a comma-separated file."""
    path = _folder(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    return readers.read_csv(spark, path, keep_empty=True).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "source")


@query("SELECT c_custkey::VARCHAR AS key, '\"' || c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0")
def tsv_rows(spark, sf_dir):
    """Rows with too many cells are left out by the reader, short ones are filled; quotes mean nothing."""
    path, key = _folder(spark, "tsv"), F.col("c_custkey")
    line = F.concat_ws("\t", _text(key), F.concat(F.lit('"'), "c_name"), F.when(key % 3 != 0, F.col("c_mktsegment")), F.when(key % 5 == 0, F.when(key % 3 == 0, F.lit("a\tb")).otherwise(F.lit("more"))))
    head = spark.range(1).select(F.lit("key\tname\tsegment").alias("value"), F.lit(0).alias("at"))
    rows = table(spark, sf_dir, "customer").select(line.alias("value"), F.lit(1).alias("at"))
    head.union(rows).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return readers.read_literal_tsv(spark, path)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size, p_retailprice::VARCHAR AS p_retailprice FROM part")
def all_strings(spark, sf_dir):
    path = _folder(spark, "strings")
    sinks.write_parquet(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, as_strings=True)
    return spark.read.parquet(path)


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS line, c_name AS value FROM customer")
def sorted_lines(spark, sf_dir):
    path = _folder(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("value")), path, order=["c_custkey"])
    read = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    # A customer's name carries its number, so the place in the files can be compared with it.
    ranked = unify.ranked(read, ["file", "at"])
    return ranked.select(F.col("rank").alias("line"), "value")


@query("SELECT '10.1/c' || c_custkey AS citing_doi, ['10.2/' || c_custkey, '10.2/x'] AS cited_dois FROM customer WHERE c_custkey % 50 <> 7")
def incremental_references(spark, sf_dir):
    """Three calls of the incremental refresh over new files; a service that fails for some keys, which are asked again and fail again."""
    from refweave.streaming.incremental import loaded_batches, refresh

    folder = _folder(spark, "stream")
    incoming, references, errors, state = (f"{folder}/{x}" for x in ("in", "references", "errors", "state"))

    def answer(keys):
        out = []
        for key in keys:
            number = key.removeprefix("10.1/c")
            body = '[{"citing":"omid:br/1 doi:%s","cited":"doi:10.2/%s"},{"citing":"omid:br/1 doi:%s","cited":"omid:br/2 doi:10.2/x"}]' % (key, number, key)
            out.append((key, 500, "down") if int(number) % 50 == 7 else (key, 200, body))
        return out

    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("10.1/C"), _text("c_custkey")).alias("doi"), (F.col("c_custkey") % 3).alias("part"))
    for part in range(3):
        # Each file repeats keys of the ones before; only those without an answer are asked for.
        keys.filter(F.col("part") <= part).select("doi").write.mode("append").parquet(incoming)
        refresh(spark, incoming, references, errors, state, answer, batch=100, pause=0.0, lanes=4)
    return loaded_batches(spark, references).select("citing_doi", "cited_dois")


@query("SELECT count(*) AS vertices, true AS centred, true AS spread FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey)")
def layout_invariants(spark, sf_dir):
    """A layout has a place for each vertex, its centre in the middle, and a unit of area a vertex. Vertices are the parts of all lines, edges those between lines of an order."""
    from refweave.operators.layout import layout

    # Dealt by orders once, for both sides; a side of the orders alone is small enough to be hashed.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).repartition("l_orderkey")
    pairs = lines.join(lines.groupBy("l_orderkey").agg(F.min("part").alias("dst")).hint("shuffle_hash"), "l_orderkey").select(F.col("part").alias("src"), "dst")
    placed = layout(pairs, rounds=30)
    n = F.count("*")
    off = F.abs(F.avg("x")) + F.abs(F.avg("y"))
    return placed.agg(n.alias("vertices"), (off < 1e-6).alias("centred"), (F.abs(F.var_pop("x") + F.var_pop("y") - n / 6) < n * 1e-6).alias("spread"))


@query("SELECT p_partkey, p_size + 1 AS p_size FROM part")
def replaced_table(spark, sf_dir):
    """A table is put in place of the one that it reads."""
    path = _folder(spark, "table")
    sinks.write_parquet(table(spark, sf_dir, "part").select("p_partkey", "p_size"), path)
    sinks.replace_parquet(spark.read.parquet(path).withColumn("p_size", F.col("p_size") + 1), path)
    return spark.read.parquet(path)
