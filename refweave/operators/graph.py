"""The citation network as two tables: vertices (name) and edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.lineage import cut
from refweave.operators.communities import communities  # noqa: F401
from refweave.operators.components import component_labels
from refweave.operators.layout import layout  # noqa: F401
from refweave.operators.skew import lookup
from refweave.operators.unify import ranked


def valid_keys(df: DataFrame, key: str = "doi") -> DataFrame:
    """(name): distinct lower-cased keys, neither null nor empty."""
    return df.select(F.lower(key).alias("name")).filter(F.col("name") != "").distinct()


def citation_edges(references: DataFrame, valid: DataFrame, citing: str = "citing_doi", cited: str = "cited_dois", literal: bool = False) -> DataFrame:
    """(src, dst) of all citations within ``valid``, repeats and loops included. ``literal`` matches cited keys in their own case. Both semi-joins choose their strategy by size."""
    flat = references.select(F.lower(citing).alias("src"), F.explode(cited).alias("dst"))
    flat = flat if literal else flat.withColumn("dst", F.lower("dst"))
    known = flat.filter((F.col("src") != "") & (F.col("dst") != ""))
    return known.join(valid.select(F.col("name").alias("src")), "src", "left_semi").join(valid.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")


def vertex_ids(valid: DataFrame) -> DataFrame:
    """(name, id): ranks from 0 in the order of names."""
    return ranked(valid.select("name"), ["name"]).select("name", F.col("rank").alias("id"))


def edges_by_id(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with src_id and dst_id. Names with very many edges are looked up by broadcast, others by a shuffle."""
    total = max(1, edges.count())
    for side in ("src", "dst"):
        counted = ids.join(edges.groupBy(F.col(side).alias("name")).agg(F.count("*").alias("n")), "name")
        edges = lookup(edges, counted.select(F.col("name").alias(side), F.col("id").alias(f"{side}_id"), "n"), side, "n", total)
    return edges


def citation_network(database: DataFrame, references: DataFrame, literal: bool = False) -> tuple[DataFrame, DataFrame]:
    """The giant component of the citations within the database: (name, id) of its vertices, with ids among all valid keys, and (src, dst, src_id, dst_id) of its edges."""
    valid = valid_keys(database)
    ids = cut(vertex_ids(valid))
    edges = cut(citation_edges(references, ids.select("name"), literal=literal))
    giant = cut(giant_component(edges).select("name"))
    inside = edges.join(giant.select(F.col("name").alias("src")), "src", "left_semi")
    return ids.join(giant, "name", "left_semi"), edges_by_id(inside, ids)


def degrees(edges: DataFrame) -> DataFrame:
    """(name, degree): in and out together; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def isolated(valid: DataFrame, edges: DataFrame) -> DataFrame:
    return valid.join(degrees(edges), "name", "left_anti")


def giant_component(edges: DataFrame) -> DataFrame:
    """(name, label) of the largest component; of equal ones that with the least name."""
    labels = cut(component_labels(edges))
    best = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return labels.join(best.select("label"), "label", "left_semi").select(F.col("id").alias("name"), "label")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def stage_stats(valid: DataFrame, edges: DataFrame) -> DataFrame:
    """(stage, vertices, edges): all, without isolated vertices, and of the giant component."""
    giant = giant_component(edges).select("name")
    inside = edges.join(giant.select(F.col("name").alias("src")), "src", "left_semi")

    def row(stage: str, v: DataFrame, e: DataFrame) -> DataFrame:
        counts = v.agg(F.count("*").alias("vertices")).withColumn("_", F.lit(1)).join(e.agg(F.count("*").alias("edges")).withColumn("_", F.lit(1)), "_")
        return counts.select(F.lit(stage).alias("stage"), "vertices", "edges")

    return row("all", valid, edges).union(row("connected", degrees(edges), edges)).union(row("giant", giant, inside))


def community_table(labels: DataFrame) -> DataFrame:
    """(name, community_id, community_size) from (name, label): numbers from 0 by falling size, then label."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("community_size"))
    numbered = cut(ranked(sizes.withColumn("fewest", -F.col("community_size")), ["fewest", "label"]).select("label", "community_size", F.col("rank").alias("community_id")))
    total = numbered.agg(F.sum("community_size").alias("n")).first()["n"] or 0
    found = lookup(labels, numbered.withColumn("n", F.col("community_size")), "label", "n", total)
    return found.select("name", "community_id", "community_size")


def sorted_members(table: DataFrame) -> DataFrame:
    """The community table in the order of community_id and name."""
    return table.orderBy("community_id", "name")


def community_counts(table: DataFrame) -> DataFrame:
    """(communities, members): how many there are."""
    return table.agg(F.count_distinct("community_id").alias("communities"), F.count("*").alias("members"))


def cpm_quality(edges: DataFrame, labels: DataFrame, resolution: float) -> DataFrame:
    """(quality): sum over communities of inner edges - resolution * n * (n - 1)."""
    a = labels.select(F.col("name").alias("src"), F.col("label").alias("a"))
    b = labels.select(F.col("name").alias("dst"), F.col("label").alias("b"))
    inner = edges.join(a, "src").join(b, "dst").filter(F.col("a") == F.col("b")).groupBy(F.col("a").alias("label")).agg(F.count("*").alias("e"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.join(inner, "label", "left").agg(F.sum(F.coalesce("e", F.lit(0)) - resolution * F.col("n") * (F.col("n") - 1)).alias("quality"))


def tfidf(terms: DataFrame, group: str, term: str) -> DataFrame:
    """(group, term, tf, score): characteristic terms of each group; score = tf * ln(groups / groups with the term)."""
    tf = terms.groupBy(group, term).agg(F.count("*").alias("tf"))
    df = tf.groupBy(term).agg(F.count("*").alias("df"))
    total = terms.agg(F.count_distinct(group).alias("groups")).withColumn("_", F.lit(1))
    return tf.join(df, term).withColumn("_", F.lit(1)).join(F.broadcast(total), "_").select(group, term, "tf", (F.col("tf") * F.log(F.col("groups") / F.col("df"))).alias("score"))
