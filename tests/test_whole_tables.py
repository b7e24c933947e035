"""Queries over whole tables: no row is left out by a quantity or an id."""

import inspect
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from refweave.operators import graph
from refweave.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    rng = random.Random(6)
    lines = [(o, n, rng.randrange(1, 60), rng.randrange(1, 51)) for o in range(20) for n in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity int").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in range(1, 60)], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, 100 + k) for k in range(20, 50)], "doc_id long, n_chars int").write.parquet(f"{folder}/documents.parquet")
    first = {o: p for o, n, p, _ in lines if n == 1}
    return str(folder), lines, [(first[o], p) for o, n, p, _ in lines if n > 1]


def _rows(spark, tables, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, tables[0]).collect()]


def test_graph_queries_read_all_lines(spark, tables):
    _, lines, edges = tables
    degree = Counter(v for e in edges for v in e)
    assert Counter(_rows(spark, tables, "citation_edges")) == Counter(edges)
    assert dict(_rows(spark, tables, "vertex_degree")) == degree
    assert {r[0] for r in _rows(spark, tables, "isolated_vertices")} == set(range(1, 60)) - set(degree)
    assert set(_rows(spark, tables, "undirected_projection")) == {(min(e), max(e)) for e in edges}
    want = {o: sorted({p for k, _, p, _ in lines if k == o}) for o in range(20)}
    assert {o: list(map(int, c)) for o, c, _ in _rows(spark, tables, "adjacency_lists")} == want


def test_components_of_all_lines_against_union_find(spark, tables):
    edges = tables[2]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    label = {v: find(v) for v in parent}
    sizes = Counter(label.values())
    best = min(sizes, key=lambda c: (-sizes[c], c))
    assert dict(_rows(spark, tables, "components")) == label
    assert dict(_rows(spark, tables, "giant_component")) == {v: c for v, c in label.items() if c == best}
    inside = sum(label[a] == best for a, _ in edges)
    assert set(_rows(spark, tables, "graph_stage_stats")) == {("all", 59, len(edges)), ("connected", len(label), len(edges)), ("giant", sizes[best], inside)}
    assert {n: s for n, _, s in _rows(spark, tables, "community_table")} == {v: sizes[c] for v, c in label.items()}
    assert _rows(spark, tables, "cpm_quality")[0][0] == pytest.approx(len(edges) - 0.05 * sum(n * (n - 1) for n in sizes.values()))


def test_communities_query_reads_all_lines(spark, tables):
    assert {r[1] for r in _rows(spark, tables, "communities_cpm")} == {v for e in tables[2] for v in e}


def test_merge_takes_all_ids(spark, tables):
    assert dict(_rows(spark, tables, "merge_precedence")) == {k: 100 + k for k in range(30, 50)} | {k: k % 2 for k in range(1, 30)}


def test_layout_moves_as_far_as_a_large_start_needs(spark):
    assert inspect.signature(graph.layout).parameters["rounds"].default == 500
    edges = spark.range(16_000).select((F.col("id") - F.col("id") % 8).alias("of"), F.col("id").alias("src")).withColumn("dst", F.explode(F.sequence("of", F.col("of") + 7))).filter("src < dst").select("src", "dst")
    at = {r["name"]: (r["x"], r["y"]) for r in graph.layout(edges, rounds=60).collect()}
    apart = [sum((a - b) ** 2 for a, b in zip(at[r["src"]], at[r["dst"]], strict=True)) ** 0.5 for r in edges.collect()]
    assert sum(apart) / len(apart) < 0.1 * 16_000**0.5
