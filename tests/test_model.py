"""Readers, cleaners, unification, exporters, graph operators and the step registry."""

import random
import xml.etree.ElementTree as ET
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from refweave.functions import text as X
from refweave.functions.lineage import cut
from refweave.operators import graph, unify
from refweave.operators.components import component_labels
from refweave.plans import normalize
from refweave.plans.pipeline import Pipeline, PipelineError
from refweave.plans.schema import SchemaViolation, validated
from refweave.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title,DOI\n"say ""hi""\nthere",10.1/A\nplain,\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r.Title for r in rows] == ['say "hi"\nthere', "plain"] and rows[1].DOI is None
    (tmp_path / "w.txt").write_text('﻿TI\tAU\tPY\n"odd\tB\t2001\nshort\nlong\ta\tb\tc\nok\tC\t2002\n')
    rows = readers.read_literal_tsv(spark, str(tmp_path / "w.txt")).collect()
    assert [(r.TI, r.PY) for r in rows] == [('"odd', "2001"), ("short", None), ("ok", "2002")]
    assert readers.read_all(spark, [str(tmp_path / "w.txt"), str(tmp_path / "none.txt")], readers.read_literal_tsv).count() == 3
    with pytest.raises(ValueError):
        readers.read_all(spark, [], readers.read_literal_tsv)
    with pytest.raises(ValueError):
        readers.read_parquet(spark, "x.csv")


def test_rows_with_more_cells_than_the_header_are_left_out(spark, tmp_path):
    (tmp_path / "long.csv").write_text('a,b\n1,2\n3,4,5\n6\n"x, ""y""",\n"p","q\nr","s"\n"u\n,v",w\n7,8,\n')
    rows = readers.read_csv(spark, str(tmp_path / "long.csv"))
    assert [tuple(r) for r in rows.collect()] == [("1", "2"), ("6", None), ('x, "y"', None), ("u\n,v", "w")]
    assert [r.b for r in rows.select("b").collect()] == ["2", None, None, "w"]  # with the other columns pruned too
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "long.csv"), "a string, b int").limit(2).collect()] == [("1", 2), ("6", None)]
    (tmp_path / "same.txt").write_text("A\tB\nA\tB\n1\t\"2\n3\t4\t\n")
    assert [tuple(r) for r in readers.read_literal_tsv(spark, str(tmp_path / "same.txt")).collect()] == [("A", "B"), ("1", '"2')]


def test_cleaners(spark):
    names = ["Title", "Author full names", "Author(s) ID", "Abstract", "Author Keywords", "Source title", "Source", "DOI", "PubMed ID", "Year"]
    rows = [("t", "Doe, Jane (123); Roe, K. (456)", "1; 2", "nan", None, "j", "Scopus", "10.1/ABC", "123.0", "2015"), ("banana", "A (1)", "1; 2", "a", "k; l", "j", "Scopus", None, None, "x")]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    a, b = validated(normalize.clean_scopus(df)).collect()
    assert a.authors == ["Doe, Jane", "Roe, K."] and a.abstract == "" and a.keywords == [""] and a.doi == "10.1/abc" and (a.pubmed_id, a.year) == (123, 2015)
    assert b.title == "banana" and b.doi == "" and b.year is None
    assert [tuple(r) for r in normalize.scopus_author_ids(df).collect()] == [("Doe, Jane", 1), ("Roe, K.", 2)]
    wos = spark.createDataFrame([("t", "A; B", "x", "<i>k</i>; l", "j", "10.1/X", "5", "1999.0")], "TI string, AU string, AB string, DE string, SO string, DI string, PM string, PY string")
    r = normalize.clean_web_of_science(wos).first()
    assert r.keywords == ["k", "l"] and r.year == 1999 and r.source_database == "Web of Science"
    pub = spark.createDataFrame([("1", "t", None, None, None, None, [("A", None), (None, None), ("B", "C")], None)], "pubmed_id string, title string, abstract string, keywords array<string>, journal string, publication_date string, authors array<struct<firstname:string,lastname:string>>, doi string")
    r = validated(normalize.clean_pubmed(pub)).first()
    assert r.authors == ["A", "B C"] and r.keywords == [] and r.year is None
    assert normalize.clean_pubmed(pub, literal=True).first().authors == ["A ", "B C"]
    eb = spark.createDataFrame([("t", None, None, "a; b", "j", "db", None, "20200101")], "title string, contributors string, abstract string, subjects string, source string, longDBName string, doi string, publicationDate string")
    r = validated(normalize.clean_ebsco(eb)).first()
    assert r.authors == [] and r.keywords == ["a", "b"] and r.year == 2020
    bad = normalize.clean_ebsco(eb).withColumn("doi", F.lit("10.1/A"))
    with pytest.raises(SchemaViolation):
        validated(bad)
    with pytest.raises(SchemaViolation):
        validated(bad.withColumn("more", F.lit(1)))


def test_fill_first_equals_the_window_form(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", "", None]), k, rng.choice([None, 1, 2]), rng.choice([None, "x", ""])) for k in range(60)]
    df = spark.createDataFrame(rows, "doi string, pos int, u int, v string")
    up, down = Window.partitionBy("doi").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("doi").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    filled = df.filter("doi is not null").select("doi", "pos", *[F.coalesce(F.last(c, True).over(up), F.first(c, True).over(down)).alias(c) for c in ("u", "v")])
    want = {tuple(r) for r in unify.distinct_on(filled, "doi", ["pos"]).select("doi", "u", "v").collect()}
    assert {tuple(r) for r in unify.fill_first(df, "doi", ["pos"], blank_is_null=False).collect()} == want
    assert unify.fill_first(df, "doi", ["pos"]).count() == 3
    with pytest.raises(ValueError):
        unify.unify([])


def test_scalar_functions(spark):
    assert one(spark, X.wrapped(F.lit("aa bb " * 20), 20, 2)).split("\n")[0] == "aa bb aa bb aa bb aa"
    assert one(spark, X.wrapped(F.lit(None).cast("string"))) == ""
    assert one(spark, X.inverted_name(F.lit(None).cast("string"), F.lit("Doe"))) == "Doe"
    assert one(spark, X.short_name(F.lit("Jane"), F.lit("Doe"))) == "Doe J"
    assert one(spark, X.last_token(F.lit(" Jane van Doe "))) == "Doe"
    assert one(spark, X.doi_of(F.lit("omid:br/1 doi:10.1/a b"))) == "10.1/a" and one(spark, X.doi_of(F.lit("x"))) is None
    assert [one(spark, X.whole_number(F.lit(v))) for v in ("2015.0", "", "1.5", "nan")] == [2015, None, None, None]
    assert one(spark, X.without_ids(F.lit("Roe, K. (A (b) c)"))) == "Roe, K. c)"


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(60)] + [(500, 500)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = component_labels(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.id: r.label for r in got} == {v: find(v) for v in parent}
    assert component_labels(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_graph_and_graphml(spark, tmp_path):
    refs = spark.createDataFrame([("10/A", ["10/b", "10/C", "10/x"]), ("10/b", ["10/a"]), ("10/d", None), ("10/e", ["10/f"])], "citing_doi string, cited_dois array<string>")
    valid = graph.valid_keys(spark.createDataFrame([(c,) for c in ("10/a", "10/B", "10/c", "10/d", "10/e", "10/f", "", None)], "doi string"))
    edges = graph.citation_edges(refs, valid)
    assert edges.count() == 4 and graph.citation_edges(refs, valid, literal=True).count() == 3
    assert [r.name for r in graph.isolated(valid, edges).collect()] == ["10/d"]
    assert {r.name for r in graph.giant_component(edges).collect()} == {"10/a", "10/b", "10/c"}
    ids = graph.vertex_ids(valid)
    assert [r.id for r in ids.orderBy("name").collect()] == list(range(6))
    xy = ids.join(graph.layout(edges, rounds=2), "name")
    assert xy.collect() == ids.join(graph.layout(edges, rounds=2), "name").collect()
    numbered = edges.join(ids.select(F.col("name").alias("src"), F.col("id").alias("src_id")), "src").join(ids.select(F.col("name").alias("dst"), F.col("id").alias("dst_id")), "dst")
    sinks.write_graphml(xy, numbered, str(tmp_path / "g"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part*")))
    root = ET.fromstring(whole.encode())
    assert len(root.findall(".//{*}node")) == 5 and len(root.findall(".//{*}edge")) == 4


def test_communities_are_within_components(spark):
    clique = [(a, b) for a in range(5) for b in range(5) if a != b] + [(a, b) for a in range(10, 15) for b in range(10, 15) if a != b] + [(0, 10)]
    got = graph.communities(spark.createDataFrame(clique, "src long, dst long"), [0.5]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.label, set()).add(r.name)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]


def test_large_cliques_come_out_whole(spark):
    clique = [(a, b) for k in (0, 1000) for a in range(k, k + 60) for b in range(a + 1, k + 60)] + [(0, 1000), (1, 1001)]
    edges = spark.createDataFrame(clique, "src long, dst long")
    got = cut(graph.communities(edges, [0.05]))
    groups = {}
    for r in got.collect():
        groups.setdefault(r.label, set()).add(r.name)
    assert sorted(map(sorted, groups.values())) == [list(range(60)), list(range(1000, 1060))]
    assert graph.cpm_quality(edges, got, 0.05).first()["quality"] == pytest.approx(2 * (1770 - 0.05 * 60 * 59))


def test_communities_have_no_gaining_move_left(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)]
    label = {r.name: r.label for r in graph.communities(spark.createDataFrame(pairs, "src long, dst long"), [0.2]).collect()}

    def quality(of):
        sizes = Counter(of.values())
        return sum(a != b and of[a] == of[b] for a, b in pairs) - 0.2 * sum(n * (n - 1) for n in sizes.values())

    for v in label:
        for d in set(label.values()):
            assert quality(label | {v: d}) <= quality(label) + 1e-6
    for c in set(label.values()):
        for d in set(label.values()):
            assert quality({v: d if of == c else of for v, of in label.items()}) <= quality(label) + 1e-6


def test_bibtex(spark):
    people = F.array(F.struct(F.lit("Jane").alias("firstname"), F.lit("Doe").alias("lastname")))
    text = one(spark, sinks.bibtex(F.lit("7"), F.lit("T"), people, F.lit("J"), F.lit(None).cast("date"), F.lit("A"), F.array(F.lit("k"), F.lit("l")), F.lit("10/A")))
    assert text.split("\n") == ["@ARTICLE{PMID7,", "  title = {T},", "  author = {Jane Doe},", "  journal = {J},", "  abstract = {A},", "  keywords = {k; l},", "  doi = {10/a},", "  PMID = {7}", "}"]


def test_pipeline():
    def base__a(x):
        return x + 1

    def base__b(x):
        return x + 2

    def pair(base, extra=10):
        return {"low": base, "high": base + extra}

    def total(low, high):
        return low + high

    def made(k):
        p = Pipeline(config={"kind": k})
        return p.add(base__a, when={"kind": "a"}).add(base__b, when={"kind": "b"}).add(pair, fields=("low", "high")).add(total)

    assert made("a").execute(["total"], {"x": 1}) == {"total": 14}
    assert made("b").execute(["total"], {"x": 1, "extra": 0}) == {"total": 6}
    with pytest.raises(PipelineError, match="missing"):
        made("a").execute(["total"])
    loop = Pipeline().add(lambda b: b, "a").add(lambda a: a, "b")
    with pytest.raises(PipelineError, match="cycle"):
        loop.order(["a"])
    each = Pipeline().add_each(lambda part, base: part + base, {"f1": {"part": "x"}, "f2": {"part": "y", "base": ("step", "f1")}})
    assert each.execute(["f2"], {"base": "z"}) == {"f2": "yxz"}
    assert '"pair" -> "low"' in made("a").dot(["total"], {"x"})


def test_layout_in_rounds_of_joins_equals_one_task(spark):
    rng = random.Random(8)
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(60)], "src long, dst long")
    one_task, rounds = ({r.name: (r.x, r.y) for r in graph.layout(edges, rounds=5, in_memory=k).collect()} for k in (10**6, 0))
    assert one_task.keys() == rounds.keys()
    assert all(one_task[v] == pytest.approx(rounds[v], rel=1e-6, abs=1e-6) for v in one_task)
    assert graph.layout(edges.limit(0), rounds=3).count() == graph.layout(edges.limit(0), rounds=3, in_memory=0).count() == 0


@pytest.mark.parametrize("in_memory", [10**6, 0])
def test_communities_are_connected_and_stable(spark, in_memory):
    rng = random.Random(7)
    # A chain of cliques, and vertices that hold far parts together only by resolution.
    pairs = [(a, b) for k in range(0, 24, 6) for a in range(k, k + 6) for b in range(a + 1, k + 6) if rng.random() < 0.8] + [(k, k + 6) for k in range(0, 18, 6)] + [(30, 30), (5, 5)]
    label = {r.name: r.label for r in graph.communities(spark.createDataFrame(pairs, "src long, dst long"), [0.1], in_memory).collect()}
    assert label.keys() == {v for e in pairs for v in e}

    def quality(of):
        sizes = Counter(of.values())
        return sum(a != b and of[a] == of[b] for a, b in pairs) - 0.1 * sum(n * (n - 1) for n in sizes.values())

    for v in label:
        for d in set(label.values()):
            assert quality(label | {v: d}) <= quality(label) + 1e-6
    for c in set(label.values()):
        own = {v for v in label if label[v] == c}
        assert c in own
        reached = {min(own)}
        while more := {b for a, b in pairs + [(b, a) for a, b in pairs] if a in reached and b in own} - reached:
            reached |= more
        assert reached == own
