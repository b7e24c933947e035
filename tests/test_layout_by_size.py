"""A layout whose edges are dealt out in slices is that of one task, to the last bit."""

import random

import pytest
from refweave.operators import graph


def test_slices_place_vertices_as_one_task_does(spark, monkeypatch):
    monkeypatch.setattr("refweave.operators.layout.SLICE", 60, raising=False)
    rng = random.Random(9)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(80)] + [(90, 90), (91, 92)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    one, slices = ({r.name: (r.x, r.y) for r in graph.layout(edges, rounds=12, in_memory=k).collect()} for k in (10**6, 0))
    assert one.keys() == slices.keys() == {v for e in pairs for v in e}
    assert all(one[v] == pytest.approx(slices[v], rel=1e-12, abs=1e-12) for v in one)


def test_rounds_of_joins_place_them_so_too(spark):
    rng = random.Random(8)
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(60)], "src long, dst long")
    one, joins = ({r.name: (r.x, r.y) for r in graph.layout(edges, rounds=3, in_memory=k, in_driver=k).collect()} for k in (10**6, 0))
    assert one.keys() == joins.keys()
    assert all(one[v] == pytest.approx(joins[v], rel=1e-6, abs=1e-6) for v in one)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_slices_take_repeats_loops_and_nulls_as_one_task_does(spark, kind, monkeypatch):
    monkeypatch.setattr("refweave.operators.layout.SLICE", 50, raising=False)
    rng = random.Random(7)
    pairs = [(rng.randrange(-15, 15), rng.randrange(-15, 15)) for _ in range(150)] * 2 + [(90, 90), (91, 92), (92, 91), (93, None)]
    edges = spark.createDataFrame(pairs, "src long, dst long").selectExpr(f"cast(src as {kind.replace('long', 'bigint')}) src", f"cast(dst as {kind.replace('long', 'bigint')}) dst")
    slices = {r.name: (r.x, r.y) for r in graph.layout(edges, rounds=6, in_memory=0).collect()}
    assert slices.keys() == {str(v) if kind == "string" and v is not None else v for e in pairs for v in e}
    if kind == "long":
        known = edges.filter("dst is not null")
        one, many = ({r.name: (r.x, r.y) for r in graph.layout(known, rounds=6, in_memory=k).collect()} for k in (10**6, 0))
        assert one.keys() == many.keys()
        assert all(one[v] == pytest.approx(many[v], rel=1e-12, abs=1e-12) for v in one)


def test_distinct_edges_are_not_shuffled_where_slices_come_for_sure(spark, monkeypatch):
    from refweave.operators import layout as Y

    given = []
    monkeypatch.setattr(Y, "_over_slices", lambda edges, start, rounds: given.append(edges.count()) or start.select("name", "x", "y"))
    Y.layout(spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "src long, dst long"), in_memory=2)
    assert given == [2]
