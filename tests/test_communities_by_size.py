"""Communities depend on the graph alone: not on the size up to which a component stays in one task, nor on what else the input holds."""

import random

import pytest
from pyspark.sql import functions as F
from refweave.operators import graph


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    return [(rng.randrange(50), rng.randrange(50)) for _ in range(200)] + [(200 + rng.randrange(12), 200 + rng.randrange(12)) for _ in range(30)] + [(300, 300)]


def _found(spark, pairs, in_memory, kind="long"):
    edges = spark.createDataFrame(pairs, "src long, dst long").select(F.col("src").cast(kind), F.col("dst").cast(kind))
    return {(r.resolution, r.name): r.label for r in graph.communities(edges, [0.1], in_memory).collect()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_slices_and_single_tasks_give_the_same_communities(spark, pairs, kind, monkeypatch):
    monkeypatch.setattr("refweave.operators.communities.SLICE", 150, raising=False)
    whole = _found(spark, pairs, 10**6, kind)
    assert len(set(whole.values())) > 5
    assert _found(spark, pairs, 60, kind) == whole  # the larger component over slices


def test_a_component_has_the_same_communities_with_others_beside_it(spark, pairs):
    alone, rng = _found(spark, [e for e in pairs if e[0] < 200], 10**6), random.Random(12)
    more = [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(150)]
    beside = _found(spark, pairs + more, 10**6)
    assert {k: v for k, v in beside.items() if k[1] < 200} == alone
