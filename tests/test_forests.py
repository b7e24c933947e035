"""Components by forests are those by stars, and a look at kept links is a look at all edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from refweave.operators import components as C
from refweave.operators import leiden as L


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("in_task", [10**6, 0])
def test_forests_give_the_labels_of_the_rounds(spark, kind, in_task, monkeypatch):
    monkeypatch.setattr(C, "IN_TASK", 7)  # forests grow batch by batch
    rng = random.Random(5)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(k, k + 1) for k in range(100, 140)] + [(200, 200), (201, None), (None, 202)]
    edges = spark.createDataFrame(pairs, "src long, dst long").select(F.col("src").cast(kind), F.col("dst").cast(kind))
    got, want = ({(r.id, r.label) for r in labels.collect()} for labels in (C.labels_by_forests(edges, in_task), C.component_labels(edges)))
    assert got == want
    assert len({c for _, c in want}) > 3


def test_no_edges_have_no_labels(spark):
    assert C.labels_by_forests(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_kept_links_show_the_same_gaining_nodes():
    rng = np.random.default_rng(3)
    n = 60
    g = L.graph_of(rng.integers(0, n, 150), rng.integers(0, n, 150), np.ones(150), np.arange(n, dtype=np.uint64))
    label = np.arange(n)
    for k in range(40):
        label = label.copy()
        moved = rng.integers(0, n, n if k == 20 else 2)
        label[moved] = label[rng.integers(0, n, len(moved))]
        label = L._least(label, n)
        st = L.State(label, np.bincount(label, g.sizes, minlength=n).astype(np.int64), g.sizes, 0.05, np.ones(n, bool))
        assert g.gaining(st).tolist() == L.best_moves(g.src, g.dst, g.weights, st)[0].tolist()
