"""Weakly connected components by alternating large and small stars (Kiveris et al. 2014).

Both steps are an aggregation by vertex (a minimum, combined before the shuffle) and a
lookup of it for each edge. Each component soon is a star, whose centre has as many edges as the component has vertices, so the lookup
is ``skew.lookup``: the edges of centres with more than a thousandth of all edges stay where they are and get the minimum by broadcast. The
number of rounds grows with the logarithm of the longest path. Every
round ends in a checkpoint in the shared folder.

``labels_by_forests`` gives the same labels: each partition first keeps no more of its edges than connect what they connect, as stars, and
up to ``IN_TASK`` rows of these are joined in one task instead of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.lineage import cut
from refweave.operators.skew import lookup


def _towards_least(edges: DataFrame, among: DataFrame, total: int) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all its v ``among`` the edges, of which there are ``total``."""
    least = among.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return lookup(edges, least.select("u", F.least("u", "m").alias("m"), "n"), "u", "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    up = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    both = up.union(up.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _towards_least(up, both, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _towards_least(down, down, total)
    pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return linked.select(pairs.alias("p")).select("p.u", "p.v").filter(F.col("u") != F.col("v")).distinct()


#: Up to so many rows of stars are joined in one task (about 200 bytes each); a partition holds so many edges at once besides its stars.
IN_TASK = 1_000_000


def _least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of each vertex's component: roots are hung below lesser ones until no edge is between two."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def forests(edges: DataFrame) -> DataFrame:
    """(u, v) of the edges (u, v), by partition: each vertex with the least one that the partition's edges connect it to."""

    def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, names = pd.factorize(np.concatenate([u, v]), sort=True)
        return names, names[_least_linked(at[: len(u)], at[len(u) :], len(names))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in parts:
            held.append((part["u"].to_numpy(), part["v"].to_numpy()))
            n += len(part)
            if n >= IN_TASK:
                held, n = [joined(*map(np.concatenate, zip(*held, strict=True)))], 0
        if held:
            u, v = joined(*map(np.concatenate, zip(*held, strict=True)))
            for k in range(0, len(u), 100_000):
                yield pd.DataFrame({"u": u[k : k + 100_000], "v": v[k : k + 100_000]})

    return edges.mapInPandas(run, f"u {dict(edges.dtypes)['u']}, v {dict(edges.dtypes)['v']}")


def labels_by_forests(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """The labels of ``component_labels`` for edges (src, dst) with keys that sort in Python as in Spark: numbers or strings."""
    known = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    stars = cut(forests(known.repartitionByRange("u", "v")))  # edges near each other share vertices
    if stars.count() <= in_task:
        return cut(forests(stars.coalesce(1))).select(F.col("u").alias("id"), F.col("v").alias("label"))
    return component_labels(stars, "u", "v")


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, label) for every endpoint: the least vertex of its component. Direction, repeats and loops don't matter; edges with a null end are dropped."""
    known = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    vertices = known.select("u").union(known.select("v")).distinct()
    now = cut(known.filter(F.col("u") != F.col("v")).distinct())
    mark = None
    seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    while seen != mark:
        mark = seen
        now = cut(_small_star(cut(_large_star(now, mark["n"])), mark["n"]))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return vertices.join(now, "u", "left").select(F.col("u").alias("id"), F.coalesce("v", "u").alias("label"))
