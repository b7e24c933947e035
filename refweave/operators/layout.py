"""A force-directed layout of the citation network (after ForceAtlas2, Jacomy et al. 2014).

Edges of the undirected projection pull their ends together in proportion to the distance; vertices repel each other by
``REPULSION`` times the product of their masses (degree + 1) over the distance; gravity pulls each by its mass to the centre. Repulsion is
taken from the centres of mass of the cells of a ``GRID`` x ``GRID`` grid over the whole layout, near and far ones alike, without
the vertex itself; within a cell's radius it falls to 0 towards the centre, as in a disc of even mass. The speed adapts to swinging and traction, for the whole layout and for each vertex.

The start is a hash of the name and the seed in a square of one unit of area a vertex, so results repeat. The forces have a scale of their own; the
result is centred and scaled to the spread of the start. Graphs of up to ``IN_MEMORY`` edges and vertices run all rounds within one task; larger
ones with the edges in slices, a job a round, which gives the same sums; those of more than ``IN_DRIVER`` vertices
are two aggregations and an equi-join a round, with the table of cells, at most GRID * GRID rows, as constants of the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.functions.lineage import cut
from refweave.operators.unify import ranked

REPULSION, GRAVITY, TOLERANCE = 2.0, 1.0, 1.0
GRID = 16
IN_MEMORY = 1_000_000
#: Up to so many vertices, their places (about 150 bytes each) are in the driver; beyond, every round is joins.
IN_DRIVER = 3_000_000
#: Edges (in both directions) and vertices of a slice.
SLICE = 500_000


def _box(low: float, high: float) -> tuple[float, float]:
    """The start and size of the cells between two coordinates."""
    return low, max((high - low) / GRID, 1e-9)


def _speed(before: float, swing: float, traction: float, r: int) -> float:
    """The speed of the whole layout, which rises by at most half a round."""
    wanted = TOLERANCE * traction / swing if swing > 0 else before or 1.0
    return wanted if r == 0 else min(wanted, 1.5 * before)


def _forces(lo: int, starts: np.ndarray, dst: np.ndarray, x: np.ndarray, y: np.ndarray, mass: np.ndarray, cell: np.ndarray, cells: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pull and repulsion of the vertices from ``lo`` on, whose neighbours are ``dst`` cut at ``starts``. Each vertex's sums don't depend on what else is in the slice."""
    degree, n = np.diff(starts), len(starts) - 1
    some, at = np.flatnonzero(degree), slice(lo, lo + n)
    fx, fy = np.zeros(n), np.zeros(n)
    if len(some):
        fx[some], fy[some] = np.add.reduceat(x[dst], starts[some]), np.add.reduceat(y[dst], starts[some])
    x, y, mass, cell = x[at], y[at], mass[at], cell[at]
    fx, fy = fx - degree * x, fy - degree * y
    m, mx, my = cells
    full = np.flatnonzero(m)
    cx, cy, weight = mx[full] / m[full], my[full] / m[full], m[full]
    for k in range(0, n, 1024):
        part = slice(k, k + 1024)
        dx, dy = x[part, None] - cx, y[part, None] - cy
        push = dx * dx
        push += dy * dy
        np.maximum(push, least, out=push)
        np.divide(weight, push, out=push)
        fx[part] += REPULSION * mass[part] * np.einsum("ij,ij->i", push, dx)
        fy[part] += REPULSION * mass[part] * np.einsum("ij,ij->i", push, dy)
    # The own cell counts without the vertex itself.
    whole, left = m[cell], m[cell] - mass
    safe = np.where(left > 0, left, 1.0)
    for sign, amount, dx, dy in ((-1, whole, x - mx[cell] / whole, y - my[cell] / whole), (1, np.maximum(left, 0.0), x - (mx[cell] - mass * x) / safe, y - (my[cell] - mass * y) / safe)):
        push = sign * REPULSION * mass * amount / np.maximum(dx * dx + dy * dy, least)
        fx += push * dx
        fy += push * dy
    return fx, fy


def _rounds(x: np.ndarray, y: np.ndarray, mass: np.ndarray, rounds: int, forces) -> tuple[np.ndarray, np.ndarray]:
    """The positions after all rounds; ``forces`` gives ``_forces`` of all vertices."""
    n, speed = len(x), 0.0
    old_x, old_y = np.zeros(n), np.zeros(n)
    for r in range(rounds if n else 0):
        (x0, sx), (y0, sy) = _box(x.min(), x.max()), _box(y.min(), y.max())
        cell = np.minimum((x - x0) // sx, GRID - 1).astype(np.int64) * GRID + np.minimum((y - y0) // sy, GRID - 1).astype(np.int64)
        cells = np.stack([np.bincount(cell, w, minlength=GRID * GRID) for w in (mass, mass * x, mass * y)])
        fx, fy = forces(x, y, mass, cell, cells, (sx * sx + sy * sy) / 8)
        far = np.sqrt(x * x + y * y) + 1e-9
        fx, fy = fx - GRAVITY * mass * x / far, fy - GRAVITY * mass * y / far
        swing = np.hypot(fx - old_x, fy - old_y)
        speed = _speed(speed, float((mass * swing).sum()), float((mass * np.hypot(fx + old_x, fy + old_y)).sum() / 2), r)
        step = speed / (1 + np.sqrt(speed * swing))
        x, y, old_x, old_y = x + step * fx, y + step * fy, fx, fy
    return x, y


def _neighbours(src: np.ndarray, dst: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in order, cut at the first of each vertex."""
    order = np.lexsort((dst, src))
    return np.searchsorted(src[order], np.arange(lo, hi + 1)), dst[order].astype(np.int32)


def in_memory(x: np.ndarray, y: np.ndarray, mass: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions after all rounds; a and b: the ends of the distinct undirected edges."""
    starts, dst = _neighbours(np.concatenate([a, b]), np.concatenate([b, a]), 0, len(x))
    return _rounds(x, y, mass, rounds, lambda *state: _forces(0, starts, dst, *state))


def _in_one_task(flat: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    kind = dict(start.dtypes)["name"]
    none = F.lit(None)
    rows = start.select("name", none.cast(kind).alias("dst"), "mass", "x", "y").union(flat.select("src", "dst", none.cast("double"), none.cast("double"), none.cast("double")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if not sum(map(len, held)):
            return
        whole = pd.concat(held, ignore_index=True)
        v, e = whole[whole["mass"].notna()].sort_values("name"), whole[whole["mass"].isna()]
        place = pd.Series(np.arange(len(v)), index=v["name"].to_numpy())
        order = np.lexsort((e["dst"].to_numpy(), e["name"].to_numpy()))  # sums in one order whatever the partitions
        a, b = (place.loc[e[c].to_numpy()[order]].to_numpy() for c in ("name", "dst"))
        x, y = in_memory(*(v[c].to_numpy(float) for c in ("x", "y", "mass")), a, b, rounds)
        yield pd.DataFrame({"name": v["name"].to_numpy(), "x": x, "y": y})

    return cut(rows.coalesce(1).mapInPandas(run, f"name {kind}, x double, y double"))


def _over_slices(edges: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """The same positions, with the edges (repeats don't matter) in slices of ids and the vertices' places in the driver and sent to each round."""
    context, kind = edges.sparkSession.sparkContext, dict(start.dtypes)["name"]
    whole = kind in ("bigint", "int", "smallint", "tinyint")  # such names are few bytes, so that each task looks ids up itself
    if whole:
        got, of, ends = start.select("name", "mass", "x", "y").toArrow(), start.select("name", F.col("name").cast("long").alias("id")), edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
        order = pc.sort_indices(got["name"], null_placement="at_start").to_numpy()
        names = got["name"].take(order).drop_null().to_numpy().astype(np.int64)
    else:
        ids = cut(ranked(start, ["name"]).select("name", "mass", "x", "y", F.col("rank").alias("id")))
        of = ids.select("name", "id")
        ends = edges.join(of.select(F.col("name").alias("src"), F.col("id").alias("a")), "src").join(of.select(F.col("name").alias("dst"), F.col("id").alias("b")), "dst").select("a", "b")
        got = ids.select("id", "mass", "x", "y").toArrow()
        order, names = np.argsort(got["id"].to_numpy()), None
    mass, x, y = (got[c].to_numpy()[order] for c in ("mass", "x", "y"))
    n = len(order)
    wide = max(1, n * SLICE // max(1, 2 * edges.count() + n))
    known = context.broadcast(names)

    def id_of(column: pd.Series) -> np.ndarray:
        """A null, the first of all, has no edges."""
        if known.value is None:
            return column.to_numpy(np.int64)
        return np.where(column.isna(), 0, np.searchsorted(known.value, column.fillna(0).to_numpy(np.int64)) + n - len(known.value))

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chunks(held: list) -> pd.DataFrame:
            a, b = (np.concatenate(x).astype(np.int32) for x in zip(*held, strict=True))
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            at = src // wide
            order = np.argsort(at, kind="stable")
            src, dst, at = src[order], dst[order], at[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            return pd.DataFrame({"slice": at[first].astype(np.int64), "src": [x.tobytes() for x in np.split(src, first[1:])], "dst": [x.tobytes() for x in np.split(dst, first[1:])]})

        held, rows = [], 0
        for part in parts:
            if len(part):
                held.append((id_of(part["a"]), id_of(part["b"])))
                rows += len(part)
            if rows >= SLICE:
                yield chunks(held)
                held, rows = [], 0
        if held:
            yield chunks(held)

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        lo = int(rows["slice"].iloc[0]) * wide
        src, dst = (np.frombuffer(b"".join(rows[c]), np.int32).astype(np.int64) for c in ("src", "dst"))
        key = np.unique((src - lo) * n + dst)
        starts = np.searchsorted(key, np.arange(min(n, lo + wide) - lo + 1) * n)
        return pd.DataFrame({"lo": [lo], "starts": [starts.astype(np.int64).tobytes()], "dst": [(key % n).astype(np.int32).tobytes()]})

    none = F.lit(b"")
    every = edges.sparkSession.range(-(-n // wide)).select(F.col("id").alias("slice"), none.alias("src"), none.alias("dst"))
    both = ends.mapInPandas(dealt, "slice long, src binary, dst binary").union(every)
    slices = cut(both.groupBy("slice").applyInPandas(packed, "lo long, starts binary, dst binary")).coalesce(2 * context.defaultParallelism)  # few tasks a round
    masses = context.broadcast(mass)

    def forces(x, y, _, cell, *state) -> tuple[np.ndarray, np.ndarray]:
        held = context.broadcast((x, y, cell.astype(np.min_scalar_type(GRID * GRID)), *state))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                x, y, cell, *state = held.value
                for lo, starts, dst in zip(part["lo"], part["starts"], part["dst"], strict=True):
                    found = _forces(lo, np.frombuffer(starts, np.int64), np.frombuffer(dst, np.int32), x, y, masses.value, cell, *state)
                    yield pd.DataFrame({"lo": [lo], "fx": [found[0].tobytes()], "fy": [found[1].tobytes()]})

        got = slices.mapInPandas(run, "lo long, fx binary, fy binary").toArrow().sort_by("lo")
        held.destroy()
        return tuple(np.concatenate([np.frombuffer(b, float) for b in got[c].to_pylist()]) for c in ("fx", "fy"))

    held = context.broadcast(_rounds(x, y, mass, rounds, forces))

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = id_of(part["id"])
            yield pd.DataFrame({"name": part["name"], "x": held.value[0][at], "y": held.value[1][at]})

    return cut(of.mapInPandas(put, f"name {kind}, x double, y double"))


def _distributed(flat: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    both = cut(flat.union(flat.select(F.col("dst"), F.col("src"))))
    zero = F.lit(0.0)
    now, speed = cut(start.withColumns({"old_x": zero, "old_y": zero})), 0.0
    for r in range(rounds):
        low = now.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
        if low["x0"] is None:
            break
        (x0, sx), (y0, sy) = _box(low["x0"], low["x1"]), _box(low["y0"], low["y1"])

        def at(c: str, lo: float, size: float) -> Column:
            return F.least(F.floor((F.col(c) - lo) / size), F.lit(GRID - 1)).cast("int")

        cell = at("x", x0, sx) * GRID + at("y", y0, sy)
        cells = now.groupBy(cell.alias("c")).agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("x")).alias("mx"), F.sum(F.col("mass") * F.col("y")).alias("my")).collect()  # GRID * GRID rows at most
        centres = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.asDict().items()]) for row in cells])

        def pushed(centre: Column) -> Column:
            own = F.when(centre["c"] == F.col("cell"), F.col("mass")).otherwise(zero)
            left = centre["m"] - own
            dx, dy = F.col("x") - (centre["mx"] - own * F.col("x")) / left, F.col("y") - (centre["my"] - own * F.col("y")) / left
            push = REPULSION * F.col("mass") * left / F.greatest(dx * dx + dy * dy, F.lit((sx * sx + sy * sy) / 8))
            return F.when(left > 0, F.struct((push * dx).alias("x"), (push * dy).alias("y"))).otherwise(F.struct(zero.alias("x"), zero.alias("y")))

        pushes = F.aggregate(centres, F.struct(zero.alias("x"), zero.alias("y")), lambda acc, c: F.struct((acc["x"] + pushed(c)["x"]).alias("x"), (acc["y"] + pushed(c)["y"]).alias("y")))
        pull = both.join(now.select(F.col("name").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy")), "dst").groupBy(F.col("src").alias("name")).agg(F.sum("ox").alias("ax"), F.sum("oy").alias("ay"), F.count("*").alias("k"))
        far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) + 1e-9

        def force(c: str, a: str) -> Column:
            return F.coalesce(F.col(a) - F.col("k") * F.col(c), zero) + F.col("push")[c] - GRAVITY * F.col("mass") * F.col(c) / far

        forced = now.withColumn("cell", cell).withColumn("push", pushes).join(pull, "name", "left").select("name", "mass", "x", "y", "old_x", "old_y", force("x", "ax").alias("fx"), force("y", "ay").alias("fy"))
        forced = cut(forced.withColumn("swing", F.hypot(F.col("fx") - F.col("old_x"), F.col("fy") - F.col("old_y"))))
        sums = forced.agg(F.sum(F.col("mass") * F.col("swing")).alias("s"), (F.sum(F.col("mass") * F.hypot(F.col("fx") + F.col("old_x"), F.col("fy") + F.col("old_y"))) / 2).alias("t")).first()
        speed = _speed(speed, sums["s"], sums["t"], r)
        step = speed / (1 + F.sqrt(speed * F.col("swing")))
        now = forced.select("name", "mass", (F.col("x") + step * F.col("fx")).alias("x"), (F.col("y") + step * F.col("fy")).alias("y"), F.col("fx").alias("old_x"), F.col("fy").alias("old_y"))
    return cut(now.select("name", "x", "y"))


def layout(edges: DataFrame, rounds: int = 500, seed: int = 1, in_memory: int = IN_MEMORY, in_driver: int = IN_DRIVER) -> DataFrame:
    """(name, x, y) of every endpoint of the edges. Loops, repeats and directions don't matter for the pull; the mass counts them."""
    edges = cut(edges.select("src", "dst"))
    apart = edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    masses = cut(edges.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg((F.count("*") + 1).cast("double").alias("mass")))
    n = masses.count()
    side = math.sqrt(max(1, n))

    def start(k: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("name")), F.lit(1_000_003)) / 1_000_003 - 0.5) * side

    placed = masses.withColumns({"x": start(1), "y": start(2)})
    if in_memory < n <= in_driver:
        found = _over_slices(apart, placed, rounds)  # no need to know the distinct edges first
    else:
        flat = cut(apart.distinct())
        found = (_in_one_task if n + flat.count() <= in_memory else _over_slices if n <= in_driver else _distributed)(flat, placed, rounds)
    now = found.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).first()
    scale = side / math.sqrt(6 * (now["vx"] + now["vy"])) if now["vx"] or now["vy"] else 1.0
    return found.select("name", ((F.col("x") - (now["x"] or 0.0)) * scale).alias("x"), ((F.col("y") - (now["y"] or 0.0)) * scale).alias("y"))
