"""Mixing sources to target weights.

Each source's size is the number of white-space words of its texts (one aggregation, with
partial sums before the shuffle, so a source with a third of all rows costs no more than
another). ``source_targets`` shares ``share`` of all sizes among the sources by their
weights, under a cap of ``cap`` times the source's own size; what is above a cap is shared
again by weight until nothing is. That fixed point is a water level: with the sources
in the order of cap / weight, the first ones are filled to their caps and the others get
weight * level. Up to ``BROADCAST_SOURCES`` sources, running sums over their table find it in one pass and one task; more are ranked
by ranges, and the level rises by an aggregation a round until no further source is at its cap.

A document is taken floor(rate) times, plus once more if a hash of the seed and the
document, as a fraction of its range, is below the rest of rate = target / size. Reruns,
retries and other partitionings take the same copies.

The table of sources is broadcast where counting it shows at most ``BROADCAST_SOURCES``
rows; a larger one is joined by source with the documents' side salted.

Each document's last copy is drawn independently, so a source's words are its target within a sampling error of at most half the root of its sum of squared
sizes: a few hundredths with thousands of documents, up to a third with a few dozen.

Cases: a null text has size 0; null sources are one source, the last in order; sources
without words have target 0 and rate 0; null ids hash by their text; rows that are equal
in id and text are taken alike; ties don't matter; very long texts count whole; an empty table gives an empty result; other columns stay, but one named ``mix`` (by ``plan_mix``) or
``copy`` (by ``emit_mix``) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refweave.llm.common import cut, n_words, table
from refweave.operators.graph import vertex_ids

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 42
BROADCAST_SOURCES = 100_000
SALT = 16


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source; null may be one.

    The windows run over a row for each source, not for each document, and spill.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), kind)).withColumn("most", cap * F.col("source_size"))
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    # At the first source whose share of what is left stays below its cap, that share is the level.
    level = weighted.withColumn("level", left / heavy)
    level = level.withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    first = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("most") / F.col("weight"))).over(everything)
    return level.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("first").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.col("first"))).alias("target"),
    )


def many_source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The same as ``source_targets`` for any number of sources: no task holds them all."""
    known = sizes.filter(F.col("source").isNotNull())
    ranks = vertex_ids(known.select(F.col("source").alias("name"))).select(F.col("name").alias("ranked"), "id")
    last = sizes.filter(F.col("source").isNull()).withColumn("id", F.lit(known.count()).cast("long"))  # a row at most
    placed = known.join(ranks, F.col("source") == F.col("ranked")).drop("ranked").union(last.select(*known.columns, "id"))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("id") % len(weights)).cast("int"))
    weighted = cut(placed.select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("most")))
    total = share * (weighted.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level, before = 0.0, -1
    while True:
        full = F.col("most") <= F.col("weight") * level
        found = weighted.agg(F.count_if(full).alias("full"), F.sum(F.when(full, F.col("most"))).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if found["full"] == before or not found["weight"]:
            break
        level, before = (total - (found["most"] or 0.0)) / found["weight"], found["full"]
    return weighted.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target") if found["weight"] else F.col("most").alias("target"))


def fraction_of(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the hash of the seed and the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) * F.lit(2.0**-53)


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    broadcast_sources: int = BROADCAST_SOURCES,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) and a struct column ``mix``: size, source_size, target, copies, taken."""
    keep = [c for c in docs.columns if c != "mix"] if keep is None else keep
    own = docs.select(
        F.struct(*keep).alias("row"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        F.when(F.col(key).isNotNull(), F.xxhash64(F.lit(0), F.col(key))).otherwise(F.xxhash64(F.lit(1), F.col(text))).alias("id"),
    )
    sizes = docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = cut(sizes)
    few = sizes.count() <= broadcast_sources
    targets = (source_targets if few else many_source_targets)(sizes, weights, share, cap).select(F.col("source").alias("of"), "source_size", "target")
    if few:
        joined = own.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("of")), "left")
    else:
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = own.join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.pmod(F.col("id"), F.lit(SALT)) == F.col("salt")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(fraction_of(F.col("id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    mixed = joined.withColumn("copies", copies.cast("long"))
    return mixed.select(
        "row.*",
        F.struct("size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")).alias("mix"),
    )


def emit_mix(planned: DataFrame) -> DataFrame:
    """Each row as often as its plan says."""
    repeated = planned.filter(F.col("mix.copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int"))))
    return repeated.drop("mix")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = plan_mix(docs, keep=["doc_id"])
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")
