"""Looking up a value for each key where a few keys have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.lineage import fresh

#: Keys with more than a HUBSth of all rows (as a power of two, so that plans of near sizes share their generated code) are hubs, so there are fewer than 2 * HUBS of them.
HUBS = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row for each key and in ``count`` how many rows (at least) have it, of ``total``.

    Rows of hubs get theirs from a broadcast table of less than ``2 * HUBS`` rows and stay where they are; the others, none of whose
    keys has more than a HUBSth of the rows, are joined by a shuffle. So no task gets all rows of a hub.
    """
    of = fresh(rows, f"of_{key}")
    others = [c for c in table.columns if c not in (key, count)]
    named = table.select(F.col(key).alias(of), count, *others)
    hub = F.col(count) > 1 << max(0, (total // HUBS).bit_length() - 1)
    heavy, light = F.broadcast(named.filter(hub).select(of, *others)), named.filter(~hub).select(of, *others)
    same = F.col(key) == F.col(of)
    hot = rows.join(heavy, same).drop(of)
    cold = rows.join(heavy.select(of), same, "left_anti").join(light, same, how).drop(of)
    return hot.union(cold.select(*hot.columns))
