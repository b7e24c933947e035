"""The mix against the contract, worked out by filling sources one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F
from refweave.llm import mixing as M


def _targets(sizes):
    """Targets by repeated sharing: sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def _docs(spark, n=3000, sources=7):
    rng = random.Random(19)
    names = [None, "zz", "a", "B", "é", "hot", "tiny"][:sources]
    rows = [(k, " ".join("w" for _ in range(rng.randrange(60))) if k % 50 else None, "tiny" if k < 3 else rng.choice([*names, "hot", "hot"])) for k in range(n)]
    rows += [(None, "null id a", "a"), (None, "null id a", "a"), (7, rows[7][1], rows[7][2])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("broadcast_sources", [M.BROADCAST_SOURCES, 0])
def test_plan_equals_filling_source_by_source(spark, broadcast_sources):
    rows, docs = _docs(spark)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = _targets(sizes)
    got = M.plan_mix(docs, broadcast_sources=broadcast_sources).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        m = r["mix"]
        assert m["size"] == size(r["text"]) and m["source_size"] == sizes[r["source"]] and m["target"] == pytest.approx(want[r["source"]])
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate) <= m["copies"] <= int(rate) + 1 and m["copies"] <= 2 and m["taken"] == m["copies"] * m["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + m["taken"]
    for s, n in sizes.items():
        assert taken[s] == pytest.approx(want[s], rel=0.15) or n < 300
    same = M.plan_mix(docs.repartition(5), broadcast_sources=broadcast_sources)
    assert sorted(map(str, same.collect())) == sorted(map(str, got))


def test_targets_of_many_sources_equal_the_one_pass(spark):
    rng = random.Random(20)
    sizes = spark.createDataFrame([(f"s{k}" if k else None, int(10 ** (5 * rng.random())) if k % 9 else 0) for k in range(200)], "source string, source_size long")
    one, many = (sorted(map(tuple, f(sizes).collect()), key=str) for f in (M.source_targets, M.many_source_targets))
    assert [x[:2] for x in one] == [x[:2] for x in many] and [x[2] for x in one] == pytest.approx([x[2] for x in many])
    want = _targets({s: n for s, n, _ in one})
    assert all(t == pytest.approx(want[s]) for s, _, t in one)


def test_emitted_copies_and_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "a b c", "s", 9, 8) for k in range(40)], "doc_id long, text string, source string, mix int, copy int")
    plan = M.plan_mix(docs)
    out = M.emit_mix(plan)
    assert out.columns == ["doc_id", "text", "source", "copy"]
    counts = {r["doc_id"]: r["copies"] for r in plan.select("doc_id", "mix.copies").collect()}
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in counts.items() if n}
    assert M.plan_mix(docs.limit(0), broadcast_sources=0).count() == 0
