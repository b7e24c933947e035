"""Cutoffs against an independent binomial, and the holdout's rules."""

import math
import random

import pytest
from pyspark.sql import functions as F
from refweave.llm import quality_rules as Q


def _tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    rows = [(n, k) for n in (1, 5, 40, 400, 3000) for k in (0, 1, 2, n // 200, n // 100)]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", Q.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for r in got:
        want = 1.0 if r["k"] >= 0.01 * r["n"] else _tail(r["n"], r["k"], 0.01)
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_cutoffs_are_the_least_that_the_bound_certifies(spark):
    rng = random.Random(12)
    rows = [(s, *(rng.random() ** (40 if s else 80) for _ in Q.RULES)) for s, n in ((0, 1500), (1, 2500), (2, 30)) for _ in range(n)]
    held = spark.createDataFrame(rows, "stratum int, " + ", ".join(f"{r} double" for r in Q.RULES))
    got = {r["stratum"]: r.asDict() for r in Q.safe_cutoffs(held).collect()}
    level = Q.DELTA / (len(Q.STRATA) * len(Q.RULES) * len(Q.CUTOFFS))
    certified = 0
    for s in (0, 1, 2):
        own = [r[1:] for r in rows if r[0] == s]
        for k, rule in enumerate(Q.RULES):
            p = Q.RISK / len(Q.RULES)
            safe = [c for c in Q.CUTOFFS if (above := sum(r[k] > c for r in own)) < p * len(own) and _tail(len(own), above, p) <= level]
            assert got.get(s, {}).get(f"{rule}_cut") == (min(safe) if safe else None)
            certified += bool(safe)
    assert certified >= 5 and 2 not in got  # thirty rows certify nothing


def test_query_rejects_by_certified_cutoffs_and_counts_equal_texts_once(spark, tmp_path):
    rng = random.Random(13)
    clean = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(1300)]
    noisy = " ".join(f"w{k} #" for k in range(60))
    shouting = " ".join(f"WORD{k}" for k in range(80))
    # A hundred copies of one noisy text with good labels are one draw, and certify nothing away.
    docs = list(enumerate(clean + [noisy] * 100 + [shouting, None]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(1400)] + [(1401, 1, 0), (5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in Q.op2_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    assert all(got[k]["kept"] for k in range(1300))
    assert not got[1300]["base_failed"] and not got[1300]["kept"] and got[1300]["n_symbols"] == 60
    assert not got[1400]["kept"] and got[1401]["base_failed"] and got[1401]["n_words"] == 0
