"""The n-gram trie against plain counting."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from refweave.llm import lm_scoring


def _brute(tokens):
    """p(gram) of the smoothed model of the token lists, and the counts by length."""
    n = [Counter(tuple(t[i : i + k]) for t in tokens for i in range(len(t) - k + 1)) for k in (1, 2, 3)]
    after = {}
    for k in (1, 2):
        for g, c in n[k].items():
            after.setdefault(g[:-1], []).append(c)

    def p(gram):
        if len(gram) == 1:
            return (n[0][gram] + 0.5) / (sum(n[0].values()) + 0.5 * (len(n[0]) + 1))
        k, context = len(gram) - 1, gram[:-1]
        if not n[k - 1][context]:
            return p(gram[1:])
        left = 1 - sum(c - lm_scoring.DISCOUNT for c in after.get(context, [])) / n[k - 1][context]
        return max(0, n[k][gram] - lm_scoring.DISCOUNT) / n[k - 1][context] + left * p(gram[1:])

    return p, n


def _entries(trie):
    return [sum(len(level.shard(s)["log_p"]) for s in range(len(level.files))) for level in trie.levels[1:]]


def test_every_ngram_of_the_training_texts_is_scored_at_its_own_order(spark):
    texts = ["a b c d a b", "b c a", "a b c d e", "e", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trie, numbered = lm_scoring.build_trie(docs, F.lit(True))
    tokens = [[*t.split(), " "] for t in texts]
    p, n = _brute(tokens)
    assert _entries(trie) == [len(n[1]), len(n[2])]
    rows = numbered.orderBy("id").collect()
    for row, t in zip(rows, tokens, strict=True):
        ids = np.frombuffer(row["ids"], np.uint32).astype(np.int64)
        got = lm_scoring.token_log_p(trie, ids, np.zeros(1, np.int64))
        want = np.log10([p(tuple(t[max(0, i - 2) : i + 1])) for i in range(len(t))])
        assert np.abs(got - want).max() < 2 * lm_scoring.STEP


@pytest.mark.parametrize("shard", [40, 400, 10**6])
def test_shards_by_mass_with_contexts_that_are_cut(spark, monkeypatch, shard):
    monkeypatch.setattr(lm_scoring, "BATCH_TOKENS", 100)
    rng = random.Random(9)
    # "the" is every second word: alone it has more tokens than a small shard.
    texts = [" ".join(x for _ in range(rng.randint(1, 40)) for x in ("the", f"w{int(60 * rng.random() ** 2)}")) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    trie, numbered = lm_scoring.build_trie(docs, F.col("doc_id") % 3 != 1, shard=shard)
    tokens = [[*t.split(), " "] for t in texts]
    p, n = _brute([t for k, t in enumerate(tokens) if k % 3 != 1])
    assert _entries(trie) == [len(n[1]), len(n[2])]
    if shard < 10**6:
        assert len(trie.levels[1].files) > 2
        assert len(set(trie.levels[1].contexts.tolist())) < len(trie.levels[1].files) or shard > 40
    for row in numbered.collect():
        t = tokens[int(row["id"])]
        ids = np.frombuffer(row["ids"], np.uint32).astype(np.int64)
        got = lm_scoring.token_log_p(trie, ids, np.zeros(1, np.int64))
        want = np.log10([p(tuple(t[max(0, i - 2) : i + 1])) for i in range(len(t))])
        assert np.abs(got - want).max() < 3 * lm_scoring.STEP


def test_probabilities_after_a_context_sum_to_one():
    tokens = [["a", "b", "a", "c", " "], ["b", "a", "b", "b", " "]]
    p, n = _brute(tokens)
    words = [w for w, in n[0]]
    unknown = p(("?",))
    for context in [("a",), ("b",), ("b", "a"), ("a", "b")]:
        left = 1.0
        total = sum(p((*context, w)) for w in words)
        for k in range(len(context)):  # the unknown word has what all orders leave to it
            own = context[k:]
            seen = [c for g, c in n[len(own)].items() if g[:-1] == own]
            left *= 1 - sum(c - lm_scoring.DISCOUNT for c in seen) / n[len(own) - 1][own]
        assert total + left * unknown == pytest.approx(1)


def test_query_columns_against_counting(spark, tmp_path):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["Ab", "ab", "ß", "x y", "Q", f"u{rng.randrange(90)}"]) + rng.choice(["", "\n", "\t\v"]) for _ in range(rng.randrange(30))) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), " "] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))]
    counts = Counter(w for t, h in zip(words, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in lm_scoring.op6_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(words):
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(w in counts for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] < 0


def test_packed_runs_keep_large_counts():
    keys = np.array([5, 9, 2**63], np.uint64)
    for counts in ([1, 2, 3], [1, 2**32, 2**40], [2**32 - 1, 1, 1]):
        back = lm_scoring._unblob(*lm_scoring._packed(keys, np.array(counts), 4), 4)
        assert (back[0] == keys).all() and back[1].tolist() == counts
