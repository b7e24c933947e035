"""The n-gram Jaccard join against all pairs, and its cases."""

import random
import re

import numpy as np

from refweave.llm import ngram_join as join


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def _corpus(seed=7):
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for size in (12, 40, 90, 200):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[pick.randrange(size)] = word()
            texts.append(" ".join(copy))
    # Texts that mostly consist of one passage, above and below the bound.
    texts += [" ".join(passage + [word() for _ in range(k)]) for k in range(0, 40, 2)]
    texts += ["", None, "  \n", "one two", "ONE  two", "one two three", "a b c d e", "a b c d e", "a b c d e f"]
    return [(k * 3 % 101, t) for k, t in enumerate(texts)]


def test_components_equal_all_pairs(spark):
    rows = _corpus()
    found = join.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == _brute(rows)


def test_bitmaps_never_exceed_unshared_tokens():
    draw = np.random.default_rng(3)
    for _ in range(200):
        pool = np.unique(draw.integers(0, 2**63, draw.integers(2, 900), dtype=np.uint64))
        a, b = pool[draw.random(len(pool)) < 0.8], pool[draw.random(len(pool)) < 0.8]
        differ = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(join.bitmap(a), join.bitmap(b), strict=True))
        assert differ <= len(np.setxor1d(a, b))


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    same = "the quick brown fox jumps over the lazy dog again"
    rows = [(5, same, 1, 1), (5, same, 2, 2), (9, same, 3, 3), (None, same, 4, 4), (None, None, 5, 5), (3, None, 6, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, b0 int")
    found = sorted(map(str, (tuple(r) for r in join.components(docs).select("doc_id", "component_id").collect())))
    assert found == sorted(map(str, [(5, 5), (5, 5), (9, 5), (None, 5), (None, None), (3, 3)]))
    kept = join.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 5]


def test_columns_named_like_inner_ones_stay(spark):
    same = "the quick brown fox jumps over the lazy dog again"
    docs = spark.createDataFrame([(5, same, 1, 2), (6, same, 3, 4)], "doc_id long, text string, gone int, _gone int")
    kept = join.one_per_component(docs)
    assert [tuple(r) for r in kept.collect()] == [(5, same, 1, 2)] and kept.columns == docs.columns


def test_one_id_joins_its_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(7, a), (7, b), (8, a), (4, b)], "doc_id long, text string")
    assert {r["component_id"] for r in join.components(docs).collect()} == {4}


def test_empty_table(spark):
    assert join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
