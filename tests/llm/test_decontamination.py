"""The containment search against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F
from refweave.llm import decontamination as D


def _shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            a, b = _shingles(text), _shingles(item)
            if b and len(a & b) >= 0.8 * len(b) - 1e-9:
                key = (d, i, len(b))
                out[key] = max(out.get(key, 0), len(a & b))
    return sorted((str(d), str(i), n, k) for (d, i, n), k in out.items())


def _corpus():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((5, 6, 9, 15, 16, 24, 31, 32, 60, 200))] + [(50, "two words"), (51, None), (None, "one more item of seven words here"), (3, items_text := "an item that stands twice under one id"), (3, items_text)]
    docs = []
    for k, (_, item) in enumerate(items):
        own = (item or "").split()
        for edits in (0, 1, 2, 4, 9):
            copy = list(own)
            for _ in range(edits if copy else 0):
                copy[rng.randrange(len(copy))] = word()
            around = [word() for _ in range(rng.choice([0, 3, 80, 3000]))]
            at = rng.randrange(len(around) + 1)
            docs.append((10 * k + edits, " ".join(around[:at] + copy + around[at:]).upper()))
    docs += [(900, None), (901, ""), (902, " ".join(x or "" for _, x in items)), (902, items[3][1]), (None, items[4][1]), (903, "Two, words!")]
    return docs, items


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_pairs_equal_all_pairs(spark, rows):
    docs, items = _corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = D.contained_items(d, i, broadcast_rows=rows).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["item_shingles"], r["shared"]) for r in found) == _brute(docs, items)
    assert all(r["containment"] == round(r["shared"] / r["item_shingles"], 6) for r in found)


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_documents_without_items_stay(spark, rows):
    docs, items = _corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(k) for k, c in enumerate(("which", "_which", "item_id", "likely", "bad", "bits", "slot", "bucket_of", "hash", "row"))})
    i = spark.createDataFrame(items, "item_id long, text string")
    kept = D.decontaminate(d, i, broadcast_rows=rows)
    assert kept.columns == d.columns
    bad = [k for k, (_, text) in enumerate(docs) if _brute([(0, text)], items)]
    assert sorted(map(str, (tuple(r) for r in kept.select("doc_id", "text").collect()))) == sorted(str(x) for k, x in enumerate(docs) if k not in bad)
