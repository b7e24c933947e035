"""The license scan against plain counting in all blocks, and long templates at any place."""

import random
import re

import pytest
from refweave.llm import license_scan as L


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(text, templates):
    w, out = _words(text), {}
    for label, notice in templates:
        t, half = set(_words(notice)), 32
        while half < len(_words(notice)):
            half *= 2
        for s in range(0, max(1, len(w) - half), half):
            share = len(t & set(w[s : s + 2 * half])) / len(t)
            if share >= 0.8 - 1e-9:
                out[label] = max(out.get(label, 0), share)
    return out


def _best(matches):
    out = {}
    for m in matches:
        out[m["label"]] = max(out.get(m["label"], 0), m["containment"])
    return out


def test_templates_of_any_length_are_found_whole_at_any_place(spark):
    rng = random.Random(17)
    templates = [(f"t{n}", " ".join(f"v{n}x{k if k < 0.7 * n else rng.randrange(n)}" for k in range(n))) for n in (3, 33, 60, 64, 100, 500)]
    rows = []
    for k, (_, notice) in enumerate(templates):
        for at in (0, 1, 31, 32, 63, 200, 777):
            rows.append((len(rows), k, " ".join(["filler"] * at) + " " + notice.upper() + " tail" * rng.randrange(100)))
    docs = spark.createDataFrame(rows, "doc_id long, k long, text string")
    for r in L.scan_licenses(docs, templates=templates).collect():
        assert _best(r["license"]["matches"]).get(templates[r["k"]][0]) == 1.0, r["doc_id"]


def test_matches_equal_counting(spark):
    rng = random.Random(18)
    pool = [f"p{k}" for k in range(60)]
    templates = [(f"t{k}", " ".join(rng.choice(pool) for _ in range(rng.choice([2, 5, 20, 50, 90])))) for k in range(12)]
    rows = []
    for k in range(60):
        own = _words(rng.choice(templates)[1])
        kept = [x if rng.random() < 0.85 else "changed" for x in own]
        rows.append((k, " ".join([rng.choice(pool) for _ in range(rng.choice([0, 10, 150]))] + kept + [rng.choice(["x", *pool]) for _ in range(rng.choice([0, 40]))])))
    rows += [(100, None), (101, ""), (102, "...")]
    for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect():
        got, want = _best(r["license"]["matches"]), _brute(r["text"], templates)
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in got)


def test_templates_that_cannot_match_are_errors(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for templates in ([], [("a", "...")]):
        with pytest.raises(ValueError):
            L.scan_licenses(docs, templates=templates)


def test_order_counts_words_in_any_case(spark):
    docs = spark.createDataFrame([(1, "miT License"), (2, "MIT x"), (3, None), (4, "mit mit")], "doc_id long, text string")
    assert L.document_frequencies(docs, ["license", "mit", "none"]) == {"license": 1, "mit": 3, "none": 0}
