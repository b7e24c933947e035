"""The whole pipeline against a brute-force run of its stages."""

import random
import re

import corpus_pipeline
import pytest
from refweave.llm import toxicity
from test_ngram_join import _brute, _set
from test_pii import plain


def _corpus(seed=25):
    rng = random.Random(seed)
    word = lambda: f"word{rng.randrange(5000)}"
    item = " ".join(word() for _ in range(20))
    texts = [" ".join(word() for _ in range(rng.randrange(15, 60))) for _ in range(250)]
    texts += [f"{t} {rng.choice(['idiot', 'scum'])} {rng.choice(['idiot', 'scum'])} vermin" for t in (" ".join(word() for _ in range(30)) for _ in range(90))]  # toxic
    for k in range(0, 40, 2):  # near and exact copies
        own = texts[k].split()
        own[-1] = word()
        texts += [" ".join(own), texts[k]]
    texts += [f"{' '.join(word() for _ in range(20))} {item.upper()} end" for _ in range(8)]  # benchmark
    texts += [f"{' '.join(word() for _ in range(20))} mail me.{k}@host.org or +49 30 1234{k:03d}" for k in range(20)]
    return [(k * 7 % 1009, t, "en", rng.choice(["a", "b", None]), len(t)) for k, t in enumerate(texts)], [(1, item), (2, "")]


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = _corpus()
    assert len({r[0] for r in rows}) == len(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 1, int("vermin" in r[1])) for r in rows if r[0] % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    # Toxicity: the operator's own score, refitted; every other stage anew.
    docs = spark.createDataFrame(rows, schema)
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    kept = [r for r in rows if model.score(r[1]) < 0.3]
    assert sum("vermin" in r[1] for r in kept) < 5 and len(kept) > 300
    least = {d for d, _, c in _brute([(r[0], r[1]) for r in kept]) if d == c}
    kept = [r for r in kept if r[0] in least]
    letters = lambda t: re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", t.lower())
    wanted = _set(letters(items[0][1]))
    kept = [r for r in kept if len(_set(letters(r[1])) & wanted) < 0.8 * len(wanted)]

    def redacted(text):
        out, at = "", 0
        for kind, a, b in sorted(plain(text), key=lambda s: s[1]):
            out, at = out + text[at:a] + f"[{kind}]", b
        return out + text[at:]

    want = {r[0]: redacted(r[1]) for r in kept}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r["text"] for r in out}
    assert got.items() <= want.items() and any("[email]" in t and "[phone]" in t for t in got.values())
    size = {d: len(t.split()) for d, t in want.items()}
    by_source = {}
    for r in kept:
        by_source.setdefault(r[3], []).append(r[0])
    most = {s: 2 * sum(size[d] for d in ids) for s, ids in by_source.items()}
    taken = {s: sum(size[r["doc_id"]] for r in out if r["source"] == s) for s in by_source}
    total = 1.5 * sum(size.values())
    assert all(taken[s] <= most[s] for s in most) and sum(taken.values()) == pytest.approx(total, rel=0.15)
    assert all(r["n_chars"] == len(r["text"]) for r in out)
