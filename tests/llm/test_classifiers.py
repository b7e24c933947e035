"""The toxicity and quality classifiers: held-out accuracy, counterfactuals, and the fitted equations."""

import random
import zlib

import numpy as np
import pytest
from refweave.llm import quality_classifier as Q
from refweave.llm import toxicity as T


def _auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    s, y = np.asarray(scores)[order], np.asarray(labels)[order]
    values, start, count = np.unique(s, return_index=True, return_counts=True)
    rank = np.repeat(start + (count + 1) / 2, count)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def _toxic_corpus(n=1500):
    """Insults are toxic; women are named more often in toxic texts, without being the reason."""
    rng = random.Random(14)
    plain = [f"thing{k}" for k in range(300)]
    bad = ["idiot", "scum", "vermin", "trash"]
    rows = []
    for k in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randrange(8, 40))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        if rng.random() < (0.7 if toxic else 0.15):
            words.insert(rng.randrange(len(words)), "women")
        elif rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), "men")
        rows.append((k, " ".join(words) + ".", int(toxic)))
    return rows


def test_counterfactuals_swap_terms_in_their_sentence():
    found = T.counterfactuals("All women rest. Other things, Men too! none")
    assert ("all women rest", "all men rest") in found and (" other things, men too", "other things, women too") in found
    assert T.counterfactuals(None) == T.counterfactuals("nothing here") == []


def test_penalty_closes_the_gap_of_identity_terms_and_keeps_accuracy(spark):
    rows = _toxic_corpus()
    train = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], "doc_id long, text string, y int")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    gap, auc, alarms = {}, {}, {}
    for weight in (0.0, 1.0):
        model = T.fit(train, weight=weight)
        gap[weight] = abs(model.logit("the women read thing7") - model.logit("the men read thing7"))
        auc[weight] = _auc([model.logit(r[1]) for r in held], [r[2] for r in held])
        alarms[weight] = np.mean([model.score(r[1]) >= T.THRESHOLD for r in held if not r[2] and "women" in r[1].split()])
    assert gap[0.0] > 0.5 and gap[1.0] < 0.3 * gap[0.0]
    assert auc[1.0] > 0.95
    assert alarms[1.0] <= alarms[0.0]


def test_toxicity_query_on_held_out_rows(spark, tmp_path):
    rows = _toxic_corpus()
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t, _ in rows] + [(9000, None, 1, 2), (9001, "", 1, 2)], "doc_id long, text string, y int, labelled int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # Labels of held-out rows are wrong here: they must not matter.
    labels = [(k, 1, y if zlib.crc32(str(k).encode()) % 4 != 2 else 1 - y) for k, _, y in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in T.op3_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 2
    held = [(k, y) for k, _, y in rows if got[k]["held_out"]]
    assert {k for k, _ in held} == {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    assert _auc([got[k]["score"] for k, _ in held], [y for _, y in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    with_columns = T.labelled_rows(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert [tuple(r)[0] for r in with_columns.collect()] == [1]


def test_many_labels_are_joined_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    few = sorted(map(tuple, T.labelled_rows(docs, labels).collect()))
    monkeypatch.setattr(T, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, T.labelled_rows(docs, labels).collect())) == few == [(1, "a", 0), (1, "a", 1), (1, "d", 0), (1, "d", 1)]


def _quality_corpus(n=1200):
    rng = random.Random(15)
    rows = []
    for k in range(n):
        good = rng.random() < 0.5
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        if good:
            text = ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
        else:
            text = " ".join(rng.choice([w, w.upper(), w + "#", words[0]]) for w in words)
        rows.append((k, text, int(good)))
    return rows


def test_normal_equations_and_calibration(spark):
    rows = _quality_corpus(600)
    x = np.array([Q.statistics(t) for _, t, _ in rows])
    y = np.array([g for _, _, g in rows], float)
    train = spark.createDataFrame([(s.tolist(), int(g)) for s, g in zip(x, y, strict=True)], "statistics array<double>, y int").repartition(7)
    model = Q.fit(train)
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.spread == pytest.approx(x.std(axis=0) + 1e-6)
    z = model.fourier(x)
    zz, zy = Q._normal_equations(train, model)
    assert np.abs(zz - z.T @ z).max() < 1e-6 and np.abs(zy - z.T @ y).max() < 1e-6
    penalty = np.full(len(zz), Q.RIDGE * len(rows) / Q.N_FOURIER)
    penalty[-1] = 0
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + np.diag(penalty) + 1e-9 * np.eye(len(zz)), z.T @ y), abs=1e-5)
    order = np.argsort(model.raw(x))
    assert (np.diff(model.score(x)[order]) >= -1e-12).all()
    # Inner products of the features are near the Gaussian kernel.
    s = np.clip((x - model.mean) / model.spread, -8, 8)[:60]
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * Q.WIDTH**2))
    assert np.abs(z[:60, :-1] @ z[:60, :-1].T - kernel).max() < 0.35


def test_pooling():
    rng = np.random.default_rng(16)
    y, w = rng.random(200), rng.integers(1, 9, 200).astype(float)
    fit = Q.pool_adjacent_violators(y, w)
    assert (np.diff(fit) >= 0).all() and (fit * w).sum() == pytest.approx((y * w).sum())
    # No rising sequence is nearer: the largest of the least means (a formula of its own).
    mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    for k in (0, 50, 120, 199):
        assert fit[k] == pytest.approx(max(min(mean(i, j) for j in range(k, 200)) for i in range(k + 1)))


def test_quality_query_on_held_out_rows(spark, tmp_path):
    rows = _quality_corpus()
    spark.createDataFrame([(k, t, "s") for k, t, _ in rows] + [(9000, None, None), (9001, "", "s")], "doc_id long, text string, statistics string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, y if zlib.crc32(str(k).encode()) % 3 != 1 else 1 - y, 0) for k, _, y in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in Q.op4_quality_classifier(spark, str(tmp_path)).collect()}
    held = [(k, y) for k, _, y in rows if got[k]["held_out"]]
    assert {k for k, _ in held} == {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    assert _auc([got[k]["score"] for k, _ in held], [y for _, y in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(rows) + 2


def test_drop_toxic_keeps_the_others(spark, tmp_path):
    import corpus_pipeline

    rows = _toxic_corpus(800)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t, _ in rows] + [(9000, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).select("doc_id").collect()}
    toxic = {k for k, _, y in rows if y}
    assert len(kept & toxic) < 0.1 * len(toxic) and len(kept - toxic) > 0.95 * (len(rows) - len(toxic)) and 9000 in kept
