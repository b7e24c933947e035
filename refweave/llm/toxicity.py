"""A counterfactually regularised toxicity classifier.

Features of a text are the presence of its words (lower-cased, without punctuation at
the ends) and of the beginnings of words of four to six characters, written ``w:`` and ``p:``.
Those that the score uses are chosen by counts over all labelled training rows: the
``N_FEATURES`` with the largest likelihood-ratio statistic G between toxic and other rows, if it is at least
2 ln(features tested) + ``EVIDENCE`` (a chance finding among so many is unlikely), and all identity terms.

The score is a logistic regression. For each training sentence that names an identity
group, counterfactual sentences swap the term for its counterparts (``IDENTITY_GROUPS``);
with f the logit, the loss adds ``COUNTERFACTUAL * (f(x) - f(x'))**2`` to the cross
entropy, so that a neutral mention of a group does not move the score. Sentences are
labelled as their document is.

Selection counts every labelled training row. The regression itself is fitted on the driver on
``FIT_ROWS`` labelled rows, give or take a few hundredths, taken by hash (a documented bound; the rows are sent as
feature numbers, not texts). Of a sentence and its counterfactual only the features in which they differ matter; each text sends its distinct
differences with their counts, of which there are no more than pairs of terms, however long it is. Scoring is one scan without a shuffle; the model that
travels with it has at most N_FEATURES weights.

Cases: a null or empty text has no features and gets the score of the intercept; labels
that are null or lack their document are no evidence, and without both classes every score is the share of toxic
labels (0 if none); several labels of a document count each; repeated rows and ids give a row each; features of equal evidence are taken in the order of their names; very long texts are whole (a text is
in memory at a time); an empty table gives an empty result; other columns stay, but one named ``toxicity`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.common import bounded, bucket_of, cut, table
from refweave.llm.mixing import fraction_of

N_FEATURES = 4096
EVIDENCE = 6.0
FIT_ROWS = 20_000
BROADCAST_LABELS = 1_000_000
RIDGE = 1e-3
COUNTERFACTUAL = 1.0
STEPS = 300
THRESHOLD = 0.3

#: Terms that name groups of people; the terms of a line are each other's counterfactuals.
IDENTITY_GROUPS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["black", "white", "asian", "latino"],
    ["immigrants", "refugees", "foreigners", "locals"],
    ["old", "young"],
    ["disabled", "blind", "deaf"],
    ["mujeres", "hombres"],
    ["femmes", "hommes"],
    ["frauen", "männer"],
    ["musulmanes", "cristianos", "judíos"],
    ["musulmans", "chrétiens", "juifs"],
    ["muslime", "christen", "juden"],
]

_EDGES = ".,;:!?\"'()[]{}<>#*$%&|-_"
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(text: str | None) -> set[str]:
    """The names of a text's features."""
    found = {x.strip(_EDGES) for x in set((text or "").lower().split())}
    found.discard("")
    return {f"w:{x}" for x in found} | {f"p:{x[:n]}" for x in found for n in (4, 5, 6) if len(x) >= n}


def counterfactuals(text: str | None) -> list[tuple[str, str]]:
    """(sentence, the same with an identity term swapped), for every sentence, term and counterpart."""
    terms = {t: [x for x in group if x != t] for group in IDENTITY_GROUPS for t in group}
    out = []
    lowered = (text or "").lower()
    if not any(t in lowered for t in terms):
        return out
    for sentence in dict.fromkeys(_SENTENCE.findall(lowered)):
        own = sentence.split()
        for t in {w.strip(_EDGES) for w in own} & terms.keys():
            for other in terms[t]:
                out.append((sentence, " ".join(other if w.strip(_EDGES) == t else w for w in own)))
    return out


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray
    intercept: float

    def logit(self, text: str | None) -> float:
        if not self.names:
            return self.intercept
        found = {x.strip(_EDGES) for x in set((text or "").lower().split())}
        total, seen = self.intercept, set()
        for x in found:
            for name in (f"w:{x}", *(f"p:{x[:n]}" for n in (4, 5, 6) if len(x) >= n)):
                k = self.names.get(name)
                if k is not None and k not in seen:
                    seen.add(k)
                    total += self.weights[k]
        return total

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the documents with a label. Up to BROADCAST_LABELS labels, two numbers each, go to the texts; more are joined by a shuffle."""
    known = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("y"))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "y")


def select_features(train: DataFrame, n_features: int = N_FEATURES) -> tuple[list[str], int, int]:
    """The chosen features, and the numbers of toxic and of other rows."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of the task's rows, so that a common feature is a row for each task; they go out whenever there are many."""
        counts: dict[str, list[int]] = {}

        def frame() -> pd.DataFrame:
            return pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["feature", "pos", "neg"])

        for part in parts:
            for text, y in zip(part["text"], part["y"], strict=True):
                counts.setdefault("", [0, 0])[1 - int(y > 0)] += 1
                for name in features(text):
                    counts.setdefault(name, [0, 0])[1 - int(y > 0)] += 1
                if len(counts) > 500_000:
                    yield frame()
                    counts.clear()
        yield frame()

    total = train.select("text", "y").mapInPandas(counted, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # The empty name counts the rows; it always ranks first.
    rows = F.max(F.when(F.col("feature") == "", F.struct("pos", "neg")))
    ranked = total.filter((F.col("feature") == "") | (F.col("pos") + F.col("neg") >= 3))
    ranked = cut(ranked)
    n = ranked.agg(rows.alias("n")).first()["n"]
    if n is None or not n["pos"] or not n["neg"]:
        return [], (n["pos"] if n else 0), (n["neg"] if n else 0)
    both = float(n["pos"] + n["neg"])

    def part(seen: Column, of_feature: Column, of_class: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen * both / (of_feature * of_class))).otherwise(F.lit(0.0))

    having = F.col("pos") + F.col("neg")
    g = 2 * (
        part(F.col("pos"), having, float(n["pos"]))
        + part(F.col("neg"), having, float(n["neg"]))
        + part(n["pos"] - F.col("pos"), both - having, float(n["pos"]))
        + part(n["neg"] - F.col("neg"), both - having, float(n["neg"]))
    )
    tested = ranked.filter(F.col("feature") != "").select("feature", g.alias("g"))
    least = 2 * np.log(max(1, tested.count())) + EVIDENCE
    best = tested.filter(F.col("g") >= float(least)).orderBy(F.desc("g"), "feature").limit(n_features).collect()
    identity = [f"w:{t}" for group in IDENTITY_GROUPS for t in group]
    return list(dict.fromkeys([*(r["feature"] for r in best), *identity])), n["pos"], n["neg"]


def _descend(rows: list[np.ndarray], y: np.ndarray, pairs: dict[tuple[tuple[int, ...], tuple[int, ...]], int], n: int, ridge: float, weight: float) -> tuple[np.ndarray, float]:
    """Logistic regression with the counterfactual penalty, by accelerated full-batch gradient steps."""

    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        return (np.concatenate(sets) if len(sets) else np.zeros(0)).astype(np.int32), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)

    cols, at = flat(rows)
    a, at_a = flat([np.array(p[0], dtype=np.int32) for p in pairs])
    b, at_b = flat([np.array(p[1], dtype=np.int32) for p in pairs])
    often = np.array(list(pairs.values()), dtype=float)
    often *= 2 * weight / max(1.0, often.sum())
    # Scaled so that a feature of many rows takes steps as a rare one does.
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(cols, minlength=n)) / max(1, len(rows)) + 1e-3)
    w, w0, v, v0 = np.zeros(n), np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)), np.zeros(n), 0.0
    rate = 0.02
    m1, m2, s1, s2 = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(at, w[cols], minlength=len(rows)) + w0
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
        g, g0 = np.bincount(cols, err[at], minlength=n) + ridge * w / 10, err.sum()
        if pairs:
            gap = (np.bincount(at_a, w[a], minlength=len(pairs)) - np.bincount(at_b, w[b], minlength=len(pairs))) * often
            g += np.bincount(a, gap[at_a], minlength=n) - np.bincount(b, gap[at_b], minlength=n)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        s1, s2 = 0.9 * s1 + 0.1 * g0, 0.999 * s2 + 0.001 * g0 * g0
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        w0 -= rate * (s1 / c1) / (np.sqrt(s2 / c2) + 1e-8)
    return w, float(w0)


def fit(train: DataFrame, n_features: int = N_FEATURES, fit_rows: int = FIT_ROWS, ridge: float = RIDGE, weight: float = COUNTERFACTUAL) -> Model:
    """A model of ``train`` (doc_id, text, y)."""
    names, pos, neg = select_features(bounded(train), n_features)
    if not names:
        share = pos / (pos + neg) if pos + neg else 0.0
        return Model({}, np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    number = {x: k for k, x in enumerate(names)}

    def differences(text: str | None) -> list[list[list[int]]]:
        seen = Counter()
        for a, b in counterfactuals(text):
            x, y = set(known(a)), set(known(b))
            seen[tuple(sorted(x - y)), tuple(sorted(y - x))] += 1
        return [[list(x), list(y), [count]] for (x, y), count in seen.items()]

    def known(text: str | None) -> list[int]:
        return sorted(number[x] for x in features(text) if x in number)

    def numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            swaps = [differences(t) for t in part["text"]]
            yield pd.DataFrame({"y": part["y"], "x": part["text"].map(known), "swaps": swaps})

    sample = train.filter(fraction_of(F.xxhash64("doc_id", "text"), 0) < min(1.0, fit_rows / (pos + neg)))
    got = sample.select("text", "y").mapInPandas(numbered, "y int, x array<int>, swaps array<array<array<int>>>").toArrow()
    rows = [x.values.to_numpy() for x in got["x"]]
    y = (got["y"].to_numpy() > 0).astype(float)
    pairs = Counter()
    for x in got["swaps"].to_pylist():
        for a, b, (count,) in x:
            pairs[tuple(a), tuple(b)] += count
    w, w0 = _descend(rows, y, pairs, len(names), ridge, weight)
    return Model(number, w, w0)


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a double column ``toxicity``."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(model.score)

    return bounded(docs).withColumn("toxicity", score(F.col(text)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = labelled_rows(docs.filter(bucket_of(F.col("doc_id"), 4) != 2), table(spark, sf_dir, "labels"))
    scored = with_scores(docs, fit(train))
    return scored.select(
        "doc_id",
        (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
