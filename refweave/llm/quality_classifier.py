"""A quality classifier: random Fourier features, ridge regression and isotonic calibration.

``statistics`` measures a text by ``STATISTICS`` numbers. Standardised, they go through ``N_FOURIER`` random Fourier features
sqrt(2/D) cos(Wx + b), with W normal and b uniform from a fixed seed, whose inner products
approximate the Gaussian kernel of the given width. Ridge regression on them needs only
Z'Z and Z'y, which every task sums over all its labelled rows; the partial sums, a row of the matrix
each, are summed again by row number, so the driver gets one matrix whatever the number of rows
and tasks. Isotonic regression then maps the ridge score to a probability: training rows are
counted by label in ``BINS`` equal bins of the score, and pooling adjacent violators over the
bins gives a rising step function, read off by interpolation.

All labelled training rows count in every sum. The statistics of all rows, a few
numbers each, are checkpointed once, and so are those of the training rows with their labels; texts are read once and never shuffled.

Cases: a null or empty text has all statistics 0 and is scored as such; labels that are null or lack
their document are no evidence; without both classes every score is the share of label 1
(0.5 without labels); several labels of a document count each; repeated rows and ids give a row each; rows of equal scores are in one bin;
very long texts are whole (a text is in memory at a time); an empty table gives an empty result; other columns are ignored, and kept by ``with_statistics``, but one named ``statistics`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.common import bounded, bucket_of, cut, table

N_FOURIER = 256
WIDTH = 3.0
RIDGE = 1e-3
BINS = 2048
SEED = 7
STATISTICS = (
    "log_words", "log_chars", "word_length", "distinct_share", "top_word_share", "upper_share", "digit_share", "symbol_share",
    "mark_share", "end_share", "exclaim_share", "line_words", "repeated_lines", "repeated_pairs", "title_share", "other_letters",
)

_UPPER, _DIGIT, _SYMBOL, _MARK = (re.compile(x) for x in ("[A-Z]+", "[0-9]+", "[#*$%&|<>]+", "[.,;:?\"'()-]+"))


def _count(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def statistics(text: str | None) -> list[float]:
    """``STATISTICS`` of a text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    pairs = Counter(zip(words, words[1:]))
    ascii_chars = len(text.encode("ascii", "ignore"))
    return [
        np.log1p(n),
        np.log1p(chars),
        chars / n,
        len(counts) / n**0.9,
        max(counts.values()) / n,
        _count(_UPPER, text) / chars,
        _count(_DIGIT, text) / chars,
        _count(_SYMBOL, text) / chars,
        _count(_MARK, text) / chars,
        sum(w[-1] in ".!?" for w in words) / n,
        text.count("!") / n,
        np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(pairs) / max(1, n - 1),
        sum(w[0].isupper() for w in words) / n,
        1 - ascii_chars / len(text),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array column ``statistics``."""

    @F.pandas_udf("array<double>")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(statistics)

    return bounded(docs).withColumn("statistics", measure(F.col(text)))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the Fourier features and the constant
    steps_x: np.ndarray
    steps_y: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """A row for each row of x, with a last column of ones."""
        rng = np.random.default_rng(SEED)
        d = len(STATISTICS)
        w, b = rng.standard_normal((d, N_FOURIER)) / WIDTH, rng.uniform(0, 2 * np.pi, N_FOURIER)
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ w + b
        return np.hstack([np.sqrt(2 / N_FOURIER) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps_x, self.steps_y)


def pool_adjacent_violators(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising sequence that is closest to y in weighted squares."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(y, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, u, k = blocks.pop()
            n, t, j = blocks[-1]
            blocks[-1] = [(n * t + m * u) / (t + u), t + u, j + k]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in series]) if len(series) else np.zeros((0, len(STATISTICS)))


def _normal_equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows of ``train``."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((N_FOURIER + 1, N_FOURIER + 2))
        for part in parts:
            z = model.fourier(_matrix(part["statistics"]))
            total += z.T @ np.column_stack([z, part["y"].to_numpy(dtype=float)])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": part["i"].iloc[:1], "v": [np.sum(list(part["v"]), axis=0)]})

    sums = train.select("statistics", "y").mapInPandas(partial, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>")
    rows = np.array([r["v"] for r in sums.orderBy("i").collect()])  # N_FOURIER + 1 rows
    return rows[:, :-1], rows[:, -1]


def fit(train: DataFrame) -> Model:
    """A model of ``train`` (statistics, y)."""
    d = len(STATISTICS)
    moments = train.agg(
        F.count("*").alias("n"),
        F.sum("y").alias("y"),
        *[f(F.get("statistics", F.lit(k))).alias(f"{f.__name__}_{k}") for k in range(d) for f in (F.avg, F.stddev_pop)],
    ).first()
    n, good = moments["n"], moments["y"] or 0
    if not n or good in (0, n):
        share = good / n if n else 0.5
        return Model(np.zeros(d), np.ones(d), np.zeros(N_FOURIER + 1), np.zeros(1), np.full(1, share))
    mean = np.array([moments[f"avg_{k}"] for k in range(d)])
    spread = np.array([moments[f"stddev_pop_{k}"] for k in range(d)]) + 1e-6
    model = Model(mean, spread, np.zeros(N_FOURIER + 1), np.zeros(1), np.zeros(1))
    zz, zy = _normal_equations(train, model)
    penalty = np.full(N_FOURIER + 1, RIDGE * n / N_FOURIER)
    penalty[-1] = 0
    model.weights = np.linalg.solve(zz + np.diag(penalty) + 1e-9 * np.eye(len(zz)), zy)

    @F.pandas_udf("int")
    def binned(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            at = np.clip((model.raw(_matrix(part)) + 0.5) / 2 * BINS, 0, BINS - 1)
            yield pd.Series(at.astype(np.int32))

    found = train.select(binned("statistics").alias("bin"), "y").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    weight = np.array([r["n"] for r in found], dtype=float)
    model.steps_x = (np.array([r["bin"] for r in found]) + 0.5) / BINS * 2 - 0.5
    model.steps_y = pool_adjacent_violators(np.array([r["y"] for r in found]) / weight, weight)
    return model


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = cut(with_statistics(docs).select("doc_id", "statistics"))
    labels = table(spark, sf_dir, "labels").filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("labelled"), (F.col("quality") > 0).cast("int").alias("y"))
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    model = fit(cut(measured.filter(~held_out).join(labels, F.col("doc_id") == F.col("labelled")).select("statistics", "y")))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score(_matrix(part)))

    scored = measured.select("doc_id", held_out.alias("held_out"), score("statistics").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
