"""Quality rules with risk-controlled thresholds.

Every text gets the counts of ``text_counts`` and from them a few badness ratios
(``RULES``). For each stratum (a band of text lengths, so there are always the same few)
and rule, the candidates are fixed cutoffs; a document fails the rule if its ratio is
above the cutoff. Labelled documents of quality 1 are the holdout: with n of them in the
stratum and k above the cutoff, the exact (Clopper-Pearson) upper bound of the false
rejection rate is at most ``risk`` just if P(Binomial(n, risk) <= k) <= delta. A cutoff
counts as safe if that holds with delta divided by the number of all strata, rules and
cutoffs (Bonferroni), and with risk divided by the number of rules, so all rules together
wrongly reject at most ``risk`` of good documents in each stratum, with probability
1 - delta for all strata at once. The smallest safe cutoff of each rule is
used; with too few labels none is safe and the rule rejects nothing.

The bound takes the holdout for independent draws, so a text counts once, however many rows and labels have it. Near copies are different texts and count each;
where the holdout has many of them, drop them from it first.

Everything is DataFrame functions. Counting stays within the row: trigrams are
hashed, sorted with their positions and compared with their neighbours in arrays, so texts are read once and
never shuffled; the counts, a few numbers for each row, are checkpointed for both of their uses. The
holdout joins these small rows; the table of cutoffs has at most a row for each stratum and is broadcast.

Cases: null and empty texts have no words and counts of 0, and fail the base rule; labels
of null quality or without a document are no evidence; equal texts are evidence once if any label of one is good; repeated rows and ids give a result row each; a ratio equal
to a cutoff passes; very long texts count whole; an empty table gives an empty
result; other columns are ignored by the query and kept by ``with_counts``, but one named ``counts`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.common import SPACE_WORD, cut, let, table, words

#: Lengths in words at which the strata begin.
STRATA = (0, 200, 1000)
#: Candidate cutoffs of every rule, in rising order.
CUTOFFS = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
RISK = 0.05
DELTA = 0.05

COUNTS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint,n_upper:bigint,n_distinct:bigint>"


def _repeat_words(w: Column) -> Column:
    """How many words lie in a window of three that the array of words holds twice or more."""

    def over(hashes: Column) -> Column:
        n = F.size(hashes)
        grams = F.zip_with(
            F.zip_with(hashes, F.slice(hashes, F.lit(2), n), lambda a, b: F.xxhash64(a, b)),
            F.slice(hashes, F.lit(3), n),
            lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab, c)),
        )
        return let(F.slice(grams, F.lit(1), n - 2), repeats)

    def repeats(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(placed, covered))

    def covered(placed: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.slice(placed, F.lit(1), F.size(placed) - 1))
        after = F.slice(placed, F.lit(2), F.size(placed))
        twice = F.zip_with(
            F.zip_with(placed, before, lambda x, y: F.struct(x["g"].alias("g"), x["i"].alias("i"), (x["g"] == y["g"]).alias("same"))),
            after,
            lambda x, y: F.when(F.coalesce(x["same"], F.lit(False)) | F.coalesce(x["g"] == y["g"], F.lit(False)), x["i"]),
        )
        starts = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
        return let(
            starts,
            lambda s: F.aggregate(
                s,
                F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
                lambda acc: acc["n"],
            ),
        )

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), over))


def text_counts(text: Column) -> Column:
    """Struct ``COUNTS`` of a text: words, code points in words, symbols, repeated lines, words in repeated trigrams, lines with a word, upper-case ASCII letters, distinct words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, F.lit("\n")), lambda line: line.rlike(SPACE_WORD))
    counted = let(
        words(text),
        lambda w: let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda n, v: n + F.length(v)).alias("word_chars"),
                (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(x).cast("long").alias("n_lines"),
                (F.length(text) - F.length(F.regexp_replace(text, r"[A-Z]+", ""))).cast("long").alias("n_upper"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            ),
        ),
    )
    return counted


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(*[c for c in docs.columns if c != "counts"], text_counts(F.col(text)).alias("counts"))


def rules(c: str = "counts") -> dict[str, Column]:
    """Badness ratios from 0 to 1, by name."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.least(a / b, F.lit(1.0))).otherwise(F.lit(0.0))

    return {
        "symbols": ratio(F.col(f"{c}.n_symbols"), F.col(f"{c}.word_chars")),
        "dup_lines": ratio(F.col(f"{c}.n_dup_lines"), F.col(f"{c}.n_lines")),
        "repeats": ratio(F.col(f"{c}.n_repeat_words"), F.col(f"{c}.n_words")),
        "upper": ratio(F.col(f"{c}.n_upper"), F.col(f"{c}.word_chars")),
        "sameness": F.when(F.col(f"{c}.n_words") > 0, 1 - F.col(f"{c}.n_distinct") / F.col(f"{c}.n_words")).otherwise(F.lit(0.0)),
    }


RULES = ("symbols", "dup_lines", "repeats", "upper", "sameness")


def stratum(n: Column) -> Column:
    """Number of the last stratum that begins at or below n."""
    out = F.lit(0)
    for k, least in enumerate(STRATA):
        out = F.when(n >= least, F.lit(k)).otherwise(out)
    return out


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed in logarithms from 0 up; 1 where k is at or above the mean, which no risk bound below the observed rate could pass."""
    log_q, log_odds = F.log(F.lit(1 - p)), F.log(F.lit(p / (1 - p)))
    summed = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(k, F.lit(0).cast("long"))),
        F.struct((n * log_q).alias("term"), F.lit(float("-inf")).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] + F.when(i < n, F.log(F.greatest(n - i, F.lit(1)) / (i + 1)) + log_odds).otherwise(F.lit(0.0))).alias("term"),
            F.when(acc["total"] == float("-inf"), acc["term"])
            .otherwise(F.greatest(acc["total"], acc["term"]) + F.log1p(F.exp(-F.abs(acc["total"] - acc["term"]))))
            .alias("total"),
        ),
        lambda acc: F.exp(acc["total"]),
    )
    return F.when(n <= 0, F.lit(1.0)).when(k >= n * p, F.lit(1.0)).otherwise(summed)


def safe_cutoffs(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each stratum with a good document: its safe cutoff of each rule, or null. ``holdout``: stratum and a column for each rule, one row for each good labelled text."""
    counts = [F.count_if(F.col(r) > c).alias(f"{r}_{k}") for r in RULES for k, c in enumerate(CUTOFFS)]
    found = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    level = delta / (len(STRATA) * len(RULES) * len(CUTOFFS))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), F.col(f"{r}_{k}").alias("k")) for r in RULES for k, c in enumerate(CUTOFFS)])
    tried = found.select("stratum", "n", F.explode(each).alias("x"))
    safe = tried.filter(binomial_tail(F.col("n"), F.col("x.k"), risk / len(RULES)) <= level)
    return safe.groupBy("stratum").agg(*[F.min(F.when(F.col("x.rule") == r, F.col("x.cut"))).alias(f"{r}_cut") for r in RULES])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("labelled"))
    measured = cut(with_counts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "counts")).select("doc_id", "text_hash", "counts", stratum(F.col("counts.n_words")).alias("stratum"), *[v.alias(r) for r, v in rules().items()])
    holdout = measured.join(good, F.col("doc_id") == F.col("labelled")).select("text_hash", "stratum", *RULES).dropDuplicates(["text_hash"])
    cutoffs = safe_cutoffs(holdout).withColumnRenamed("stratum", "of")  # a row for each stratum: a fixed few
    judged = measured.join(F.broadcast(cutoffs), F.col("stratum") == F.col("of"), "left")
    failed = F.lit(False)
    for r in RULES:
        failed = failed | F.coalesce(F.col(r) > F.col(f"{r}_cut"), F.lit(False))
    base = (F.col("counts.n_words") < 50) | (100 * F.col("counts.n_repeat_words") > 50 * F.col("counts.n_words"))
    return judged.select(
        "doc_id",
        *[F.col(f"counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        (~base & ~failed).alias("kept"),
    )


def _oracle() -> str:
    ratio = "CASE WHEN {b} > 0 THEN least({a} / {b}::DOUBLE, 1.0) ELSE 0.0 END"
    ratios = {
        "symbols": ratio.format(a="n_symbols", b="word_chars"),
        "dup_lines": ratio.format(a="n_dup_lines", b="n_lines"),
        "repeats": ratio.format(a="n_repeat_words", b="n_words"),
        "upper": ratio.format(a="n_upper", b="word_chars"),
        "sameness": "CASE WHEN n_words > 0 THEN 1 - n_distinct / n_words::DOUBLE ELSE 0.0 END",
    }
    bands = "CASE " + " ".join(f"WHEN n_words >= {s} THEN {k}" for k, s in reversed(list(enumerate(STRATA)))) + " END"
    p, level = RISK / len(RULES), DELTA / (len(STRATA) * len(RULES) * len(CUTOFFS))
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"
    long = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS v FROM held" for r in RULES)
    cuts = ", ".join(f"({c})" for c in CUTOFFS)
    pick = ", ".join(f"max(cut) FILTER (WHERE rule = '{r}') AS {r}_cut" for r in RULES)
    fails = " OR ".join(f"coalesce({r} > {r}_cut, false)" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT r, unnest(range(0, len(w) - 2)) AS i, w FROM d WHERE len(w) > 3),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i + 1], w[i + 2], w[i + 3]) AS n FROM win),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep CROSS JOIN (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY r),
c AS (SELECT d.r, doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, len(list_distinct(w)) AS n_distinct
  FROM d LEFT JOIN cov ON d.r = cov.r),
m AS (SELECT *, {bands} AS stratum, {", ".join(f"{v} AS {r}" for r, v in ratios.items())} FROM c),
held AS (SELECT DISTINCT t, stratum, {", ".join(RULES)} FROM m JOIN labels ON m.doc_id = labels.doc_id WHERE labels.quality = 1),
long AS ({long}),
cnt AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER (WHERE v > cut) AS k FROM long CROSS JOIN (VALUES {cuts}) AS g(cut) GROUP BY ALL),
safe AS (SELECT stratum, rule, min(cut) AS cut FROM cnt WHERE k < n * {p} AND {tail} <= {level} GROUP BY ALL),
pick AS (SELECT stratum, {pick} FROM safe GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({fails}) AS kept
FROM m LEFT JOIN pick USING (stratum)"""


ORACLE = _oracle()
