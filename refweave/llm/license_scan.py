"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words (lower-cased ASCII, letters and digits) are cut into overlapping blocks. Templates are sorted into classes by length (up to
``BLOCK // 2`` words, then by powers of two); a class whose templates have at most L words uses blocks of 2 L words every L words, so any run of up
to L words lies whole within one of them, at any place. A block matches a template if it holds at least
``threshold`` of the template's distinct words.

The join is the usual prefix-filter one. Words of the templates are ordered by the number
of documents that hold them, rarest first (counted over the whole table; the table of
counts is as small as the templates). A template that needs ``need`` of its ``size``
words must share one of its ``size - need + 1`` first words with the block's first
``block size - need + 1`` ones; pairs found so pass a length filter (the block has
``need`` template words at all) and a positional filter (as many can still follow), and
are then verified by the exact overlap. The template side is the fixed index, a literal in
the plan, so the document side is a single scan without any shuffle; it is meant for hundreds of templates. A template without words raises an error.

Cases: a null or empty text has no words, no labels and score 0; repeated rows and ids,
null ids and ties give one result row for each input row; an empty table gives an empty
result; further columns are ignored by the query and kept by ``scan_licenses``, but one named ``license`` is replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.common import LETTER_WORD, LOWER, UPPER, ascii_lower, let, table, words
from refweave.llm.license_texts import TEMPLATES

BLOCK = 64
THRESHOLD = 0.8

#: Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

def template_words(text: str) -> list[str]:
    """The words of a template, as those of the texts."""
    return re.findall(LETTER_WORD, text.translate(str.maketrans(UPPER, LOWER)))


def half_block(n: int) -> int:
    """The length of its class for a template of n words: half of its blocks."""
    return max(BLOCK // 2, 1 << (n - 1).bit_length())


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """For each word of the vocabulary, in how many rows it occurs."""
    found = docs.select(F.explode(F.array_intersect(words(ascii_lower(F.col(text)), LETTER_WORD), F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count()
    return dict.fromkeys(vocabulary, 0) | {row["w"]: row["count"] for row in found.collect()}  # a row for each word of the templates


def _index(templates: list[tuple[str, str]], counts: dict[str, int], threshold: float) -> tuple[list[str], list[dict]]:
    order = sorted(counts, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order)}
    entries = []
    for label, notice in templates:
        placed = template_words(notice)
        own = sorted(set(placed), key=rank.get)
        need = max(1, math.ceil(threshold * len(own) - 1e-9))
        entries.append({"label": label, "words": own, "need": need, "prefix": own[: len(own) - need + 1], "half": half_block(len(placed))})
    return order, entries


def _phrase_starts(w: Column) -> Column:
    """Array of (start, label) of all places of the phrases."""

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        at = F.filter(
            F.sequence(F.lit(0), F.size(w) - 1),
            lambda i: _all([F.get(w, i + k) == p for k, p in enumerate(parts)]),
        )
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(F.arrays_overlap(w, F.array(*[F.lit(p.split()[-1]) for p in PHRASES])), F.concat(*[places(*x) for x in PHRASES.items()])).otherwise(none)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def _matches(w: Column, order: list[str], entries: list[dict], step: int) -> Column:
    """Array of (label, containment) of all templates, of one class, that a block of the words contains."""
    ranked = F.array(*map(F.lit, order))
    sets = F.array(*[F.array(*map(F.lit, e["words"])) for e in entries])
    labels = F.array(*[F.lit(e["label"]) for e in entries])
    least = min(e["need"] for e in entries)
    postings: dict[str, list[Column]] = {}
    for k, e in enumerate(entries):
        for p, word in enumerate(e["prefix"]):
            one = F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.lit(len(e["words"])).alias("size"), F.lit(e["need"]).alias("need"))
            postings.setdefault(word, []).append(one)
    index = F.create_map(*[x for word, found in postings.items() for x in (F.lit(word), F.array(*found))])
    none = F.array().cast("array<struct<label:string,containment:double>>")

    def of_block(block: Column) -> Column:
        prefix = F.slice(block, F.lit(1), F.greatest(F.lit(0), F.size(block) - least + 1))
        found = F.flatten(
            F.transform(
                prefix,
                lambda word, q: F.filter(
                    F.coalesce(F.element_at(index, word), F.array().cast("array<struct<k:int,p:int,size:int,need:int>>")),
                    lambda c: (F.size(block) >= c["need"]) & (F.least(c["size"] - c["p"], F.size(block) - q) >= c["need"]),
                ),
            )
        )
        kept = F.array_distinct(F.transform(found, lambda c: F.struct(c["k"].alias("k"), c["size"].alias("size"), c["need"].alias("need"))))
        verified = F.transform(kept, lambda c: F.struct(c["k"].alias("k"), c["size"].alias("size"), c["need"].alias("need"), F.size(F.array_intersect(F.get(sets, c["k"]), block)).alias("both")))
        good = F.filter(verified, lambda c: c["both"] >= c["need"])
        return F.transform(good, lambda c: F.struct(F.get(labels, c["k"]).alias("label"), (c["both"] / c["size"]).alias("containment")))

    blocks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - step), F.lit(step)),
        lambda s: F.array_intersect(ranked, F.slice(w, s, F.lit(2 * step))),
    )
    first = sorted({word for e in entries for word in e["prefix"]})
    return F.when(F.arrays_overlap(w, F.array(*map(F.lit, first))), F.flatten(F.transform(blocks, of_block))).otherwise(none)


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct column ``license``: n_words, places (start, label) of the phrases, matches (label, containment) of the templates."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, notice in templates for w in template_words(notice)})
    if not templates or not all(template_words(notice) for _, notice in templates):
        raise ValueError("a template without words can't match")
    order, entries = _index(templates, document_frequencies(docs, vocabulary, text), threshold)
    classes: dict[int, list[dict]] = {}
    for e in entries:
        classes.setdefault(e["half"], []).append(e)

    def scanned(w: Column) -> Column:
        matches = [_matches(w, [x for x in order if any(x in e["words"] for e in own)], own, half) for half, own in sorted(classes.items())]
        return F.struct(F.size(w).cast("long").alias("n_words"), _phrase_starts(w).alias("places"), F.concat(*matches).alias("matches"))

    found = let(words(ascii_lower(F.col(text)), LETTER_WORD), scanned)
    return docs.select(*[c for c in docs.columns if c != "license"], found.alias("license"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = scan_licenses(docs).select("doc_id", "license.*")
    starts = F.transform("places", lambda p: p["at"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    more = F.transform("matches", lambda m: m["label"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return x.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.round(best, 6)).alias("score"),
    )


def _oracle() -> str:
    placed = [(label, template_words(notice)) for label, notice in TEMPLATES]
    templates = ", ".join(f"({k}, '{label}', string_split('{' '.join(w)}', ' '), {half_block(len(w))})" for k, (label, w) in enumerate(placed))
    vocabulary = ", ".join(f"'{x}'" for x in sorted({x for _, w in placed for x in w}))
    phrases = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM pos WHERE w[i + 1] = '{p[0]}'" + "".join(f" AND w[i + {k + 1}] = '{x}'" for k, x in enumerate(p) if k)
        for p, label in ((phrase.split(), label) for phrase, label in PHRASES.items())
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
pos AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d WHERE list_contains(w, 'license')),
base AS ({phrases}),
base_by AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM base GROUP BY r),
tpl AS (SELECT k, label, list_distinct(t) AS t, half FROM (VALUES {templates}) AS v(k, label, t, half)),
halves AS (SELECT DISTINCT half FROM tpl),
starts AS (SELECT r, w, half, unnest(range(0, greatest(len(w) - half, 1), half)) AS s FROM d, halves),
block AS (SELECT r, half, list_filter(list_distinct(w[s + 1 : s + 2 * half]), lambda x: x IN ({vocabulary})) AS b FROM starts),
hit AS (SELECT r, label, len(list_intersect(t, b)) / len(t)::DOUBLE AS c FROM block JOIN tpl USING (half)
  WHERE len(list_intersect(t, b)) >= ceil({THRESHOLD} * len(t) - 1e-9)),
hit_by AS (SELECT r, max(c) AS best, list(DISTINCT label) AS labels FROM hit GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base_by.n, 0)::BIGINT AS n_base,
  base_by.lo::BIGINT AS first_word, base_by.hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base_by.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_by.labels, []), coalesce(hit_by.labels, [])))), ','), '') AS labels,
  CASE WHEN base_by.n > 0 THEN 1.0::DOUBLE ELSE coalesce(round(hit_by.best, 6), 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base_by USING (r) LEFT JOIN hit_by USING (r)"""


ORACLE = _oracle()
