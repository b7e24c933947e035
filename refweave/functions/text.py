"""Scalar functions of the bibliographic model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_LIST = "array<string>"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def list_if_null(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(EMPTY_LIST))


def nan_to_blank(c: Column) -> Column:
    """The whole cell "nan" (in this case only) becomes the empty text, as null does."""
    return F.when(c == "nan", F.lit("")).otherwise(blank_if_null(c))


def split_list(c: Column) -> Column:
    """Parts between "; "; the empty text gives one empty part."""
    return F.split(c, F.lit("; "))


def without_ids(c: Column) -> Column:
    """Without parenthesised ids after names."""
    return F.regexp_replace(c, r" \([^\n]*?\)", "")


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^\n]*?>", "")


def extract_or_null(c: Column, pattern: str) -> Column:
    """Group 1 of the first match; null without one."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def doi_of(c: Column) -> Column:
    return extract_or_null(c, r"(?U)doi:(\S+)")


def omid_of(c: Column) -> Column:
    return extract_or_null(c, r"(?U)omid:(\S+)")


def whole_number(c: Column) -> Column:
    """A text such as "2015" or "2015.0" as a long; anything else is null."""
    value = c.try_cast("double")
    return F.when(value == F.floor(value), value.try_cast("long"))


def year_of(c: Column) -> Column:
    return whole_number(F.substring(c.cast("string"), 1, 4))


def full_names(people: Column, literal: bool = False) -> Column:
    """"first last" of each (firstname, lastname); people without either are left out. ``literal`` keeps the blank beside a missing part."""
    joined = F.transform(people, lambda p: F.concat(blank_if_null(p["firstname"]), F.lit(" "), blank_if_null(p["lastname"])))
    kept = F.filter(joined, lambda s: F.trim(s) != "")
    return kept if literal else F.transform(kept, lambda s: F.trim(s))


def short_name(first: Column, last: Column) -> Column:
    """"Last F"."""
    return F.trim(F.concat_ws(" ", last, F.substring(first, 1, 1)))


def inverted_name(first: Column, last: Column) -> Column:
    """"Last, First", without commas and blanks at the end."""
    return F.regexp_replace(F.concat(blank_if_null(last), F.lit(", "), blank_if_null(first)), r"[, ]+$", "")


def last_token(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def wrapped(c: Column, width: int = 80, indent: int = 6) -> Column:
    """Words in lines of at most ``width`` characters, the later ones indented; longer words stand alone. Empty and null give the empty text."""
    later = "\n" + " " * indent
    words = F.filter(F.split(blank_if_null(c), r"\s+"), lambda w: w != "")
    return F.aggregate(
        words,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("used")),
        lambda acc, w: F.when(acc["text"] == "", F.struct(w.alias("text"), F.length(w).alias("used")))
        .when(acc["used"] + 1 + F.length(w) <= width, F.struct(F.concat(acc["text"], F.lit(" "), w).alias("text"), (acc["used"] + 1 + F.length(w)).alias("used")))
        .otherwise(F.struct(F.concat(acc["text"], F.lit(later), w).alias("text"), (F.length(w) + indent).alias("used"))),
        lambda acc: acc["text"],
    )


def url_for(template: str, key: Column) -> Column:
    """The template's address of a key, which takes the place of "{doi}"."""
    before, _, after = template.partition("{doi}")
    return F.concat(F.lit(before), key, F.lit(after))


def zipped_rows(names: Column, ids: Column) -> Column:
    """Generator of (0, 1) pairs of two lists of one length; an empty pair gives a row of nulls."""
    return F.inline_outer(F.arrays_zip(names, ids))


def xml_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
