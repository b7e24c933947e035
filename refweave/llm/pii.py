"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of every kind in one pass over the text:
at-signs, plus signs, digits, schemes and identifier cues. From each anchor a local
parser expands to the span's borders and validates it. The parsers are deterministic and
never look at a character twice for the same kind, so a text costs time linear in its length.

Kinds, in their order: email, ip, card and phone (the base, with the leftmost
non-overlapping spans of their grammar; spans that fail validation are dropped without a
retry), then the method's own: url (scheme and rest), account (a cue such as "iban" or
"account number" and the identifier after it) and handle (an @name that is no email).
An account ends where its check holds: behind "iban" at the longest group whose check digits are right, behind "ssn" at the
nine digits of a number that can be issued. Where none holds, as with mistyped or other numbers, it ends with the last word that has a digit.
Spans are code points, with an exclusive end.

Cases: a null or empty text has no spans; repeated rows and ids give a row each; an empty
table gives an empty result; overlapping spans of different kinds are all listed; very long texts are whole; other columns stay, but one named ``pii`` is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.common import bounded, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "handle")

#: Characters of the grammars, and cues.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account number", "account no", "acct", "passport", "ssn", "tax id")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"[ ().0-9-]+")
_REST = re.compile(r"[^\s<>\"']+")
_IDENTIFIER = re.compile(r"[ :#.]{0,4}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})")
_LAST_DIGIT = re.compile(r".*[0-9][A-Za-z0-9]*")
_ISSUED = re.compile(r"(?!000|666|9)[0-9]{3}[ -]?(?!00)[0-9]{2}[ -]?(?!0000)[0-9]{4}(?![A-Za-z0-9])")
_NAME = re.compile(r"[A-Za-z0-9_]{2,30}")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for digit in DIGITS:
        out.add_word(digit, ("digit", 1))
    for kind, cues in (("at", ("@",)), ("plus", ("+",)), ("scheme", SCHEMES)):
        for cue in cues:
            out.add_word(cue, (kind, len(cue)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            out.add_word(form, ("cue", len(form)))
    out.make_automaton()
    return out


def _iban_end(text: str, start: int, end: int) -> int | None:
    """The end of the longest run of whole groups from ``start`` whose check digits are right (ISO 13616)."""
    for stop in range(end, start + 14, -1):
        if stop < end and text[stop].isalnum():
            continue  # within a group
        plain = text[start:stop].replace(" ", "").replace("-", "").upper()
        if 15 <= len(plain) <= 34 and plain[:2].isalpha() and plain[2:4].isdigit() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return stop
    return None


def _account_end(text: str, cue: str, start: int, end: int) -> int:
    if cue == "iban" and (stop := _iban_end(text, start, end)):
        return stop
    if cue == "ssn" and (issued := _ISSUED.match(text, start, end)):
        return issued.end()
    return _LAST_DIGIT.match(text, start, end).end()


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around the at-sign, beginning at or behind ``after``."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if start < at and domain else None


def _addresses(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """The valid addresses in the run of dotted numbers that begins at ``start``, four numbers each from the left, and the run's end."""
    run = _DOTTED.match(text, start)
    parts, at, found = run[0].split("."), start, []
    places = []
    for part in parts:
        places.append((at, at + len(part)))
        at += len(part) + 1
    for k in range(0, len(parts) - 3, 4):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
            found.append((places[k][0], places[k + 3][1]))
    return found, run.end()


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    """The span from the plus sign on, whether valid or not."""
    if text[plus + 1 : plus + 2] not in DIGITS or plus + 1 >= len(text):
        return None
    run = _DIALLED.match(text, plus + 2)
    if not run:
        return None
    last = max(run[0].rfind(d) for d in DIGITS)
    return (plus, plus + 3 + last) if last >= 1 else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end), by kind as in ``KINDS``, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    text = text or ""
    email_end = dotted_end = grouped_end = phone_end = url_end = 0
    for last, (what, n) in _anchors().iter(text):
        at = last - n + 1
        if what == "digit":
            if at >= dotted_end:
                more, dotted_end = _addresses(text, at)
                found["ip"] += more
            if at >= grouped_end:
                run = _GROUPED.match(text, at)
                grouped_end = run.end()
                digits = run[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found["card"].append(run.span())
        elif what == "at":
            span = _email(text, at, email_end)
            if span:
                found["email"].append(span)
                email_end = span[1]
            elif (at == 0 or text[at - 1] not in LOCAL) and at >= email_end and (name := _NAME.match(text, at + 1)):
                found["handle"].append((at, name.end()))
        elif what == "plus":
            if at >= phone_end and (span := _phone(text, at)):
                phone_end = span[1]
                if 8 <= sum(c in DIGITS for c in text[span[0] : span[1]]) <= 15:
                    found["phone"].append(span)
        elif what == "scheme":
            if at >= url_end and (rest := _REST.match(text, last + 1)):
                url_end = rest.end()
                found["url"].append((at, url_end))
        elif not (at and text[at - 1].isalnum()):
            value = _IDENTIFIER.match(text, last + 1)
            if value and sum(c in DIGITS for c in value[1]) >= 5:
                found["account"].append((value.start(1), _account_end(text, text[at : last + 1].lower(), *value.span(1))))
    return [(kind, *span) for kind in KINDS for span in sorted(set(found[kind]))]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with ``[kind]`` in place of each span; overlapping spans are replaced together, under the kind of the first, then the longest."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in sorted(((a, b, k) for k, a, b in (find_spans(text) if spans is None else spans)), key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array column ``pii`` of (kind, start, end)."""

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)])

    return bounded(docs).select(*[c for c in docs.columns if c != "pii"], spans(F.col(text)).alias("pii"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of the text replaced; n_chars follows where there is one."""

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(redact)

    out = bounded(docs).withColumn(text, clean(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bounded(table(spark, sf_dir, "documents").select("doc_id", "text"))

    @F.pandas_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = []
            for text in part:
                spans = find_spans(text)
                base = [s for s in spans if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select("doc_id", digest("text").alias("found")).select("doc_id", "found.*")
