"""Clients of the public lookup services, as transports for ``references.fetch``; all requests go through one function, which tests replace."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping

from refweave.operators.references import Transport

#: Addresses of the services, and how many keys one of their answers takes.
OPENCITATIONS = "https://api.opencitations.net/index/v2/references/doi:{doi}"
CROSSREF = "https://api.crossref.org/works/{doi}"
PUBMED_SEARCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi"
PUBMED_FETCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"

#: (url, headers, seconds) -> (status, body).
Get = Callable[[str, Mapping[str, str], float], tuple[int, str]]


def http_get(url: str, headers: Mapping[str, str], seconds: float) -> tuple[int, str]:
    """A GET request; statuses of errors are answers, failures to connect raise."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=seconds) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode("utf-8", "replace")


def url_of(template: str, key: str) -> str:
    """The template's address of a key, with characters escaped that end or split a path."""
    return template.format(doi=urllib.parse.quote(key, safe="/:;()._-"))


def _each(template: str, headers: Mapping[str, str], get: Get, seconds: float) -> Transport:
    def ask(keys: list[str]) -> list[tuple[str, int, str | None]]:
        out = []
        for key in keys:
            try:
                out.append((key, *get(url_of(template, key), headers, seconds)))
            except OSError as error:  # one key's failure is that key's answer
                out.append((key, 0, str(error)))
        return out

    return ask


def opencitations(token: str, get: Get = http_get, seconds: float = 30.0) -> Transport:
    """References by DOI, for ``parse_pairs``; the token goes into the authorization header."""
    return _each(OPENCITATIONS, {"authorization": token}, get, seconds)


def crossref(email: str, get: Get = http_get, seconds: float = 30.0) -> Transport:
    """Works by DOI, for ``parse_works``; the address of the asker goes into the user agent."""
    return _each(CROSSREF, {"User-Agent": f"refweave (mailto:{email})"}, get, seconds)
