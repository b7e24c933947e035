"""The anchor parsers against plain regular expressions, on random text of the critical characters."""

import hashlib
import random
import re

from refweave.llm.pii import BASE, _luhn, find_spans, op7_pii, redact

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
}


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k in BASE for m in PLAIN[k].finditer(text) if valid(k, m[0])]


def test_same_as_regular_expressions():
    rng = random.Random(5)
    alphabets = ["ab@.-", "0123456789. ", "0149 -", "+12 ().-", "a1@.+ -2é", "0.1.2.3.255.256"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        assert [s for s in find_spans(text) if s[0] in BASE] == plain(text), text


def test_query_columns(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab@.-0149 +()\n") for _ in range(rng.randrange(200))) for _ in range(80)]
    texts += ["mail a.b@c.org from 10.0.0.1, card 4111 1111 1111 1111, call +49 (30) 123-4567", "é a@b.c", None, "", "http://x.y/z @name iban GB29 NWBK 6016 1331 9268 19"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op7_pii(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        base = plain(text or "")
        r = rows[k]
        assert [r[f"n_{kind}"] for kind in BASE] == [sum(x[0] == kind for x in base) for kind in BASE]
        listed = ",".join(f"{a}:{b}:{c}" for a, b, c in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in BASE] == [x for x in listed.split(",") if x]
    assert {x.split(":")[0] for x in rows[len(texts) - 1]["spans"].split(",")} == {"url", "handle", "account"}


def test_valid_cards_are_found():
    rng = random.Random(6)
    for _ in range(300):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        number = next(body + d for d in "0123456789" if _luhn(body + d))
        text = f"é no {number[:4]}-{number[4:8]} {number[8:]} x"
        assert [s for s in find_spans(text) if s[0] == "card"] == plain(text) != []


def test_empty_and_null():
    assert find_spans(None) == find_spans("") == []
    assert redact(None) is None
    assert redact("mail a.b@c.org now") == "mail [email] now"


def test_accounts_end_where_their_check_holds():
    def accounts(text):
        return [text[a:b] for k, a, b in find_spans(text) if k == "account"]

    assert accounts("IBAN: DE89 3704 0044 0532 0130 00 2 pieces") == ["DE89 3704 0044 0532 0130 00"]
    assert accounts("iban GB29NWBK60161331926819 ok 7") == ["GB29NWBK60161331926819"]
    assert accounts("iban DE88 3704 0044 0532 0130 00 then") == ["DE88 3704 0044 0532 0130 00"]  # mistyped: still personal
    assert accounts("SSN 123-45-6789 12 apples") == ["123-45-6789"] and accounts("ssn 900-45-6789 x") == ["900-45-6789"]
    assert accounts("passport X1234567 now") == ["X1234567"] and accounts("iban of 12 men") == []


def test_overlapping_spans_are_redacted_whole():
    assert redact("ssn 123-45-6789 mail bob@x.com") == "ssn [account] mail [email]"
    assert redact("iban GB29 NWBK 6016 1331 9268 19 thanks") == "iban [account] thanks"
    assert redact("0123456789", [("card", 0, 5), ("phone", 3, 8), ("ip", 1, 2)]) == "[card]89"
