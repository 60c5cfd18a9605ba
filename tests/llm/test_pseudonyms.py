"""Pseudonyms keep format and validity, link equal values, turn back with the key, and leave all else alone."""

import datetime
import re

import pytest

from quire.llm.pseudonyms import ANY, pseudonymise_documents

from .helpers import HARD, hard

VALUES = [
    "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (980) 555-6268", "(212) 555-0187", "212-555-0187", "192.168.0.1", "255.255.255.255", "0.0.0.0",
    "078-05-1120", "2024-02-29", "1999/12/31", "2199-12-31", "1800-01-01", "thhe.58@mail5.example.com", "Z@b.org", "o'9%x@host-1.co.uk",
]
KEY = "a test key"
LEFT = ["4111111111111112", "999.168.0.1", "2023-02-29", "2024-13-01", "1799-12-31", "123456", "version 1.2.3", "x4111111111111111", "no digits here", "555-6268"]


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def run(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pseudonymise_documents(spark.createDataFrame(rows, "doc_id long, text string"), **{"key": KEY} | more).collect()}
    return [(got[i].text, got[i].n_values) for i in range(len(texts))]


def test_formats_validity_links_and_return(spark):
    texts = [f"before {v}, after {v}" for v in VALUES]
    got = run(spark, texts)
    for value, text, (new, n) in zip(VALUES, texts, got, strict=True):
        assert n in (0, 2), value
        match = re.fullmatch(r"before (.+), after (.+)", new)
        assert match and match[1] == match[2]
        shape = lambda s: re.sub(r"[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
        if re.fullmatch(r"[\d.]+", value) and value.count(".") == 3:
            assert all(0 <= int(x) <= 255 for x in match[1].split("."))
        else:
            assert shape(match[1]) == shape(value), value
        if re.fullmatch(r"\d{4}[-/]\d\d[-/]\d\d", value):
            datetime.date.fromisoformat(match[1].replace("/", "-"))
        digits = re.sub(r"\D", "", value)
        if len(digits) == 16:
            assert luhn(re.sub(r"\D", "", match[1]))
    assert sum(n == 2 for _, n in got) >= len(VALUES) - 1
    assert re.sub(r"\D", "", got[0][0].split(",")[0]) == re.sub(r"\D", "", got[1][0].split(",")[0])  # one number in two formats
    assert [t for t, _ in run(spark, [t for t, _ in got], back=True)] == texts
    assert [t for t, _ in run(spark, texts, key="other")] != [t for t, _ in got]


def test_all_else_stays(spark):
    texts = [f"say {x} here" for x in LEFT]
    assert run(spark, texts) == [(t, 0) for t in texts]


def test_permutation_is_one_to_one(spark):
    texts = [f"10.0.{i // 256}.{i % 256}" for i in range(1500)] + [f"{1900 + i // 12}-{i % 12 + 1:02d}-17" for i in range(1200)]
    got = [t for t, _ in run(spark, texts)]
    assert len(set(got)) == len(texts)


def test_edges(spark):
    got = pseudonymise_documents(hard(spark), KEY).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((i or 0, t or "") for i, t in HARD)
    assert all(r.n_values == 0 and r.kept is None and r.hash == "h" for r in got)
    assert pseudonymise_documents(hard(spark, []), KEY).count() == 0
    long = ("1.2.3.4 " + "a" * 5000 + "@ ") * 50
    new, n = run(spark, [long])[0]
    assert n == 50 and len(new.split(" ")) == len(long.split(" "))
    clash = pseudonymise_documents(hard(spark).withColumnRenamed("kept", "n_values"), KEY)
    assert clash.columns.count("n_values") == 1 and all(r.n_values == 0 for r in clash.collect())


def test_nothing_valid_is_left_in_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = 0
    for r in pseudonymise_documents(docs, KEY).collect():
        cards = [m[0] for m in re.finditer(r"(?<![0-9A-Za-z])\d{16}(?![0-9A-Za-z])", old[r.doc_id]) if luhn(m[0])]
        mails = re.findall(r"[\w.]+@mail\d\.example\.com", old[r.doc_id])
        kept += sum(x in r.text for x in cards + mails)
        assert len(r.text) == len(old[r.doc_id]) or re.search(ANY.split("|")[0], old[r.doc_id]) or re.search(r"\d+\.\d+\.\d+\.\d+", old[r.doc_id])
    assert kept == 0


def test_card_before_other_digits(spark):
    tails = ["12/25", "123", "12", "1 2", "12-3", "9 99"]
    rows = [(i, f"{card} {tail}") for i, (card, tail) in enumerate((c, t) for c in ("4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "4222222222222") for t in tails)]
    rows += [(100 + k, f"card 4111111111111111 {k:03d} end") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    new = pseudonymise_documents(docs, KEY)
    got = {r.doc_id: r for r in new.collect()}
    for i, old in rows:
        new_text, digits = got[i].text, [c for c in old if c.isdigit()]
        assert got[i].n_values == 1 and new_text != old and len(new_text) == len(old) and len(digits) >= 13
        assert "4111111111111111" not in new_text and (i < 100 or new_text[21:] == old[21:] or luhn("".join(digits)))
    assert [r.text for r in pseudonymise_documents(new.drop("n_values"), KEY, back=True).orderBy("doc_id").collect()] == [t for _, t in rows]


def test_the_permutation_by_plain_feistel_rounds(spark):
    """Octets and social security numbers, computed apart from the operator."""
    from hashlib import sha256

    key = sha256(KEY.encode()).hexdigest()
    noise = lambda *parts: int(sha256(":".join([key, *map(str, parts)]).encode()).hexdigest()[:14], 16)

    def octets(text):
        a, b, c, d = map(int, text.split("."))
        left, right = a * 256 + b, c * 256 + d
        for r in range(1, 9):
            if r % 2:
                left = (left + noise("ip", r, right)) % 65536
            else:
                right = (right + noise("ip", r, left)) % 65536
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"

    def digits(text):
        t = text.replace("-", "")
        for r in range(1, 9):
            others = "".join(c for k, c in enumerate(t, 1) if k % 2 != r % 2)
            t = "".join(c if k % 2 != r % 2 else str((int(c) + noise("ssn", r, k, others)) % 10) for k, c in enumerate(t, 1))
        return f"{t[:3]}-{t[3:5]}-{t[5:]}"

    values = ["10.0.0.1", "255.255.255.255", "192.168.17.4"], ["123-45-6789", "001-01-0001"]
    want = [*map(octets, values[0]), *map(digits, values[1])]
    assert [t for t, _ in run(spark, values[0] + values[1])] == want
