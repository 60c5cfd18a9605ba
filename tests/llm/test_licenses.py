"""License scans against a brute-force version in Python."""

import math
import re

from pyspark.sql import functions as F

from quire.llm.licenses import PHRASES, SPREAD, TEMPLATES, WORD, scan_licenses, template_matches, template_tokens

from .helpers import HARD, hard, key

LINES = [t for t, _, _ in TEMPLATES] + [
    "released under the mit license", "Released under the license.", "the MIT under released", "CC BY", "cc-by", "by cc", "mit license mit license apache license",
    "licensed under the apache apache license version", "GNU GENERAL PUBLIC LICENSE", "gnu general public licence", "ÀMIT license", "mit\nlicense", "under the the the the",
]


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(doc_id, text, threshold=0.8):
    text = lower(text or "")
    words, starts, base = re.findall(WORD, text), [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    for template, label, needed in TEMPLATES:
        t, own = set(template_tokens(template)), set(template_tokens(needed))
        for i in (i for i, w in enumerate(words) if w in t):
            held = set(words[i : i + SPREAD * len(t)])
            if own <= held and len(held & t) >= math.ceil(threshold * len(t)):
                labels.add(label)
                best = max(best, len(held & t) / len(t))
    return (doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(5000 + k, x) for k, x in enumerate(LINES)] + HARD + HARD[:2] + [(9000, "\n".join(LINES) * 50)]
    got = sorted((tuple(r) for r in scan_licenses(hard(spark, rows)).collect()), key=key)
    assert got == sorted((brute(*r) for r in rows), key=key)
    assert sum("apache-2.0" in r[6] for r in got) > 3


def test_edges(spark):
    assert scan_licenses(hard(spark, [])).count() == 0
    assert scan_licenses(hard(spark), templates=[]).count() == len(HARD)


def test_many_templates_give_what_few_give(spark, monkeypatch):
    from quire.llm import licenses

    docs = spark.createDataFrame([(k, x) for k, x in enumerate(LINES)], "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    more = TEMPLATES + [(f"word{i} other{i} third{i}", "x", "") for i in range(1500)]
    rows = lambda templates: sorted(tuple(r) for r in template_matches(docs, templates=templates).collect())
    few = rows(TEMPLATES)
    assert few == rows(more) and len(few) >= len(TEMPLATES)
    monkeypatch.setattr(licenses, "MOST_LITERALS", 0)
    monkeypatch.setattr(licenses, "MOST_BROADCAST", 0)
    assert few == rows(TEMPLATES)


def test_notices_wrapped_over_lines_of_any_width(spark):
    text = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and\nassociated documentation files"
    rows = [(0, text), (1, text.replace("\n", "\n\n# ")), (2, text.replace("person", "person " + "-" * 300)), (3, text.replace("person", "person " + "other words " * 40))]
    got = {r.doc_id: r.labels for r in scan_licenses(hard(spark, rows)).collect()}
    assert got == {0: "mit-terms", 1: "mit-terms", 2: "mit-terms", 3: ""}


def test_notices_of_other_licenses_and_scattered_words(spark):
    lines = ["Released under the BSD License.", "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-SA 4.0.", "the book was released in May; under a license for the press", "Licensed under the Apache License, Version 1.1.", "mit " + "far " * 30 + "released under the license"]
    got = [r.labels for r in scan_licenses(hard(spark, list(enumerate(lines)))).orderBy("doc_id").collect()]
    assert got == ["", "gpl,gpl-2.0", "cc-by,cc-by-sa-4.0", "", "apache", ""]
