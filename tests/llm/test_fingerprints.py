"""Sketch differences against plain set differences, and edited texts against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from quire.llm.fingerprints import compare_with_edits, differing

from .helpers import HARD, hard, key


def test_differences_are_whole_at_every_size(spark):
    rng = random.Random(5)
    rows = []
    for n, d in [(0, 0), (0, 3), (1, 1), (5, 2), (40, 1), (40, 8), (200, 150), (2000, 3), (1500, 1500)]:
        common = [rng.getrandbits(64) - 2**63 for _ in range(n)]
        rows.append((common + [rng.getrandbits(64) - 2**63 for _ in range(d)], common[::-1] + [rng.getrandbits(64) - 2**63 for _ in range(d // 2)]))
    rows.append(([x << 20 for x in range(300)], [x << 20 for x in range(200, 500)]))  # digests that all fall in one class
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", differing("a", "b").alias("d"))
    for r in df.collect():
        assert sorted(x.d for x in r.d if x.n == 1) == sorted(set(r.a) - set(r.b))
        assert sorted(x.d for x in r.d if x.n == -1) == sorted(set(r.b) - set(r.a))


def test_edited_texts(spark):
    rows = [r for r in HARD if r[0] != 9 or "second" in r[1]]  # ties are ordered by a hash; tested below
    places = sorted({(i is not None, i or 0, t or "") for i, t in rows}, reverse=True)
    after = {p: places[(k + 1) % len(places)][2] for k, p in enumerate(places)}
    got = compare_with_edits(hard(spark, rows + rows[:1])).collect()
    assert len(got) == len(rows) + 1
    want = []
    for i, t in rows + rows[:1]:
        text = t or ""
        take = len(text) // 3
        edited = text[: len(text) - take] + after[(i is not None, i or 0, text)][:take]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault(r.doc_id, r)
    assert by[0].fingerprint == by[3].fingerprint != by[5].fingerprint
    assert by[1].fingerprint == by[2].fingerprint


def test_ties_keep_all_rows(spark):
    got = compare_with_edits(hard(spark, [(7, "a"), (7, "b"), (7, "b"), (7, None)])).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 1, 1]
    assert compare_with_edits(hard(spark, [])).count() == 0
    alone = compare_with_edits(hard(spark, [(1, "One line.\nTwo.")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_copies_are_alike_and_others_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = compare_with_edits(docs).where("n_chars > 400").agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.4 > 0.2 > got[1]
