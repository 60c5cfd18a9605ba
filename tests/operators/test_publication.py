"""Versions that are published whole or not at all, redactions that leave nothing behind, and tables by buckets."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quire.operators import search as Q
from quire.sources.sinks import commit, merge_buckets, read_committed

LINES = "doc_id long, ln int, page int, line_no int, line string"


def lines(spark):
    return spark.createDataFrame([(1, 0, 0, 0, "İİİ my secret code"), (1, 1, 0, 1, "nothing here"), (2, 0, 0, 0, "😀İ Secret İSECRETİ x")], LINES)


def everything_under(spark, path):
    out = []
    for top, _, names in os.walk(path):
        for n in names:
            p = os.path.join(top, n)
            out += [str(r) for r in spark.read.parquet(p).collect()] if n.endswith(".parquet") else [open(p, "rb").read().decode("latin-1")]
    return "\n".join(out).lower()


def test_one_of_several_writers_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    commit(spark.range(3), path)

    def write(k):
        try:
            return commit(spark.range(k), path)
        except FileExistsError:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [v for v in pool.map(write, range(10, 16)) if v]
    numbers = sorted(int(x) for x in os.listdir(f"{path}/published") if x.isdigit())
    assert numbers == list(range(len(won) + 1)) and read_committed(spark, path).count() in range(10, 16)


def test_a_writer_that_began_before_a_publication_fails(spark, tmp_path):
    from quire.sources import sinks

    path = str(tmp_path / "t")
    commit(spark.range(3), path)
    last = sinks._published(spark, path)
    commit(spark.range(4), path)
    with pytest.raises(FileExistsError):
        sinks._publish(spark, path, last, {"version": "late"})
    assert read_committed(spark, path).count() == 4


def test_redaction_under_letters_that_lower_case_to_two(spark):
    hits = Q.search(lines(spark), "secret")
    out = {(r.doc_id, r.ln): r.line for r in Q.apply_redactions(lines(spark), hits, fill="#").collect()}
    assert out == {(1, 0): "İİİ my # code", (1, 1): "nothing here", (2, 0): "😀İ # İ#İ x"}
    assert {r.line for r in Q.apply_redactions(lines(spark), Q.search_terms(lines(spark), F.lit("i̇ secret")), fill="#").collect()} >= {"😀# İSECRETİ x"}
    left = Q.leak_check(Q.apply_redactions(lines(spark), hits), spark.createDataFrame([("secret",), ("İ",)], "term string")).collect()
    assert {r.term: r.leaks for r in left} == {"secret": 0, "İ": 6}
    case = Q.search(lines(spark), "Secret", case=True).collect()
    assert [(r.doc_id, r.c0, r.c1) for r in case] == [(2, 3, 9)]


def test_nothing_of_a_redacted_word_stays_on_disk(spark, tmp_path):
    path = str(tmp_path / "t")
    commit(lines(spark), path)
    commit(lines(spark).withColumn("line", F.upper("line")), path)
    lines(spark).write.parquet(f"{path}/versions/left-by-a-failed-writer")
    assert "secret" in everything_under(spark, path)
    log = spark.createDataFrame([], "doc long, ts timestamp, event_id long, op string")
    now = read_committed(spark, path)
    out, _ = Q.commit_redactions(now, Q.search(now, "secret"), log, path)
    assert out.count() == 3 and "secret" not in everything_under(spark, path)
    assert len(os.listdir(f"{path}/versions")) == 1


def test_a_batch_of_one_key_writes_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    fold = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
    assert len(merge_buckets(spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("v")), path, "k", fold, 8)) == 8
    one = spark.createDataFrame([(7, 1000)], "k long, v long")
    touched = merge_buckets(one, path, "k", fold, 8)
    assert len(touched) == 1
    got = {r.k: r.v for r in read_committed(spark, path).collect()}
    assert got == {i: i for i in range(100)} | {7: 1000}
    assert merge_buckets(one.limit(0), path, "k", fold, 8) == []
    merge_buckets(one.withColumn("v", F.lit(2000).cast("long")), path, "k", fold, 8)
    folders = [f for v in os.listdir(f"{path}/versions") for f in os.listdir(f"{path}/versions/{v}") if f.startswith("_bucket=")]
    assert len(folders) == 9  # eight that are read, and the one before of the bucket that was written


def test_snippets_of_far_words_and_many_hits(spark):
    line = " ".join(f"w{i}" for i in range(400)) + " " + "x" * 900 + " hit " + "y" * 900 + " " + "z " * 30 + "hit a"
    rows = Q.snippets(Q.search(spark.createDataFrame([(1, 0, 0, 0, line)], LINES), "hit")).collect()
    words = line.split(" ")
    for r, at in zip(sorted(rows, key=lambda r: r.c0), [i for i, w in enumerate(words) if w == "hit"], strict=True):
        after = words[at + 1 : at + 5]
        assert r.snippet == "… " + " ".join(words[at - 4 : at + 1] + after) + (" …" if len(words) > at + 5 else "")


def test_terms_in_very_long_tokens_and_phrases(spark):
    """Against plain counting; a token of a million characters, terms of 1 to 80 characters, a phrase with an empty head, and a blank in front of a term."""
    import time

    blob = ("ab" * 40 + "é" + "qx") * 12_000
    texts = ["the end of the line of the", f"x {blob} of the", "a  b", "ofthe of", "Ab aB"]
    rows = spark.createDataFrame([(i, 0, 0, 0, t) for i, t in enumerate(texts)], LINES)
    terms = ["ab", "q", "éqxab", "of the", "ab" * 40, " of", "zz", "AB"]
    began = time.time()
    got = {r.term: r.leaks for r in Q.leak_check(rows, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {t: sum(x.lower().count(t.lower()) for x in texts) for t in terms} and time.time() - began < 120
    small = spark.createDataFrame([(i, 0, 0, 0, t) for i, t in enumerate(["the often of the", "of the of thee", "off of"])], LINES)
    found = sorted((r.doc_id, r.word_no, r.term) for r in Q.search_dictionary(small, spark.createDataFrame([("of the",), ("of",)], "term string")).collect())
    assert found == [(0, 1, "of"), (0, 2, "of"), (0, 2, "of the"), (1, 0, "of"), (1, 0, "of the"), (1, 2, "of"), (1, 2, "of the"), (2, 0, "of"), (2, 1, "of")]
