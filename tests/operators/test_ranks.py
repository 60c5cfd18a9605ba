"""Running sums by directories against one window over the group, and edits of a document that most pages are in."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import manifest as M
from quire.operators.ranks import numbered, prefix_sums


def rows(spark):
    rng = random.Random(2)
    out = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-50, 50), rng.randint(0, 1 << 40), rng.randint(-(1 << 61), 1 << 61)]), rng.randint(0, 9), i) for i in range(800)]
    return spark.createDataFrame(out, "g string, k long, w long, i long")


@pytest.mark.parametrize("levels", [0, 1, 3])
@pytest.mark.parametrize("bits", [3, 12])
def test_prefix_sums_equal_a_window(spark, levels, bits):
    df = rows(spark)
    w = Window.partitionBy("g").orderBy(F.col("k").asc_nulls_first(), "i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("b", F.coalesce(F.sum("w").over(w), F.lit(0)))
    got = prefix_sums(df, ["g"], F.col("k"), "b", F.col("w"), ties=[F.col("i")], levels=levels, bits=bits)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_numbered(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("v"))
    assert all(r.nth == r.v for r in numbered(df, [F.col("v").asc()]).collect())
    assert numbered(df.limit(0), [F.col("v").asc()]).collect() == []


def test_one_document_of_many_stretches(spark):
    """20,000 pages of one document: each edit equals the edit of a list."""
    n = 20_000
    pages = spark.range(n).select(F.lit("v").alias("vdoc"), F.lit(1).cast("long").alias("source_id"), F.col("id").alias("page"))
    m = M.seed_manifest(pages)
    sel = m.where("pos % 7 = 3").select("vdoc", "pos")
    chosen, plain = [i for i in range(n) if i % 7 == 3], list(range(n))
    shown = lambda df: [r.page for r in sorted(df.select("pos", "page").collect())]
    places = lambda df: [r.pos for r in sorted(df.select("pos").collect())]
    one = lambda **c: spark.createDataFrame([("v", *c.values())], "vdoc string, " + ", ".join(f"{k} long" for k in c))
    assert shown(M.delete_pages(m, sel)) == [i for i in plain if i % 7 != 3]
    moved = M.move_pages(m, sel, one(before=9000))
    assert shown(moved) == [i for i in plain if i % 7 != 3 and i < 9000] + chosen + [i for i in plain if i % 7 != 3 and i >= 9000] and places(moved) == plain
    twice = M.duplicate_pages(m, sel)
    assert shown(twice) == plain[: chosen[-1] + 1] + chosen + plain[chosen[-1] + 1 :] and places(twice) == list(range(n + len(chosen)))
    refs = m.where("pos % 7 = 3").select("vdoc", F.lit(5000).alias("at"), F.col("pos").alias("nth"), "source_id", "page")
    assert shown(M.insert_pages(m, refs)) == plain[:5000] + chosen + plain[5000:]
    assert shown(M.insert_pages(m, refs.withColumn("at", F.lit(None).cast("int")))) == plain + chosen
    assert shown(M.move_page(m, one(src=3, dst=15000))) == plain[:3] + plain[4:15001] + [3] + plain[15001:]
    runs = sorted(map(tuple, M.contiguous_runs(M.delete_pages(m, sel)).select("start", "first_page", "n").collect()))
    assert runs[:2] == [(0, 0, 3), (3, 4, 6)] and sum(r[2] for r in runs) == n - len(chosen)
