"""Results worth pinning, on small tables made here."""

import pytest
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import links as K
from quire.operators import manifest as M
from quire.operators import marks as A
from quire.operators import metadata as D
from quire.operators import ranges as P
from quire.operators import search as Q
from quire.sources import readers as R
from quire.sources import sinks as W

NAMES = ["Smith and Smithsonian and PUBLICINFO", "SMITH shouted at Smith", "Smith again, plus PUBLICINFO"]


def lines(spark, texts):
    return R.text_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_search_options(spark):
    t = lines(spark, ["\n".join(NAMES)])
    count = lambda **o: Q.search(t, "Smith", **o).count()
    assert (count(), count(whole=True), count(case=True), count(whole=True, case=True)) == (5, 4, 4, 3)
    p = lines(spark, ["electric heater in the hall\nan electric fan and a gas heater"])
    assert Q.search(p, "electric heater").count() == 4
    assert Q.search(p, "electric heater", whole=True).count() == 1
    assert (Q.search(p, "heat").count(), Q.search(p, "heat", whole=True).count()) == (2, 0)
    assert Q.search(p, "").count() == Q.search(p, "  ").count() == Q.search(p, "", whole=True).count() == 0
    assert Q.search(lines(spark, ["a.b a+b .*"]), ".*").count() == 1


def test_snippets(spark):
    t = lines(spark, ["one two three four five six needle eight nine"])
    assert Q.snippets(Q.search(t, "needle")).first().snippet == "… three four five six needle eight nine"


def test_repaired_levels(spark):
    cases = [([1, 2, 1], [1, 2, 1]), ([2, 3], [1, 2]), ([1, 3], [1, 2]), ([2, 1], [1, 1])]
    rows = [(d, i, v, "t", 0) for d, (levels, _) in enumerate(cases) for i, v in enumerate(levels)]
    got = K.repair_levels(spark.createDataFrame(rows, "doc_id long, seq long, level int, title string, page int")).orderBy("doc_id", "seq").collect()
    assert [r.level for r in got] == [v for _, want in cases for v in want]


def test_page_ranges(spark):
    specs = {"3-": [2, 3, 4], "-2": [0, 1], "4-2": [1, 2, 3], "99": [4], "": [0, 1, 2, 3, 4], "1,1-2, 2": [0, 1], "1,,2": [0, 1], "2,": [1], "-": [0, 1, 2, 3, 4], "+2": [1]}
    bad = ["abc", "1,x", "0", "1-0", "1-2-3", ",", "--3"]
    df = spark.createDataFrame([(s, s, 5) for s in [*specs, *bad]], "k string, spec string, n int")
    pages, errors = P.parse_page_range(df, "k", "spec", "n")
    got = {}
    for r in pages.collect():
        got.setdefault(r.k, []).append(r.page)
    assert {k: sorted(v) for k, v in got.items()} == specs
    assert sorted(r.spec for r in errors.collect()) == sorted(bad)
    rows = spark.createDataFrame([("a", p) for p in (0, 1, 2, 4, 4)], "k string, page long")
    assert P.format_page_range(rows, "k").first().spec == "1-3, 5"


def bars(spark, rows):
    return spark.createDataFrame([(0, "highlight", c, 1, float(a), float(b), z) for z, (c, a, b) in enumerate(rows)], "page long, kind string, color string, line long, x0 double, x1 double, z long")


def test_paint_over_markup(spark):
    def paint(rows, color, a, b):
        out = A.merge_one_paint(bars(spark, rows), bars(spark, [(color, a, b)])).collect()
        return sorted((r.color, r.x0, r.x1) for r in out)

    assert paint([("y", 70, 220)], "g", 120, 170) == [("g", 120, 170), ("y", 70, 120), ("y", 170, 220)]
    assert paint([("y", 70, 220)], "g", 70.5, 220) == [("g", 70.5, 220)]
    assert paint([("y", 70, 110), ("y", 180, 220)], "y", 100, 190) == [("y", 70, 220)]


def test_twins(spark):
    f = spark.createDataFrame([(0, "p", z, 1.0, 2.0) for z in range(3)], "page long, print string, z long, x0 double, x1 double")
    e = spark.createDataFrame([(0, "p", "delete", 1, 0.0, 0.0), (0, "p", "move", 2, 5.0, 0.0)], "page long, print string, op string, ord long, dx double, dy double")
    assert sorted((r.z, r.x0) for r in A.apply_foreign_edits(f, e).collect()) == [(1, 6.0), (2, 1.0)]
    assert A.live_foreign(f, e).count() == 0


def test_merged_fields_and_outline(spark):
    f = spark.createDataFrame([("v", 1, "name"), ("v", 2, "name")], "vdoc string, source_id long, name string")
    assert sorted(r.name for r in K.merge_fields(f).collect()) == ["name", "name_2"]
    o = spark.createDataFrame([(1, 0, 1, "Chapter 1", 1), (1, 1, 2, "Section 1.1", 2), (1, 2, 1, "Chapter 2", 3)], "source_id long, seq long, level int, title string, page int")
    index = spark.createDataFrame([(1, 0, 0), (1, 2, 1)], "source_id long, old long, new long")
    got = sorted((r.seq, r.level, r.page) for r in K.remap_outline(o, index).collect())
    assert got == [(0, 1, 1), (2, 1, 2)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("D:20260101120000Z",), ("D:20260101",), ("20240102",), ("2024010210",), ("garbage",), ("D:2026",)], "s string")
    assert [r[0] for r in df.select(S.doc_date(F.col("s"))).collect()] == ["2026-01-01 12:00:00", "2026-01-01", "2024-01-02", "2024-01-02", "garbage", "D:2026"]
    sizes = {0: "1 KB", 500: "1 KB", 1024: "1 KB", 1536: "2 KB", 2560: "2 KB", 1048576: "1.0 MB", 1572864: "1.5 MB", 3 << 30: "3.00 GB"}
    n = spark.createDataFrame([(x,) for x in sizes], "n long")
    assert [r[0] for r in n.select(S.human_size(F.col("n"))).collect()] == list(sizes.values())
    c = spark.createDataFrame([("abcd efgh",), (" a\u00a0\u2003b ",), ("abcdef",), (None,)], "s string")
    assert [r[0] for r in c.select(S.collapse_clip(F.col("s"), 6)).collect()] == ["abcd …", "a b", "abcdef", ""]
    k = spark.createDataFrame([("ink", "text"), ("textbox", "radio button"), ("highlight", "dropdown")], "m string, f string")
    assert [tuple(r) for r in k.select(S.mark_noun(F.col("m")), S.kind_label(F.col("f"))).collect()] == [("ink", "Text Field"), ("text box", "Radio Button"), ("highlight", "Dropdown")]
    assert k.select(S.foreign_label(F.lit("Ink"), F.lit("ann")), S.foreign_label(F.lit("Ink"), F.lit(""))).first()[:] == ("Ink by ann", "Ink")
    p = spark.createDataFrame([("/a/./b//../c/",), ("a\\b\\..\\..\\..\\c",)], "s string")
    assert [r[0] for r in p.select(S.path_key(F.col("s"))).collect()] == ["/a/c", "c"]
    with pytest.raises(Exception, match="quarter"):
        n.select(S.norm_rotation(F.col("n") + 7)).collect()


def test_unknown_sources_are_an_error(spark):
    pages = spark.createDataFrame([("v", 1, 0), ("v", 1, 1)], "vdoc string, source_id long, page int")
    m = M.seed_manifest(pages)
    refs = spark.createDataFrame([("v", None, 0, 9, 0)], "vdoc string, at long, nth long, source_id long, page int")
    with pytest.raises(Exception, match="unknown source"):
        M.insert_pages(m, refs, pages).collect()
    assert M.insert_pages(m, refs).where("source_id = 9").first().pos == 2


def test_commit_publishes_whole_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    W.commit(spark.range(3).toDF("x"), path)
    W.commit(spark.range(5).toDF("x"), path)
    assert W.read_committed(spark, path).count() == 5
    with pytest.raises(Exception):
        W.commit(spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("x")), path)
    assert W.read_committed(spark, path).count() == 5
    empty = spark.createDataFrame([], "vdoc string, x int")
    assert W.export_pages(empty.withColumn("pos", F.col("x")), empty.select("vdoc", F.col("x").alias("pos")), str(tmp_path / "e")) is False
    assert not W.committed(spark, str(tmp_path / "e"))


def test_one_of_two_writers_publishes_a_number(spark, tmp_path):
    path = str(tmp_path / "t")
    W.commit(spark.range(3).toDF("x"), path)
    late = W._published
    try:
        W._published = lambda *_: None  # a writer that looked before the version above was there
        with pytest.raises(Exception):
            W.commit(spark.range(9).toDF("x"), path)
    finally:
        W._published = late
    assert W.read_committed(spark, path).count() == 3


def test_unreadable_records(spark):
    batch = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1'), (3, None), (4, "x"), (5, '{"a": null}')], "id long, record string")
    ok, bad = R.append_sources(batch, "a int")
    assert sorted((r.id, r.a) for r in ok.collect()) == [(1, 1), (5, None)] and sorted(r.id for r in bad.collect()) == [2, 3, 4]


def test_dictionary_of_parts_and_phrases(spark):
    t = lines(spark, ["Nothing in the inning of  the thing\nbath and the end"])
    terms = spark.createDataFrame([("IN",), ("the",), ("of the",), ("h and",), ("zz",)], "term string")
    got = {}
    for r in Q.search_dictionary(t, terms).collect():
        got.setdefault(r.term, []).append((r.ln, r.word_no))
    assert {k: sorted(v) for k, v in got.items()} == {"in": [(0, 0), (0, 1), (0, 3), (0, 3), (0, 6)], "the": [(0, 2), (0, 5), (1, 2)], "of the": [(0, 4)], "h and": [(1, 0)]}
    leaks = {r.term: r.leaks for r in Q.leak_check(t, terms).collect()}
    assert leaks == {"IN": 5, "the": 3, "of the": 0, "h and": 1, "zz": 0}


def test_columns_of_words_in_a_long_line(spark):
    text = " ".join(["ab", "", "cde"] * 500)
    w = R.text_words(lines(spark, [text]))
    assert w.count() == 1000 and w.where("substring('%s', c0 + 1, c1 - c0) <> word" % text).count() == 0


def test_redaction_merges_overlapping_boxes(spark):
    t = lines(spark, ["abcdefghij"])
    boxes = spark.createDataFrame([(0, 0, 0, 2, 5), (0, 0, 0, 4, 7), (0, 0, 0, 9, 10)], "doc_id long, page int, line_no int, c0 int, c1 int")
    assert Q.apply_redactions(t, boxes).first().line == "abhi"
    assert Q.apply_redactions(t, boxes, fill="#").first().line == "ab#hi#"


def test_metadata_states(spark):
    one = F.create_map(F.lit("title"), F.lit("T"))
    none = F.create_map().cast("map<string,string>")
    m = spark.range(3).select(F.col("id").alias("page_id"), one.alias("info"), one.alias("xmp"), F.when(F.col("id") == 1, none).when(F.col("id") == 2, F.create_map(F.lit("title"), F.lit("N"), F.lit("no"), F.lit("x"))).alias("override"))
    got = [(r.info, r.xmp) for r in D.apply_metadata(m).orderBy("page_id").collect()]
    assert got == [({"title": "T"}, {"title": "T"}), ({}, {}), ({"title": "N"}, {"title": "N"})]


def painted(spark, marks, paints):
    """(kind, color, note, bars) up the stack; marks and paints as (color, note, [(x0, x1), ...]) on one line."""
    def table(rows):
        return spark.createDataFrame([(0, float(z), "highlight", c, n, [(float(a), 1.0, float(b), 1.0) for a, b in bars]) for z, (c, n, bars) in enumerate(rows)], "page long, z double, kind string, color string, note string, bars array<struct<x0:double,y0:double,x1:double,y1:double>>")

    out = A.merge_markup(table(marks), table(paints)).orderBy("z").collect()
    return [(r.color, r.note, [(b.x0, b.x1) for b in r.bars]) for r in out]


def test_paints_in_sequence(spark):
    assert painted(spark, [("y", None, [(70, 220)])], [("g", None, [(120, 170)])]) == [("y", None, [(70, 120), (170, 220)]), ("g", None, [(120, 170)])]
    assert painted(spark, [("y", "a", [(70, 220)])], [("g", None, [(70.5, 220)])]) == [("g", "a", [(70.5, 220)])]
    assert painted(spark, [("y", "a", [(70, 110)]), ("r", None, [(0, 5)]), ("y", "b", [(180, 220)])], [("y", "c", [(100, 190)])]) == [("y", "a\n\nb\n\nc", [(70, 220)]), ("r", None, [(0, 5)])]
    # one pass up the stack: a mark reached only through a later one is missed
    assert painted(spark, [("y", None, [(0, 20)]), ("y", None, [(15, 40)])], [("y", None, [(35, 50)])]) == [("y", None, [(0, 20)]), ("y", None, [(15, 50)])]
    # bars that meet end to end are not taken in; slivers of a trimmed mark go
    assert painted(spark, [("y", None, [(0, 10)])], [("y", None, [(10, 20)])]) == [("y", None, [(0, 10)]), ("y", None, [(10, 20)])]
    assert painted(spark, [("y", None, [(0, 10), (30, 30.5)])], [("g", None, [(5, 10)])]) == [("y", None, [(0, 5)]), ("g", None, [(5, 10)])]
    # a note of a mark that is covered whole passes on; one of a mark that is met through another keeps its place
    assert painted(spark, [("g", "n", [(0, 10)]), ("y", None, [(20, 30)])], [("y", "p", [(0, 25)])]) == [("y", "n\n\np", [(0, 30)])]
    assert painted(spark, [], [("y", None, [(0, 10)]), ("y", None, [(5, 30)])]) == [("y", None, [(0, 30)])]
