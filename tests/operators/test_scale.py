"""How plans and results hold for large tables: the findings of round 3."""

from quire.operators import links as K
from quire.operators import marks as A
from quire.operators import ranks
from quire.operators import search as Q
from quire.sources import readers as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def one_line(spark, line):
    return spark.createDataFrame([(0, 0, 0, 0, line)], "doc_id long, ln int, page int, line_no int, line string")


def test_nearest_word_splits_pages_with_points_once(spark):
    points = spark.createDataFrame([(1, 0, 0, 2, 0), (2, 0, 0, 40, 0), (3, 7, 0, 1, 0)], "event_id long, doc_id long, page int, x long, y long")
    got = A.nearest_word(points, one_line(spark, "ab  cd e"))
    assert {r.event_id: r.word_no for r in got.collect()} == {1: 0, 2: 2}
    assert "MapInArrow" not in plan(got) and "split(" not in plan(got)


def test_words_are_worked_out_once(spark):
    df = R.text_words(one_line(spark, "a  bc İ 😀d "))
    assert plan(df).count("MapInArrow") == 1 and "zip_with" not in plan(df)
    assert [(r.word_no, r.word, r.c0, r.c1) for r in df.collect()] == [(0, "a", 0, 1), (1, "bc", 3, 5), (2, "İ", 6, 7), (3, "😀d", 8, 10)]
    assert R.text_words(one_line(spark, None)).count() == R.text_words(one_line(spark, "  ")).count() == R.text_words(one_line(spark, "")).count() == 0


def test_boxes_that_touch_are_cuts_of_their_own(spark):
    t = one_line(spark, "xthethey")
    assert Q.apply_redactions(t, Q.search(t, "the"), fill="#").first().line == "x##y"
    assert Q.apply_redactions(t, Q.search(t, "the")).first().line == "xy"


def test_link_graph_groups_nothing_after_its_join(spark):
    pages = spark.createDataFrame([(1, "/a"), (2, "/a"), (3, "/b"), (3, "/a"), (4, None), (2, "/a")], "to_page long, key string")
    hrefs = spark.createDataFrame([(1, "/a"), (1, "/a"), (2, "/b"), (2, "/a"), (5, None)], "from_page long, key string")
    got = K.link_graph(pages, hrefs)
    want = hrefs.join(pages, "key").groupBy("from_page", "to_page").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert plan(got).startswith("Union")


def test_reorder_step_sorts_twice(spark):
    marks = spark.createDataFrame([(1, z, s) for z, s in enumerate([True, False, True, True, False, True])], "page long, z int, sel boolean").withColumnRenamed("z", "was").selectExpr("*", "was AS z")
    place = lambda forward: [r.was for r in A.reorder_step(marks, forward).orderBy("z").collect()]
    assert place(True) == [1, 0, 4, 2, 3, 5] and place(False) == [0, 2, 3, 1, 5, 4]
    assert A.reorder_step(marks, True)._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 3


def test_dealt_grows_with_rows(spark):
    assert ranks.dealt(spark.range(1000), "id", rows=10).rdd.getNumPartitions() == 101


def test_word_at_meets_lines(spark):
    points = spark.createDataFrame([(x + 1, 0, 0, x, 0) for x in range(-1, 9)], "event_id long, doc_id long, page int, x long, y long")
    got = A.word_at(points, one_line(spark, "ab  cd😀 e"))
    assert {r.event_id - 1: r.word_no for r in got.collect()} == {0: 0, 1: 0, 4: 1, 5: 1, 6: 1, 8: 2}
    assert "MapInArrow" not in plan(got) and "word" in got.columns[-1]


def test_whole_lines_need_no_row_a_word(spark):
    rows = [(0, 0, 0, 0, "a  b"), (0, 1, 0, 1, "  "), (0, 2, 0, 2, "c"), (1, 0, 0, 0, "x y"), (1, 0, 0, 0, "u v w")]
    lines = spark.createDataFrame(rows, "doc_id long, ln int, page int, line_no int, line string")
    got = Q.lines_text(R.line_texts(lines))
    assert sorted(got.collect()) == sorted(Q.selected_text(R.line_words(lines)).collect())
    assert "Generate" not in plan(got)


def test_flatten_keeps_lines_whole(spark):
    from quire.sources import sinks as W

    rows = [(0, 0, 0, 0, "a  b"), (0, 2, 0, 2, "c"), (1, 0, 0, 0, "x y"), (1, 0, 0, 0, "u v w")]
    lines = R.line_texts(spark.createDataFrame(rows, "doc_id long, ln int, page int, line_no int, line string"))
    marks = spark.createDataFrame([(0, 0, 1, "n o"), (2, 0, 1, "m")], "doc_id long, page int, z int, note string")
    fills = spark.createDataFrame([(0, 0, "f"), (1, 0, None)], "doc_id long, page int, value string")
    got = W.flatten(lines, marks, fills)
    assert {r.doc_id: r.content for r in got.collect()} == {0: "a b c n o f", 1: "u x v y w", 2: "m"}
    assert "Generate" not in plan(got)


def test_one_paint_joins_nothing(spark):
    bars = spark.createDataFrame([(1, "h", "F", 1, 0, 10), (1, "h", "O", 1, 5, 70), (1, "h", "O", 2, 0, 9), (1, "u", "O", 1, 0, 9), (None, "h", "O", 1, 1, 50), (2, "h", "O", 1, 20, 60)], "page long, kind string, color string, line long, x0 long, x1 long")
    paint = spark.createDataFrame([(1, "h", "F", 1, 8, 30), (1, "h", "F", 1, 40, 50), (1, "h", "G", 1, 25, 35), (None, "h", "F", 1, 20, 30), (2, "h", "F", 1, 10, 61)], "page long, kind string, color string, line long, x0 long, x1 long")
    got = A.merge_one_paint(bars, paint)
    want = [(1, "h", "F", 1, 0, 30), (1, "h", "F", 1, 40, 50), (1, "h", "G", 1, 25, 35), (1, "h", "O", 1, 5, 8), (1, "h", "O", 1, 35, 40), (1, "h", "O", 1, 50, 70), (1, "h", "O", 2, 0, 9), (1, "u", "O", 1, 0, 9), (None, "h", "O", 1, 1, 50), (None, "h", "F", 1, 20, 30), (2, "h", "F", 1, 10, 61)]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(want, got.schema).collect()))
    assert "Join" not in plan(got)


def test_cells_are_dealt_out_for_pages_that_both_sides_have(spark):
    from quire.operators import boxes as X

    boxes = spark.createDataFrame([(1, 7, 0.0, 0.0, 30.0, 12.0)], "page long, box_id long, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([(1, 0, 5.0, 5.0, 9.0, 9.0), (2, 0, 5.0, 5.0, 9.0, 9.0)], "page long, z int, x0 double, y0 double, x1 double, y1 double")
    got = X.words_under_boxes(boxes, words, ["page"])
    assert [(r.box_id, r.page, r.z) for r in got.collect()] == [(7, 1, 0)]
    assert "LeftSemi" in plan(got)


def test_leak_check_redacts_once(spark):
    t = one_line(spark, "the of a thing of a")
    terms = spark.createDataFrame([("the",), ("ing",), ("of a",), ("zz",)], "term string")
    got = Q.leak_check(Q.apply_redactions(t, Q.search(t, "the"), fill="#"), terms)
    assert {r.term: r.leaks for r in got.collect()} == {"the": 0, "ing": 1, "of a": 2, "zz": 0}
    assert "collect_set" not in plan(got)


def test_few_terms_are_looked_for_in_the_row(spark, monkeypatch):
    texts = ["Aaaa of  the banana x\\Ey İi of the\n  of", "", " ", None, "σΑΣ of", "ana banana of the of them"]
    t = R.text_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    terms = spark.createDataFrame([(x,) for x in ("AA", "ana", "of the", "\\E", "x\\ey", "i", " of", "of ", "ς", "a  b", "", None, "aa", "zz")], "term string")
    got = Q.search_dictionary(t, terms)
    assert "Join" not in plan(got) and "Aggregate" not in plan(got)
    monkeypatch.setattr(Q, "FEW_TERMS", 0)  # by the index of words, as for many terms
    many = Q.search_dictionary(t, terms)
    rows = sorted(map(tuple, got.collect()))
    assert "strategy=broadcast" in plan(many) and "get(parts" not in plan(many)
    assert got.dtypes == many.dtypes and rows == sorted(map(tuple, many.collect()))
    assert rows.count((0, 0, 0, 0, "aa")) == 3 and rows.count((5, 0, 0, 1, "ana")) == 2 and (0, 0, 0, 4, "x\\ey") in rows
    assert Q.search_dictionary(t, terms.limit(0)).count() == 0
