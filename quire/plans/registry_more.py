"""More registered queries: search, redaction, marks, metadata, scalar functions, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import boxes as X
from quire.operators import marks as A
from quire.operators import metadata as D
from quire.operators import search as Q
from quire.plans.registry import HREFS, INFO, query
from quire.plans.relations import Tables
from quire.sources import readers as R
from quire.streaming import history as H

# ---- search: the term "the" inside words; hits by cutting the lower-cased line at the term

HIT = ["doc_id", "ln", "page", "line_no", "c0", "c1"]


def hits_sql(term: str, name: str = "X") -> str:
    """Places of a term, not overlapping, as in the operator: a running sum over the pieces between them."""
    return f"""(SELECT doc_id, ln, page, line_no, line, '{term}' AS term, c0, c0 + {len(term)} AS c1 FROM (
        SELECT *, (sum(length(piece)) OVER (PARTITION BY doc_id, ln ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i * {len(term)})::BIGINT AS c0, count(*) OVER (PARTITION BY doc_id, ln) AS n FROM (
        SELECT doc_id, ln, page, line_no, line, unnest(string_split(lower(line), '{term}')) AS piece, unnest(range(len(string_split(lower(line), '{term}')))) AS i FROM L WHERE contains(lower(line), '{term}'))) WHERE i < n - 1)"""


THE = hits_sql("the")
BOUND = "(c0 = 0 OR substr(line, c0, 1) = ' ') AND (c1 >= length(line) OR substr(line, c1 + 1, 1) = ' ')"


@query("q1_search", "L", f"SELECT doc_id, ln, page, line_no, term, c0, c1 FROM {THE} UNION ALL SELECT doc_id, ln, page, line_no, term, c0, c1 FROM {hits_sql('was')}")
def _(t):
    return Q.search(t.lines, "the was").select(*HIT, "term")


@query("q1_search_phrase", "L", f"SELECT doc_id, ln, page, line_no, c0, c1 FROM {hits_sql('of the')} WHERE {BOUND}")
def _(t):
    return Q.search(t.lines, "of the", whole=True).select(*HIT)


@query("q2_match_case", "L", f"SELECT doc_id, ln, page, line_no, c0, c1 FROM {THE} WHERE substr(line, c0 + 1, c1 - c0) = 'the'")
def _(t):
    return Q.search(t.lines, "the", case=True).select(*HIT)


@query("q3_whole_words", "L", f"SELECT doc_id, ln, page, line_no, c0, c1 FROM {THE} WHERE {BOUND}")
def _(t):
    return Q.search(t.lines, "the", whole=True).select(*HIT)


@query("q4_dedupe_hits", "L", f"SELECT doc_id, ln, page, line_no, c0, c1, 'the' AS term FROM {THE}")
def _(t):
    hits = Q.search_terms(t.lines, F.explode(F.array(F.lit("THE"), F.lit("the"))))
    return Q.dedupe_hits(hits, ["the", "THE"]).select(*HIT, "term")


@query("q5_order_hits", "L", f"SELECT doc_id, ln, c0, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no, c0, c1) AS nth FROM {THE}")
def _(t):
    return Q.order_hits(Q.search(t.lines, "the")).select("doc_id", "ln", "c0", "nth")


SNIP = f"""(SELECT *, CASE WHEN len(b) > nl THEN '… ' ELSE '' END || array_to_string(h, ' ') || CASE WHEN len(h) > 0 AND NOT gl THEN ' ' ELSE '' END || substr(line, c0 + 1, c1 - c0)
    || CASE WHEN len(e) > 0 AND NOT gr THEN ' ' ELSE '' END || array_to_string(e, ' ') || CASE WHEN len(a) > nr THEN ' …' ELSE '' END AS snippet FROM (
    SELECT *, b[greatest(len(b) - nl, 0) + 1:len(b)] AS h, a[1:nr] AS e FROM (SELECT *, 4 + gl::INT AS nl, 4 + gr::INT AS nr FROM (
    SELECT *, list_filter(string_split(substr(line, 1, c0), ' '), lambda x: x <> '') AS b, list_filter(string_split(substr(line, c1 + 1), ' '), lambda x: x <> '') AS a,
    c0 > 0 AND substr(line, c0, 1) <> ' ' AS gl, c1 < length(line) AND substr(line, c1 + 1, 1) <> ' ' AS gr FROM {THE}))))"""


@query("q6_snippets", "L", f"SELECT doc_id, ln, c0, snippet FROM {SNIP}")
def _(t):
    return Q.snippets(Q.search(t.lines, "the")).select("doc_id", "ln", "c0", "snippet")


@query("q7_hit_position", "L", f"SELECT doc_id, ln, c0, (row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no, c0, c1))::VARCHAR || ' of ' || (count(*) OVER (PARTITION BY doc_id))::VARCHAR AS label FROM {THE}")
def _(t):
    return Q.hit_position(Q.search(t.lines, "the")).select("doc_id", "ln", "c0", "label")


@query("q8_hit_listing", "L", f"SELECT doc_id, ln, c0, 'p. ' || (page + 1)::VARCHAR || '   ' || snippet AS \"row\" FROM {SNIP}")
def _(t):
    return Q.hit_listing(Q.search(t.lines, "the"))


@query("q9_hit_counts", "L", f"SELECT doc_id, page, count(*) AS hits FROM {THE} GROUP BY ROLLUP (doc_id, page)")
def _(t):
    return Q.hit_counts(Q.search(t.lines, "the"))


@query("q10_select_range", "W", "SELECT doc_id, page, line_no, word_no, word FROM W WHERE page BETWEEN 0 AND 2 AND page * 100000000 + line_no * 1000000 + word_no >= 3000002 AND page * 100000000 + line_no * 1000000 + word_no <= 201000004")
def _(t):
    return Q.select_range(t.words, (2, 1, 4), (0, 3, 2)).select("doc_id", "page", "line_no", "word_no", "word")


@query("q11_select_all", "W", "SELECT doc_id, min(page) AS first_page, max(page) AS last_page, count(*) AS words FROM W GROUP BY doc_id")
def _(t):
    return Q.select_all(R.line_words(t.lines))


@query("q12_line_bars", "W", "SELECT doc_id, page, line_no, min(c0) AS c0, max(c1) AS c1 FROM W WHERE word_no BETWEEN 1 AND 6 GROUP BY ALL")
def _(t):
    return Q.line_bars(t.words.where("word_no BETWEEN 1 AND 6"))


@query("q13_selected_text", "W", "SELECT doc_id, page, string_agg(l, chr(10) ORDER BY line_no) AS content FROM (SELECT doc_id, page, line_no, string_agg(word, ' ' ORDER BY word_no) AS l FROM W GROUP BY ALL) GROUP BY doc_id, page")
def _(t):
    return Q.lines_text(R.line_texts(t.lines))


@query("q14_invalidate_results", "E", "SELECT doc, event_id, coalesce((SELECT max((ts, event_id)) FROM E e WHERE e.doc = s.doc AND e.op = 'purchase') > (s.ts, s.event_id), false) AS void FROM E s WHERE op = 'view'")
def _(t):
    e = t.events
    return H.invalidate_results(e.where("op = 'view'"), e, ["purchase"])


@query("j14_words_under", "W", "SELECT w.doc_id, w.page, w.line_no, w.word_no, w.word FROM W w WHERE c0 < 30 AND c1 > 10")
def _(t):
    boxes = t.lines.select("doc_id", "page", "line_no", F.lit(10).alias("b0"), F.lit(30).alias("b1"))
    return Q.words_under(boxes, t.words).select("doc_id", "page", "line_no", "word_no", "word")


@query("j15_text_under", "L", "SELECT doc_id, page, line_no, substr(line, 11, 20) AS content FROM L")
def _(t):
    boxes = t.lines.select("doc_id", "page", "line_no", F.lit(10.0).alias("b0"), F.lit(30.0).alias("b1"))
    return Q.text_under(boxes, t.lines).select("doc_id", "page", "line_no", "content")


@query("j16_exclude_overlays", "L", f"SELECT doc_id, ln, c0 FROM {THE} WHERE NOT (line_no % 3 = 0 AND (c0 + c1) / 2.0 BETWEEN 5 AND 40)")
def _(t):
    boxes = t.lines.where("line_no % 3 = 0").select("doc_id", "page", "line_no", F.lit(5).alias("o0"), F.lit(40).alias("o1"))
    return Q.exclude_overlays(Q.search(t.lines, "the"), boxes).select("doc_id", "ln", "c0")


@query("j25_search_dictionary", "W Q", "SELECT w.doc_id, w.page, w.ln, w.word_no, q.term FROM W w JOIN Q q ON q.term = regexp_replace(lower(w.word), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')")
def _(t):
    return Q.search_dictionary(t.lines, t.terms, whole=True)


#: Parts of words and a phrase: a term stands in a word as often as at so many places; the phrase at a word's end, going on in the next.
@query("j25_search_parts", "W", """SELECT doc_id, page, ln, word_no, term FROM (SELECT *, lower(word) AS w, lower(lead(word) OVER (PARTITION BY doc_id, ln ORDER BY word_no)) AS nx FROM W),
    (VALUES ('ing'), ('th'), ('tion'), ('of the')) q(term), (SELECT unnest(range(0, 400)) AS i) WHERE i < length(w) AND (starts_with(substr(w, i + 1), term) OR (term = 'of the' AND substr(w, i + 1) = 'of' AND starts_with(nx, 'the')))""")
def _(t):
    return Q.search_dictionary(t.lines, t.spark.createDataFrame([("ing",), ("Th",), ("tion",), ("of the",)], "term string"))


# ---- redaction


@query("r1_mark_matches", "L", f"SELECT doc_id, page, count(*) AS n, min(line_no * 100000 + c0) AS first FROM {THE} GROUP BY doc_id, page")
def _(t):
    r = Q.mark_matches(Q.search(t.lines, "the"))
    return r.select("doc_id", "page", F.size("boxes").alias("n"), (F.col("boxes")[0]["line_no"] * 100000 + F.col("boxes")[0]["c0"]).alias("first"))


@query("r2_review", "L", f"SELECT doc_id, ln, c0 FROM {THE} WHERE c0 % 3 <> 0")
def _(t):
    hits = Q.search(t.lines, "the")
    return Q.review(hits, hits.where("c0 % 3 = 0")).select("doc_id", "ln", "c0")


@query("r3_redact_selection", "W", "SELECT doc_id, page, line_no, min(c0) AS c0, max(c1) AS c1 FROM W WHERE page = 0 AND line_no * 1000000 + word_no >= 1000002 AND line_no * 1000000 + word_no <= 6000003 GROUP BY ALL")
def _(t):
    return Q.line_bars(Q.select_range(t.words, (0, 1, 2), (0, 6, 3)))


@query("r4_apply_redactions", "L", "SELECT doc_id, ln, regexp_replace(line, 'the', '', 'gi') AS line FROM L")
def _(t):
    return Q.apply_redactions(t.lines, Q.search(t.lines, "the")).select("doc_id", "ln", "line")


@query("r5_pending_export", "L", "SELECT source AS vdoc, doc_id, ln, regexp_replace(line, 'the', '█', 'gi') AS line FROM L JOIN documents USING (doc_id)")
def _(t):
    lines = t.lines
    out = Q.apply_redactions(lines, Q.search(lines, "the"), fill="█")
    return out.join(t["documents"].select("doc_id", F.col("source").alias("vdoc")), "doc_id").select("vdoc", "doc_id", "ln", "line")


@query("r6_leak_check", "L Q", """SELECT term, (SELECT coalesce(sum(len(string_split(lower(r), term)) - 1), 0)::BIGINT FROM (SELECT regexp_replace(line, 'the', '█', 'gi') AS r FROM L)) AS leaks FROM (SELECT * FROM Q UNION SELECT 'the' UNION SELECT 'ing' UNION SELECT 'of a')""")
def _(t):
    terms = t.terms.union(t.spark.range(1).select(F.explode(F.array(F.lit("the"), F.lit("ing"), F.lit("of a"))).alias("term")))
    return Q.leak_check(Q.apply_redactions(t.lines, Q.search(t.lines, "the"), fill="█"), terms)


@query("r8_carry_redactions", "M L", f"""SELECT m.vdoc, m.pos, count(*) AS boxes FROM (SELECT vdoc, row_number() OVER (PARTITION BY vdoc ORDER BY pos) - 1 AS pos, source_id, page FROM M WHERE pos % 3 = 0) m JOIN {THE} h ON h.doc_id = m.source_id AND h.page = m.page GROUP BY ALL""")
def _(t):
    from quire.operators.manifest import subset

    m = t.manifest
    marks = Q.mark_matches(Q.search(t.lines, "the")).select(F.col("doc_id").alias("source_id"), "page", F.size("boxes").alias("boxes"))
    return subset(m, m.where("pos % 3 = 0")).join(marks, ["source_id", "page"]).select("vdoc", "pos", "boxes")


# ---- marks


@query("a1_union_bars", "B", """SELECT page, kind, color, line, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(new) OVER (PARTITION BY page, kind, color, line ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY page, kind, color, line ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.01 THEN 1 ELSE 0 END AS new FROM B)) GROUP BY page, kind, color, line, run""")
def _(t):
    return A.union_bars(t.bars)


#: What is left of each bar, unit by unit: bars and cutters have whole ends, so units between them are cut or not.
def units_sql(cutters: str, on: str) -> str:
    return f"""u AS (SELECT page, kind, color, line, z, s, unnest(range(x0, x1)) AS x FROM bb),
    k AS (SELECT u.*, x - row_number() OVER (PARTITION BY page, z, s ORDER BY x) AS g FROM u WHERE NOT EXISTS (SELECT 1 FROM {cutters} c WHERE {on} AND u.x >= c.x0 AND u.x < c.x1))
    SELECT page, kind, color, line, z, min(x) AS x0, max(x) + 1 AS x1 FROM k GROUP BY page, kind, color, line, z, s, g"""


@query("a2_subtract_bars", "B", "WITH bb AS (SELECT *, 0 AS s FROM B WHERE kind = 'highlight'), cut AS (SELECT * FROM B WHERE kind = 'ink' AND x1 - x0 > 5)," + units_sql("cut", "c.page = u.page AND c.line = u.line"))
def _(t):
    cut = t.bars.where("kind = 'ink' AND x1 - x0 > 5").select("page", "line", F.col("x0").alias("k0"), F.col("x1").alias("k1"))
    return A.subtract_bars(t.bars.where("kind = 'highlight'"), cut, ["page", "line"]).select("page", "kind", "color", "line", "z", "x0", "x1").where("x1 > x0")


NORMAL = """n AS (SELECT page, kind, color, line, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(new) OVER (PARTITION BY page, kind, color, line ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY page, kind, color, line ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.01 THEN 1 ELSE 0 END AS new FROM B WHERE kind <> 'ink')) GROUP BY page, kind, color, line, run)"""


@query("a3_merge_markup", "B", f"""WITH {NORMAL}, paint AS (SELECT DISTINCT page, kind, 'F' AS color, line, 20 AS x0, 60 AS x1 FROM n),
    same AS (SELECT page, kind, color, line, unnest(range(x0, x1)) AS x FROM (SELECT page, kind, color, line, x0, x1 FROM n WHERE color = 'F' UNION ALL SELECT page, kind, color, line, 20, 60 FROM paint)),
    other AS (SELECT page, kind, color, line, unnest(range(x0, x1)) AS x FROM n WHERE color <> 'F'),
    every AS (SELECT DISTINCT * FROM same UNION ALL SELECT DISTINCT * FROM other WHERE x < 20 OR x >= 60)
    SELECT page, kind, color, line, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY page, kind, color, line ORDER BY x) AS g FROM every) GROUP BY page, kind, color, line, g""")
def _(t):
    from quire.sources.sinks import shared_path

    path, n = shared_path(t.spark, "normalised"), A.union_bars(t.bars.where("kind <> 'ink'"))
    n.write.parquet(path)  # read twice
    n = t.spark.read.schema(n.schema).parquet(path)
    paint = n.select("page", "kind", F.lit("F").alias("color"), "line").distinct().withColumns({"x0": F.lit(20).cast("long"), "x1": F.lit(60).cast("long")})
    return A.merge_one_paint(n, paint)


@query("a4_remove_markup", "B", "WITH bb AS (SELECT *, 0 AS s FROM B WHERE kind = 'underline'), cut AS (SELECT DISTINCT page, line, 30 AS x0, 50 AS x1 FROM bb)," + units_sql("cut", "c.page = u.page AND c.line = u.line"))
def _(t):
    b = t.bars.where("kind = 'underline'")
    eraser = b.select("page", "kind", "line", F.lit(30).cast("long").alias("k0"), F.lit(50).cast("long").alias("k1")).distinct()
    return A.remove_markup(b, eraser).select("page", "kind", "color", "line", "z", "x0", "x1")


def selected(t: Tables) -> DataFrame:
    return t.bars.withColumn("sel", F.col("color") == "O").withColumn("was", F.col("z"))


@query("a5_reorder_front", "B", "SELECT page, z AS was, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN color = 'O' THEN 1 ELSE 0 END, z) - 1 AS z FROM B")
def _(t):
    return A.reorder_jump(selected(t), True).select("page", "was", "z")


STEP = """WITH i AS (SELECT page, z, color = 'O' AS sel FROM B), g AS (SELECT *, sum(CASE WHEN sel THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY z {d} ROWS UNBOUNDED PRECEDING) AS r FROM i)
    SELECT page, z AS was, {sign} AS z FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN sel THEN r + 1 ELSE r END, sel, z {d}) AS p, count(*) OVER (PARTITION BY page) AS n FROM g)"""


@query("a6_reorder_forward", "B", STEP.format(d="", sign="p - 1"))
def _(t):
    return A.reorder_step(selected(t), True).select("page", "was", "z")


@query("a6_reorder_backward", "B", STEP.format(d="DESC", sign="n - p"))
def _(t):
    return A.reorder_step(selected(t), False).select("page", "was", "z")


def boxed(t: Tables) -> DataFrame:
    """Bars as boxes of one line's height; every third ink mark is a shape, every third a text box."""
    kind = F.when(F.col("kind") != "ink", F.col("kind")).when(F.col("z") % 3 == 0, "shape").when(F.col("z") % 3 == 1, "textbox").otherwise("ink")
    return t.bars.withColumns({"kind": kind, "x0": F.col("x0").cast("double"), "x1": F.col("x1").cast("double"), "y0": F.col("line").cast("double"), "y1": (F.col("line") + 1).cast("double")})


BOX = "(SELECT * REPLACE (CASE WHEN kind <> 'ink' THEN kind WHEN z % 3 = 0 THEN 'shape' WHEN z % 3 = 1 THEN 'textbox' ELSE 'ink' END AS kind, x0::DOUBLE AS x0, x1::DOUBLE AS x1), line::DOUBLE AS y0, (line + 1)::DOUBLE AS y1 FROM B)"
FREE = "kind IN ('shape', 'textbox', 'ink')"


@query("a7_translate", "B", f"""SELECT page, z, CASE WHEN {FREE} THEN x0 + dx ELSE x0 END AS x0, CASE WHEN {FREE} THEN y0 + dy ELSE y0 END AS y0, CASE WHEN {FREE} THEN x1 + dx ELSE x1 END AS x1, CASE WHEN {FREE} THEN y1 + dy ELSE y1 END AS y1
    FROM (SELECT *, least(greatest(30.0::DOUBLE, lx), greatest(lx, 140.0::DOUBLE - hx)) AS dx, least(greatest(-3.0::DOUBLE, ly), greatest(ly, 6.0::DOUBLE - hy)) AS dy FROM (
    SELECT *, -min(x0) FILTER ({FREE}) OVER w AS lx, max(x1) FILTER ({FREE}) OVER w AS hx, -min(y0) FILTER ({FREE}) OVER w AS ly, max(y1) FILTER ({FREE}) OVER w AS hy FROM {BOX} WINDOW w AS (PARTITION BY page)))""")
def _(t):
    return A.translate(boxed(t), 30, -3, 140.0, 6.0).select("page", "z", "x0", "y0", "x1", "y1")


@query("a8_scale", "B", f"""SELECT page, z, CASE kind WHEN 'shape' THEN least(ax, bx) WHEN 'textbox' THEN ax WHEN 'ink' THEN ax ELSE x0 END AS x0, CASE kind WHEN 'shape' THEN greatest(ax, bx) WHEN 'textbox' THEN ax + x1 - x0 WHEN 'ink' THEN bx ELSE x1 END AS x1,
    CASE kind WHEN 'shape' THEN least(ay, by_) WHEN 'textbox' THEN ay WHEN 'ink' THEN ay ELSE y0 END AS y0, CASE kind WHEN 'shape' THEN greatest(ay, by_) WHEN 'textbox' THEN ay + y1 - y0 WHEN 'ink' THEN by_ ELSE y1 END AS y1
    FROM (SELECT *, 10 + (x0 - 10) * -1.5::DOUBLE AS ax, 10 + (x1 - 10) * -1.5::DOUBLE AS bx, 4 + (y0 - 4) * 2.0::DOUBLE AS ay, 4 + (y1 - 4) * 2.0::DOUBLE AS by_ FROM {BOX})""")
def _(t):
    return A.scale(boxed(t), -1.5, 2.0, 10.0, 4.0).select("page", "z", "x0", "y0", "x1", "y1")


@query("a9_restyle", "B", f"""SELECT page, z, CASE WHEN kind IN ('shape', 'ink') THEN 'red' ELSE color END AS color, CASE WHEN kind IN ('shape', 'ink') THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS width, CASE WHEN kind = 'shape' THEN 'blue' END AS fill,
    CASE WHEN kind IN ('shape', 'ink') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS opacity, z % 2 = 0 AS arrow_start, z % 2 = 1 AS dashed FROM {BOX}""")
def _(t):
    old = {"width": F.lit(1.0), "fill": F.lit(None).cast("string"), "opacity": F.lit(1.0), "arrow_start": F.col("z") % 2 == 0, "arrow_end": F.lit(False), "dashed": F.col("z") % 2 == 1}
    return A.restyle(boxed(t).withColumns(old), "red", 3.0, "blue", 0.5, (True, True)).select("page", "z", "color", "width", "fill", "opacity", "arrow_start", "dashed")


@query("a10_mark_bounds", "B", "SELECT page, kind, color, min(x0) AS x0, min(line) AS y0, max(x1) AS x1, max(line) AS y1 FROM B GROUP BY page, kind, color")
def _(t):
    return A.mark_bounds(t.bars, ["page", "kind", "color"])


@query("a11_quads_to_rects", "P", """SELECT page, i // 4 AS quad, min(x) AS x0, min(line) AS y0, max(x) AS x1, max(line) AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY event_id) - 1 AS i FROM P) GROUP BY page, i // 4 HAVING count(*) = 4""")
def _(t):
    from pyspark.sql import Window

    p = t.points.withColumn("i", F.row_number().over(Window.partitionBy("page").orderBy("event_id")) - 1)
    return A.quads_to_rects(p.select("page", "i", "x", F.col("line").alias("y")))


@query("a12_annotation_rows", "B", """SELECT page, z, 'p. ' || (page + 1)::VARCHAR || ' · ' || kind || ' · ' || CASE WHEN length(p) > 48 THEN substr(p, 1, 47) || '…' ELSE p END || CASE WHEN z % 2 = 0 THEN ' — note ' || color ELSE '' END AS "row"
    FROM (SELECT *, trim(regexp_replace(text, '[\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS p FROM B JOIN documents ON doc_id = page WHERE kind <> 'ink')""")
def _(t):
    d = t["documents"].select(F.col("doc_id").alias("page"), F.col("text").alias("passage"))
    b = t.bars.where("kind <> 'ink'").withColumn("note", F.when(F.col("z") % 2 == 0, F.concat(F.lit("note "), "color")))
    return A.annotation_rows(b.join(d, "page"))


def printed(t: Tables) -> DataFrame:
    return t.bars.where("kind = 'ink'").withColumn("print", A.fingerprint(F.col("kind"), F.lit(0), F.col("line"), F.lit(9), F.col("line"), F.col("color"), F.when(F.col("own"), F.concat(F.lit(" n"), "line", F.lit(" "))).otherwise(" ")))


PRINT = "(SELECT *, CASE WHEN own THEN 'nm:n' || line::VARCHAR ELSE 'fp:' || left(sha256(kind || '|0.0,' || line::VARCHAR || '.0,9.0,' || line::VARCHAR || '.0|' || color), 32) END AS print FROM B WHERE kind = 'ink')"
EDITS = f"(SELECT page, print, op, ord, dx FROM (SELECT DISTINCT page, print, line FROM {PRINT}), (VALUES ('delete', 1, 0), ('move', 2, 5), ('move', 3, 7)) v(op, ord, dx) WHERE op = 'move' OR line % 2 = 0)"


def edits_of(foreign: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("ord"), F.lit(d).cast("long").alias("dx"), F.lit(0).alias("dy")) for o, n, d in (("delete", 1, 0), ("move", 2, 5), ("move", 3, 7))])
    return foreign.select("page", "print", "line").distinct().select("page", "print", "line", F.explode(rows).alias("e")).select("page", "print", "line", "e.*").where("op = 'move' OR line % 2 = 0").drop("line")


@query("a13_fingerprint", "B", f"SELECT page, z, print FROM {PRINT}")
def _(t):
    return printed(t).select("page", "z", "print")


@query("a14_adopt", "B", f"SELECT page, z, 'delete' AS op, NULL::BIGINT AS x0 FROM {PRINT} WHERE z % 2 = 0 UNION ALL SELECT page, z, 'own', x0 + 12 FROM {PRINT} WHERE z % 2 = 0")
def _(t):
    f = printed(t)
    gone, own = A.adopt(f, f.where("z % 2 = 0"), A.combine_moves(edits_of(f)), "me")
    return gone.select("page", "z", "op", F.lit(None).cast("long").alias("x0")).unionByName(own.select("page", "z", F.lit("own").alias("op"), "x0"))


@query("a15_degradations", "B", "SELECT page, z, concat_ws(',', CASE WHEN z % 2 = 0 THEN 'dashes' END, CASE WHEN color = 'F' THEN 'opacity' END) AS losses FROM B")
def _(t):
    return A.degradations(t.bars.withColumns({"dashed": F.col("z") % 2 == 0, "has_reply": F.lit(False), "opacity": F.when(F.col("color") == "F", 0.5).otherwise(1.0)}))


@query("a16_commit_note", "B", "SELECT page, z, CASE WHEN z % 3 = 0 THEN NULL ELSE ' typed ' END AS note FROM B WHERE NOT (z % 3 = 0 AND z % 2 = 1) AND NOT (z % 3 <> 0 AND z % 2 = 0)")
def _(t):
    b = t.bars.withColumn("note", F.when((F.col("z") % 3 != 0) & (F.col("z") % 2 == 0), " typed ").when(F.col("z") % 2 == 0, "old"))
    return A.commit_note(b, b.select("page", "z", F.when(F.col("z") % 3 == 0, "  ").otherwise(" typed ").alias("new_note"))).select("page", "z", "note")


@query("a17_remove_first", "B", "SELECT page, z FROM (SELECT *, row_number() OVER (PARTITION BY page, kind, color ORDER BY z) AS n FROM B) WHERE NOT (n = 1 AND kind = 'ink')")
def _(t):
    return A.remove_first(t.bars.withColumn("drop", F.col("kind") == "ink"), ["page", "kind", "color"]).select("page", "z")


@query("j11_live_foreign", "B", f"SELECT page, z, x0 + 7 AS x0 FROM {PRINT} WHERE line % 2 <> 0")
def _(t):
    f = printed(t)
    return A.live_foreign(f, edits_of(f)).select("page", "z", "x0")


@query("j12_apply_foreign_edits", "B", f"""SELECT f.page, f.z, f.x0 + coalesce(e.dx, 0) AS x0 FROM (SELECT *, row_number() OVER (PARTITION BY page, print ORDER BY z) AS n FROM {PRINT}) f
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY page, print ORDER BY CASE op WHEN 'delete' THEN 0 ELSE 1 END, ord) AS n FROM {EDITS}) e ON f.page = e.page AND f.print = e.print AND f.n = e.n WHERE e.op IS NULL OR e.op <> 'delete'""")
def _(t):
    f = printed(t)
    return A.apply_foreign_edits(f, edits_of(f)).select("page", "z", "x0")


@query("j13_combine_moves", "B", f"SELECT page, print, sum(dx)::BIGINT AS dx FROM {EDITS} WHERE op = 'move' GROUP BY page, print")
def _(t):
    return A.combine_moves(edits_of(printed(t))).select("page", "print", "dx")


@query("j17_hit_test", "P B", "SELECT event_id, z, own FROM (SELECT p.event_id, b.z, b.own, row_number() OVER (PARTITION BY p.event_id ORDER BY b.own DESC, b.z DESC) AS n FROM P p JOIN B b ON p.page = b.page AND p.line = b.line AND p.x BETWEEN b.x0 - 2 AND b.x1 + 2) WHERE n = 1")
def _(t):
    return A.hit_test(t.points, t.bars)


@query("j18_near_line", "P B", "SELECT DISTINCT p.event_id, b.z FROM P p JOIN B b ON p.page = b.page WHERE b.kind = 'ink' AND sqrt(pow(p.x - least(b.x1, greatest(b.x0, p.x)), 2) + pow(p.line - b.line, 2)) <= (b.z % 3) / 2.0 + 2")
def _(t):
    lines = t.bars.where("kind = 'ink'").select("page", "z", "x0", F.col("line").alias("y0"), "x1", F.col("line").alias("y1"), (F.col("z") % 3).alias("width"))
    return A.near_line(t.points.withColumnRenamed("line", "y"), lines, 2.0)


@query("j19_marks_in_rect", "P B", f"SELECT p.event_id AS rect_id, b.page, b.z FROM P p JOIN {BOX} b ON p.page = b.page AND b.y0 - 3 < p.line + 2 AND b.y1 + 3 > p.line AND b.x0 - 3 < p.x + 10 AND b.x1 + 3 > p.x WHERE {FREE} AND NOT (x1 - x0 >= 0.98 * 40)")
def _(t):
    rects = t.points.select(F.col("event_id").alias("rect_id"), "page", F.col("x").alias("rx1"), F.col("line").alias("ry0"), (F.col("x") + 10).alias("rx0"), (F.col("line") + 2).alias("ry1"))
    return A.marks_in_rect(rects, boxed(t), 40.0, 1.0)


POINTS_W = "(SELECT event_id, page AS doc_id, event_id % 3 AS page, x % 200 AS x, line AS y FROM P)"


def word_points(t: Tables) -> DataFrame:
    return t.points.select("event_id", F.col("page").alias("doc_id"), (F.col("event_id") % 3).alias("page"), (F.col("x") % 200).alias("x"), F.col("line").alias("y"))


@query("j20_nearest_word", "P W", f"SELECT event_id, line_no, word_no FROM (SELECT event_id, line_no, word_no, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN line_no = y AND x BETWEEN c0 AND c1 THEN -1 ELSE 4 * (line_no - y) * (line_no - y) + pow((c0 + c1) / 2.0 - x, 2) END, line_no, word_no) AS n FROM {POINTS_W} JOIN W USING (doc_id, page)) WHERE n = 1")
def _(t):
    return A.nearest_word(word_points(t), t.lines)


@query("j21_word_at", "P W", f"SELECT event_id, line_no, word_no FROM {POINTS_W} JOIN W USING (doc_id, page) WHERE line_no = y AND x >= c0 AND x < c1")
def _(t):
    return A.word_at(word_points(t), t.lines)


#: Every third text mark is a probe over all marks.
PROBES = "(SELECT page * 1000 + z AS probe_id, page, line, kind, x0, x1 FROM B WHERE z % 3 = 0)"
OVER = f"{PROBES} p JOIN B b ON p.page = b.page AND p.line = b.line AND least(p.x1, b.x1) - greatest(p.x0, b.x0) > 0.01"


def probes_of(t: Tables) -> DataFrame:
    return t.bars.where("z % 3 = 0").withColumn("probe_id", F.col("page") * 1000 + F.col("z"))


@query("j22_marks_over", "B", f"SELECT probe_id, b.z, b.kind FROM {OVER} WHERE p.kind = b.kind")
def _(t):
    return A.marks_over(t.bars, probes_of(t))


@query("j23_note_host", "B", f"SELECT q.probe_id, h.z FROM {PROBES} q LEFT JOIN (SELECT probe_id, b.z, row_number() OVER (PARTITION BY probe_id ORDER BY b.kind = 'highlight' DESC, b.z DESC) AS n FROM {OVER} WHERE b.kind IN ('highlight', 'underline')) h ON h.probe_id = q.probe_id AND n = 1")
def _(t):
    return A.note_host(t.bars, probes_of(t))


# ---- metadata


def meta(t: Tables) -> DataFrame:
    over = F.when(F.col("page_id") % 3 == 1, F.create_map().cast("map<string,string>")).when(F.col("page_id") % 3 == 2, F.create_map(F.lit("title"), F.lit("New"), F.lit("secret"), F.lit("x")))
    return R.read_info(t["pages"]).withColumn("override", over)


@query("d1_effective_metadata", "", f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN title WHEN 2 THEN 'New' END AS title, CASE page_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 0 ELSE 2 END::BIGINT AS n FROM ({INFO})")
def _(t):
    return D.effective_metadata(meta(t)).select("page_id", F.try_element_at("effective", F.lit("title")).alias("title"), F.size("effective").alias("n"))


@query("d2_apply_metadata", "", f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN title WHEN 2 THEN 'New' END AS title, CASE page_id % 3 WHEN 0 THEN h1 WHEN 2 THEN 'New' END AS xmp_title, CASE page_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 0 ELSE 1 END::BIGINT AS n FROM ({INFO})")
def _(t):
    d = D.apply_metadata(meta(t))
    return d.select("page_id", F.try_element_at("info", F.lit("title")).alias("title"), F.try_element_at("xmp", F.lit("title")).alias("xmp_title"), F.size("info").alias("n"))


@query("d3_stage_override", "", f"SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'New' END AS title FROM ({INFO})")
def _(t):
    m = R.read_info(t["pages"])
    edits = m.select("page_id", F.create_map(F.lit("title"), F.when(F.col("page_id") % 2 == 1, "New").otherwise(F.col("info")["title"])).alias("edit"))
    return D.stage_override(m, edits).select("page_id", F.try_element_at("override", F.lit("title")).alias("title"))


@query("d4_store_mismatch", "", f"""SELECT page_id, 'title' AS name, nullif(title, '') AS info_value, nullif(h1, '') AS xmp_value FROM ({INFO}) WHERE nullif(title, '') IS DISTINCT FROM nullif(h1, '')
    UNION ALL SELECT page_id, 'creator', nullif(coalesce(url, ''), ''), NULL FROM ({INFO}) WHERE coalesce(url, '') <> ''""")
def _(t):
    return D.store_mismatch(R.read_info(t["pages"]))


@query("d5_metadata_after_merge", "", f"SELECT source AS vdoc, page_id, title FROM (SELECT source, min(doc_id) AS page_id FROM documents GROUP BY source) JOIN ({INFO}) USING (page_id)")
def _(t):
    origin = t["documents"].groupBy(F.col("source").alias("vdoc")).agg(F.min("doc_id").alias("page_id"))
    return D.metadata_after_merge(origin, R.read_info(t["pages"])).select("vdoc", "page_id", F.col("info")["title"].alias("title"))


# ---- scalar functions


@query("f1_collapse_clip", "", "SELECT doc_id, CASE WHEN length(s) > 60 THEN substr(s, 1, 59) || '…' ELSE s END AS s FROM (SELECT doc_id, trim(regexp_replace(text, '[\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS s FROM documents)")
def _(t):
    return t["documents"].select("doc_id", S.collapse_clip(F.col("text"), 60).alias("s"))


@query("f2_doc_date", "", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS shown FROM orders")
def _(t):
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("Z"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("12"))).otherwise(F.col("o_orderpriority"))
    return t["orders"].select("o_orderkey", S.doc_date(raw).alias("shown"))


@query("f3_human_size", "", "SELECT doc_id, CASE WHEN n < 1048576 THEN greatest(1, round_even(n::DOUBLE / 1024, 0))::BIGINT::VARCHAR || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n::DOUBLE / 1048576) || ' MB' ELSE printf('%.2f', n::DOUBLE / 1073741824) || ' GB' END AS size FROM (SELECT doc_id, n_chars * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 512 END AS n FROM documents)")
def _(t):
    return t["documents"].select("doc_id", S.human_size(F.col("n_chars") * F.element_at(F.array(*[F.lit(x) for x in (1, 1000, 1000000, 512)]), (F.col("doc_id") % 4 + 1).cast("int"))).alias("size"))


@query("f4_path_key", "", f"""SELECT page_id, link_no, CASE WHEN p LIKE '/%' THEN '/' ELSE '' END || array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(replace(p, chr(92), '/'), '/'), lambda x: [x])),
    lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, x) END), '/') AS key FROM (SELECT page_id, link_no, CASE WHEN link_no % 2 = 0 THEN '/a/../.' ELSE 'b/./../..' END || href AS p FROM ({HREFS}))""")
def _(t):
    h = R.read_links(t["pages"])
    return h.select("page_id", "link_no", S.path_key(F.concat(F.when(F.col("link_no") % 2 == 0, "/a/../.").otherwise("b/./../.."), F.col("href"))).alias("key"))


@query("f5_box_tests", "B", """SELECT a.page, a.z AS za, b.z AS zb, a.x0 < b.x1 AND b.x0 < a.x1 AND a.line < b.line + 2 AND b.line < a.line + 2 AS touch, a.line + 1 BETWEEN b.line AND b.line + 2 AS same, least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.01 AS x_over,
    (a.x0 + a.x1) / 2.0 BETWEEN b.x0 AND b.x1 AND a.line + 1 BETWEEN b.line AND b.line + 2 AS center FROM B a JOIN B b ON a.page = b.page AND b.z = a.z + 1""")
def _(t):
    b = t.bars.select("page", "z", "x0", "x1", F.col("line").alias("y0"), (F.col("line") + 2).alias("y1"))
    o = b.select("page", (F.col("z") - 1).alias("z"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    j = b.join(o, ["page", "z"])
    a, c = [F.col(x) for x in ("x0", "y0", "x1", "y1")], [F.col(f"b{x}") for x in ("x0", "y0", "x1", "y1")]
    return j.select("page", F.col("z").alias("za"), (F.col("z") + 1).alias("zb"), S.boxes_touch(*a, *c).alias("touch"), S.same_line(a[1], a[3], c[1], c[3]).alias("same"), S.x_overlap(a[0], a[2], c[0], c[2]).alias("x_over"), S.center_in(*a, *c).alias("center"))


@query("f6_same_color", "B", "SELECT page, z, z % 3 < 2 AS same FROM B")
def _(t):
    b = F.when(F.col("z") % 3 == 0, F.array(F.lit(0.2), F.lit(0.5), F.lit(1.0))).when(F.col("z") % 3 == 1, F.array(F.lit(0.205), F.lit(0.495), F.lit(1.0))).otherwise(F.array(F.lit(0.2), F.lit(0.5)))
    return t.bars.select("page", "z", S.same_color(F.array(F.lit(0.2), F.lit(0.5), F.lit(1.0)), b).alias("same"))


@query("f7_rect_key", "B", "SELECT page, z, x0::VARCHAR || '.0,' || line::VARCHAR || '.0,' || x1::VARCHAR || '.0,0.0' AS key FROM B")
def _(t):
    return t.bars.select("page", "z", S.rect_key(F.col("x0") + 0.04, F.col("line").cast("double"), F.col("x1") - 0.04, F.lit(0.0)).alias("key"))


@query("f8_segment_distance", "P", "SELECT event_id, sqrt(pow(x - least(40, greatest(10, x)), 2) + pow(line - 3, 2)) AS far FROM P")
def _(t):
    one = lambda v: F.lit(float(v))
    return t.points.select("event_id", S.segment_distance(F.col("x").cast("double"), F.col("line").cast("double"), one(10), one(3), one(40), one(3)).alias("far"))


@query("f9_rotate_box", "B", """SELECT page, z, CASE r WHEN 90 THEN 800 - (line + 1) WHEN 180 THEN 600 - x1 WHEN 270 THEN line ELSE x0 END AS nx0, CASE r WHEN 90 THEN x0 WHEN 180 THEN 800 - (line + 1) WHEN 270 THEN 600 - x1 ELSE line END AS ny0, x0 AS ux, line AS uy FROM (SELECT *, (z % 4) * 90 AS r FROM B)""")
def _(t):
    r, w, h = F.col("z") % 4 * 90, F.lit(600), F.lit(800)
    box = S.rotate_box(F.col("x0"), F.col("line"), F.col("x1"), F.col("line") + 1, r, w, h)
    b = t.bars.select("page", "z", box[0].alias("nx0"), box[1].alias("ny0"), box[2].alias("nx1"), box[3].alias("ny1"), r.alias("r"))
    corner = lambda c: {0: (F.col("nx0"), F.col("ny0")), 90: (F.col("nx1"), F.col("ny0")), 180: (F.col("nx1"), F.col("ny1")), 270: (F.col("nx0"), F.col("ny1"))}[c]
    pick = lambda k: F.when(F.col("r") == 90, corner(90)[k]).when(F.col("r") == 180, corner(180)[k]).when(F.col("r") == 270, corner(270)[k]).otherwise(corner(0)[k])
    ux, uy = S.unrotate_point(pick(0), pick(1), F.col("r"), F.lit(600), F.lit(800))
    return b.select("page", "z", "nx0", "ny0", ux.alias("ux"), uy.alias("uy"))


@query("f10_norm_rotation", "M", "SELECT vdoc, pos, ((pos % 9 - 4) * 90 + 720) % 360 AS r FROM M")
def _(t):
    return t.manifest.select("vdoc", "pos", S.norm_rotation((F.col("pos") % 9 - 4) * 90).alias("r"))


@query("f11_mark_nouns", "B", f"""SELECT page, z, CASE kind WHEN 'textbox' THEN 'text box' ELSE kind END AS noun, CASE color WHEN 'O' THEN 'Text Field' WHEN 'F' THEN 'Dropdown' ELSE 'Radio Button' END AS label,
    CASE WHEN own THEN 'Ink by ann' ELSE 'Ink' END AS foreign_name FROM {BOX}""")
def _(t):
    label = S.kind_label(F.when(F.col("color") == "O", "text").when(F.col("color") == "F", "dropdown").otherwise("radio button"))
    return boxed(t).select("page", "z", S.mark_noun(F.col("kind")).alias("noun"), label.alias("label"), S.foreign_label(F.lit("Ink"), F.when(F.col("own"), "ann")).alias("foreign_name"))


# ---- history


@query("h1_recent", "", "SELECT op, doc, nth FROM (SELECT op, doc, row_number() OVER (PARTITION BY op ORDER BY seen DESC, doc) AS nth FROM (SELECT event_type AS op, user_id AS doc, max((ts, event_id)) AS seen FROM events GROUP BY ALL)) WHERE nth <= 10")
def _(t):
    return H.recent(t.events, "op", "doc")


@query("h2_latest_state", "E", "SELECT doc, op, value FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ts DESC, event_id DESC) AS n FROM E) WHERE n = 1")
def _(t):
    return H.latest_state(t.events)


@query("h3_prune_missing", "", "SELECT op, doc, nth FROM (SELECT op, doc, row_number() OVER (PARTITION BY op ORDER BY seen DESC, doc) AS nth FROM (SELECT event_type AS op, user_id AS doc, max((ts, event_id)) AS seen FROM events GROUP BY ALL)) WHERE nth <= 10 AND doc IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(t):
    there = t["customer"].where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc"))
    return H.prune_missing(H.recent(t.events, "op", "doc"), there, "doc").select("op", "doc", "nth")


@query("h4_changed_sources", "E", """SELECT coalesce(a.doc, b.doc) AS doc, CASE WHEN b.doc IS NULL THEN 'gone' WHEN a.doc IS NULL THEN 'new' ELSE 'changed' END AS change FROM (SELECT doc, max(event_id) AS s, count(*) AS n FROM E WHERE op <> 'purchase' GROUP BY doc) a
    FULL JOIN (SELECT doc, max(event_id) AS s, count(*) AS n FROM E WHERE op <> 'click' GROUP BY doc) b ON a.doc = b.doc WHERE a.s IS DISTINCT FROM b.s OR a.n IS DISTINCT FROM b.n""")
def _(t):
    e = t.events
    sign = lambda op: e.where(F.col("op") != op).groupBy("doc").agg(F.max("event_id").alias("stamp"), F.count("*").alias("size"))
    return H.changed_sources(sign("purchase"), sign("click"))


@query("h5_debounce", "E", "SELECT doc, event_id FROM (SELECT doc, event_id, ts, lead(ts) OVER (PARTITION BY doc ORDER BY ts, event_id) AS nx FROM E) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 3600 * 1000000::BIGINT")
def _(t):
    return H.debounce(t.events, 3600).select("doc", "event_id")


@query("h6_coalesce_repeats", "E", """SELECT doc, min(event_id) AS first_id, min(op) AS op, count(*) AS n, sum(delta)::BIGINT AS delta FROM (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS step FROM (
    SELECT *, CASE WHEN NOT auto_repeat OR op IS DISTINCT FROM lag(op) OVER (PARTITION BY doc ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM E)) GROUP BY doc, step""")
def _(t):
    return H.coalesce_repeats(t.events)


@query("h7_macro_steps", "E", "SELECT doc, event_id // 50 AS macro_id, count(*) AS n, string_agg(DISTINCT op, ',' ORDER BY op) AS ops FROM E GROUP BY ALL")
def _(t):
    return H.macro_steps(t.events.withColumn("macro_id", F.floor(F.col("event_id") / 50)))


def history(t: Tables) -> DataFrame:
    return t.events.withColumn("op", F.when(F.col("event_id") % 4 == 1, "undo").when(F.col("event_id") % 7 == 2, "redo").otherwise(F.col("op")))


#: The undo stack event by event: how many edits are live (d), up to where redo goes (top), and the level an edit lies on.
LEVELS = """RECURSIVE o AS (SELECT doc, event_id, ts, CASE WHEN event_id % 4 = 1 THEN 'undo' WHEN event_id % 7 = 2 THEN 'redo' ELSE op END AS op, row_number() OVER (PARTITION BY doc ORDER BY ts, event_id) AS n FROM E {where}),
    r AS (SELECT doc, 0::BIGINT AS n, 0::BIGINT AS d, 0::BIGINT AS top, NULL::BIGINT AS level FROM o WHERE n = 1
    UNION ALL SELECT r.doc, o.n, CASE o.op WHEN 'undo' THEN greatest(r.d - 1, 0) WHEN 'redo' THEN least(r.d + 1, r.top) ELSE r.d + 1 END, CASE WHEN o.op IN ('undo', 'redo') THEN r.top ELSE r.d + 1 END, CASE WHEN o.op NOT IN ('undo', 'redo') THEN r.d + 1 END FROM r JOIN o ON o.doc = r.doc AND o.n = r.n + 1),
    f AS (SELECT doc, max_by(d, n) AS last FROM r GROUP BY doc), lv AS (SELECT doc, level, max(n) AS n FROM r WHERE level IS NOT NULL GROUP BY doc, level)
    SELECT o.doc, o.event_id, o.op FROM lv JOIN f USING (doc) JOIN o ON o.doc = lv.doc AND o.n = lv.n WHERE lv.level <= f.last"""


@query("h8_effective_log", "E", "WITH " + LEVELS.format(where=""))
def _(t):
    return H.effective_log(history(t)).select("doc", "event_id", "op")


@query("h9_as_of", "E", "WITH " + LEVELS.format(where="WHERE ts::TIMESTAMP <= (SELECT make_timestamp(((epoch_us(min(ts)) // 1000000 + epoch_us(max(ts)) // 1000000) // 2) * 1000000) FROM events)"))
def _(t):
    at = t["events"].agg(F.date_format(F.timestamp_seconds(F.floor((F.unix_timestamp(F.min("ts")) + F.unix_timestamp(F.max("ts"))) / 2)), "yyyy-MM-dd HH:mm:ss")).first()[0]
    return H.as_of(history(t), at).select("doc", "event_id", "op")


@query("h10_open_once", "E", "SELECT doc, event_id FROM (SELECT doc, event_id, row_number() OVER (PARTITION BY doc ORDER BY ts, event_id) AS n FROM E) WHERE n = 1")
def _(t):
    return H.open_once(t.events)


@query("h11_dirty_docs", "E", "SELECT doc FROM E GROUP BY doc HAVING max((ts, event_id)) FILTER (op <> 'purchase') IS NOT NULL AND (max((ts, event_id)) FILTER (op = 'purchase') IS NULL OR max((ts, event_id)) FILTER (op <> 'purchase') > max((ts, event_id)) FILTER (op = 'purchase'))")
def _(t):
    return H.dirty_docs(t.events, "purchase")


@query("a3_merge_sequence")
def _(t):
    bar = F.array(F.struct("x0", F.col("line").alias("y0"), "x1", F.col("line").alias("y1")))
    b = t.bars.where("kind <> 'ink'").withColumn("note", F.when(F.col("z") % 3 == 0, F.concat(F.lit("n"), F.col("z").cast("string"))))
    marks = b.where("z % 2 = 0").select("page", "z", "kind", "color", "note", bar.alias("bars"))
    paints = b.where("z % 2 = 1").select("page", "z", "kind", "color", "note", bar.alias("bars"))
    out = A.merge_markup(marks, paints)
    return out.select("page", "z", "kind", "color", "note", F.explode("bars").alias("b")).select("page", F.col("z").cast("long").alias("z"), "kind", "color", "note", F.col("b.y0").cast("long").alias("line"), "b.x0", "b.x1")


# ---- bars and boxes whose bands are mixed


def banded(t: Tables) -> DataFrame:
    """Bars as boxes whose bands overlap those of other lines now and then."""
    y0 = F.col("line") * 10 + F.col("z") % 4 * 5
    return t.bars.withColumns({"y0": y0.cast("double"), "y1": (y0 + 6 + F.col("x0") % 3 * 4).cast("double"), "x0": F.col("x0").cast("double"), "x1": F.col("x1").cast("double")})


BAND = "BX AS (SELECT page, z, kind, color, own, x0::DOUBLE AS x0, x1::DOUBLE AS x1, (line * 10 + z % 4 * 5)::DOUBLE AS y0, (line * 10 + z % 4 * 5 + 6 + x0 % 3 * 4)::DOUBLE AS y1 FROM B)"


def line_sql(a: str, b: str) -> str:
    return f"(({a}.y0 + {a}.y1) / 2 BETWEEN {b}.y0 AND {b}.y1 OR ({b}.y0 + {b}.y1) / 2 BETWEEN {a}.y0 AND {a}.y1)"


#: First fit, bar by bar: the place of the first box that a bar meets, which grows by it; else a box of its own.
@query("a1_union_boxes", "B", f"""WITH RECURSIVE {BAND}, o AS (SELECT *, row_number() OVER (PARTITION BY page, kind, color ORDER BY y0, x0, y1, x1) AS n FROM BX),
    r AS (SELECT page, kind, color, 0::BIGINT AS n, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS g FROM o WHERE n = 1
    UNION ALL SELECT page, kind, color, n, CASE WHEN k IS NULL OR k = 0 THEN list_append(g, b) ELSE list_transform(g, lambda v, i: CASE WHEN i = k THEN struct_pack(x0 := least(v.x0, b.x0), y0 := least(v.y0, b.y0), x1 := greatest(v.x1, b.x1), y1 := greatest(v.y1, b.y1)) ELSE v END) END FROM (
    SELECT *, list_position(list_transform(g, lambda v: {line_sql("v", "b")} AND b.x0 <= v.x1 + 0.01 AND v.x0 <= b.x1 + 0.01), true) AS k FROM (
    SELECT r.page, r.kind, r.color, o.n, r.g, struct_pack(x0 := o.x0, y0 := o.y0, x1 := o.x1, y1 := o.y1) AS b FROM r JOIN o ON o.page = r.page AND o.kind = r.kind AND o.color = r.color AND o.n = r.n + 1))),
    f AS (SELECT page, kind, color, max_by(g, n) AS g FROM r GROUP BY ALL) SELECT page, kind, color, b.x0, b.y0, b.x1, b.y1 FROM (SELECT page, kind, color, unnest(g) AS b FROM f)""")
def _(t):
    return X.union_boxes(banded(t), ["page", "kind", "color"])


@query("a2_subtract_boxes", "B", f"""WITH {BAND}, c AS (SELECT * FROM BX WHERE kind = 'ink'), a AS (SELECT * FROM BX WHERE kind = 'highlight'),
    u AS (SELECT *, unnest(range(x0::BIGINT, x1::BIGINT)) AS x FROM a), k AS (SELECT u.*, x - row_number() OVER (PARTITION BY page, z ORDER BY x) AS g FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = u.page AND {line_sql("c", "u")} AND u.x >= c.x0 AND u.x < c.x1))
    SELECT page, z, kind, min(x)::DOUBLE AS x0, y0, (max(x) + 1)::DOUBLE AS x1, y1 FROM k GROUP BY page, z, kind, g, y0, y1""")
def _(t):
    b = banded(t)
    return X.subtract_boxes(b.where("kind = 'highlight'").withColumn("bar_id", F.col("z")), b.where("kind = 'ink'"), ["page"]).select("page", "z", "kind", "x0", "y0", "x1", "y1")


@query("j14_words_under_boxes", "P B", f"WITH {BAND} SELECT p.event_id AS box_id, b.page, b.z FROM P p JOIN BX b ON p.page = b.page AND p.x < b.x1 AND p.x + 30 > b.x0 AND p.line * 9 < b.y1 AND p.line * 9 + 12 > b.y0")
def _(t):
    boxes = t.points.select("page", F.col("event_id").alias("box_id"), F.col("x").alias("x0"), (F.col("line") * 9).alias("y0"), (F.col("x") + 30).alias("x1"), (F.col("line") * 9 + 12).alias("y1"))
    return X.words_under_boxes(boxes, banded(t), ["page"], size=32.0).select("box_id", "page", "z")


@query("j16_exclude_boxes", "P B", f"WITH {BAND} SELECT page, z FROM BX h WHERE NOT EXISTS (SELECT 1 FROM P p WHERE p.page = h.page AND (h.x0 + h.x1) / 2 BETWEEN p.x AND p.x + 30 AND (h.y0 + h.y1) / 2 BETWEEN p.line * 9 AND p.line * 9 + 12)")
def _(t):
    overlays = t.points.select("page", F.col("x").alias("x0"), (F.col("line") * 9).alias("y0"), (F.col("x") + 30).alias("x1"), (F.col("line") * 9 + 12).alias("y1"))
    return X.exclude_boxes(banded(t), overlays, ["page"], ["page", "z"]).select("page", "z")


@query("j17_hit_test_boxes", "P B", f"WITH {BAND} SELECT event_id, z, own FROM (SELECT p.event_id, b.z, b.own, row_number() OVER (PARTITION BY p.event_id ORDER BY b.own DESC, b.z DESC) AS n FROM P p JOIN BX b ON p.page = b.page AND p.x BETWEEN b.x0 - 2 AND b.x1 + 2 AND p.line * 9 BETWEEN b.y0 - 2 AND b.y1 + 2) WHERE n = 1")
def _(t):
    return X.hit_test_boxes(t.points.select("event_id", "page", "x", (F.col("line") * 9).alias("y")), banded(t), ["page"], pad=2.0)


@query("r7_commit_redactions", "L", "SELECT doc_id, ln, regexp_replace(line, 'the', '', 'gi') AS line FROM L")
def _(t):
    from quire.sources.sinks import shared_path

    from quire.sources.sinks import commit, read_committed

    path = shared_path(t.spark, "redacted")
    commit(t.lines, path)  # the version that the redaction takes off the disk
    lines = read_committed(t.spark, path)
    log = t.events.withColumn("op", F.when(F.col("event_id") % 40 == 0, "commit").otherwise(F.col("op")))
    return Q.commit_redactions(lines, Q.search(lines, "the"), log, path)[0].select("doc_id", "ln", "line")


@query("r7_log_after_commit", "E", "SELECT doc, event_id FROM E e WHERE NOT EXISTS (SELECT 1 FROM E c WHERE c.doc = e.doc AND c.event_id % 40 = 0 AND (c.ts, c.event_id) >= (e.ts, e.event_id))")
def _(t):
    from quire.sources.sinks import shared_path

    log = t.events.withColumn("op", F.when(F.col("event_id") % 40 == 0, "commit").otherwise(F.col("op")))
    lines = t.lines
    return Q.commit_redactions(lines, Q.search(lines, "the"), log, shared_path(t.spark, "redacted"))[1].select("doc", "event_id")


@query("s10_commit", "L", "SELECT doc_id, ln, line FROM L")
def _(t):
    from quire.sources.sinks import commit, read_committed, shared_path

    path = shared_path(t.spark, "lines")
    commit(t.lines.limit(0).select("doc_id", "ln", "line"), path)
    commit(t.lines.select("doc_id", "ln", "line"), path)
    return read_committed(t.spark, path)
