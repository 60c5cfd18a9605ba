"""Marks: spans on lines, stacking order, notes, foreign marks and hits.

A bar is a row (page, kind, color, line, x0, x1, z); ranges join on the page and line first, so a join never meets all pairs. Bars and boxes of two dimensions are in `boxes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.boxes import joined, left_of, overlaps
from quire.operators.ranks import dealt
from quire.sources.readers import text_words

LINE = ["page", "kind", "color", "line"]


def union_bars(bars: DataFrame, key: list[str] = LINE, touch: float = 0.01) -> DataFrame:
    """Bars of a line that overlap or touch become one."""
    w = Window.partitionBy(*key).orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = bars.withColumn("new", F.when(before.isNull() | (F.col("x0") > before + touch), 1).otherwise(0)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def subtract_bars(bars: DataFrame, cutters: DataFrame, key: list[str], least: float = 1.0) -> DataFrame:
    """What the cutters(key, k0, k1) leave of the bars; pieces narrower than `least` are gone, in lines that a cutter is on."""
    merged = union_bars(cutters.select(*key, F.col("k0").alias("x0"), F.col("k1").alias("x1")), key)
    spans = merged.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("cuts"))  # a line's merged spans
    return _left(bars.join(spans, key, "left"), least)


def _left(rows: DataFrame, least: float = 1.0) -> DataFrame:
    """What is left of bars by their sorted, disjoint `cuts`; bars without any (null) stay as they are."""
    pieces = """filter(transform(sequence(0, size(cuts)), i -> named_struct(
        'x0', greatest(x0, if(i = 0, x0, cuts[greatest(i - 1, 0)].x1)), 'x1', least(x1, if(i = size(cuts), x1, cuts[least(i, size(cuts) - 1)].x0)))), p -> p.x1 - p.x0 >= {least})""".replace("{least}", repr(float(least)))
    whole = F.array(F.struct("x0", "x1"))
    return rows.withColumn("p", F.explode(F.when(F.col("cuts").isNull(), whole).otherwise(F.expr(pieces)))).withColumns({"x0": F.col("p.x0"), "x1": F.col("p.x1")}).drop("p", "cuts")


def merge_one_paint(bars: DataFrame, paint: DataFrame) -> DataFrame:
    """One paint(page, kind, color, line, x0, x1) over normalised bars: bars of its colour join it, others are trimmed by it."""
    both = bars.select(*LINE, "x0", "x1", F.lit(False).alias("_paint")).unionByName(paint.select(*LINE, "x0", "x1", F.lit(True).alias("_paint")))
    rows = dealt(both, "page", "kind", "line")  # once, by a count: a line's colours stand together, and nothing is joined
    w = Window.partitionBy("page", "kind", "line")
    known = F.col("page").isNotNull() & F.col("kind").isNotNull() & F.col("line").isNotNull()
    rows = rows.withColumns({"_colors": F.collect_set(F.when(F.col("_paint") & known, F.col("color"))).over(w), "_spans": F.collect_list(F.when(F.col("_paint") & known, F.struct("x0", "x1"))).over(w)})
    own = F.col("_paint") | F.coalesce(F.array_contains("_colors", F.col("color")), F.lit(False))
    span = rows.schema["_spans"].dataType.simpleString()
    grown = "concat(slice(a, 1, size(a) - 1), array(named_struct('x0', a[size(a) - 1].x0, 'x1', greatest(a[size(a) - 1].x1, c.x1))))"
    merged = F.expr(f"aggregate(array_sort(_spans), cast(array() AS {span}), (a, c) -> if(size(a) > 0 AND c.x0 <= a[greatest(size(a) - 1, 0)].x1 + 0.01, {grown}, concat(a, array(c))))")
    trimmed = _left(rows.where(~own).withColumn("cuts", F.when(F.size("_spans") > 0, merged)))
    return union_bars(rows.where(own).select(*LINE, "x0", "x1")).unionByName(trimmed.select(*LINE, "x0", "x1"))


def remove_markup(bars: DataFrame, eraser: DataFrame) -> DataFrame:
    """Erase eraser(page, kind, line, k0, k1) from bars of its kind."""
    return subtract_bars(bars, eraser, ["page", "kind", "line"])


def reorder_jump(marks: DataFrame, front: bool) -> DataFrame:
    """The selected marks (sel) all the way to the front or back, in their order; new z from 0 within the page."""
    first = F.col("sel").cast("int") * (1 if front else -1)
    return marks.withColumn("z", F.row_number().over(Window.partitionBy("page").orderBy(first, "z")) - 1)


def reorder_step(marks: DataFrame, forward: bool) -> DataFrame:
    """Each selected mark past its nearest unselected neighbour; neighbours that are selected move together."""
    sign, sel = 1 if forward else -1, F.coalesce("sel", F.lit(False))
    w = Window.partitionBy("page").orderBy(F.col("z") * sign)
    passed = F.sum((~sel).cast("int")).over(w)  # a selected run comes behind the unselected mark after it
    rows = marks.withColumn("key", passed + sel.cast("int"))
    place, n = F.row_number().over(Window.partitionBy("page").orderBy("key", sel, F.col("z") * sign)), F.count("*").over(Window.partitionBy("page"))
    return rows.withColumn("z", place - 1 if forward else n - place).drop("key")


#: Kinds that are placed freely and so can be moved and scaled; text markup belongs to its text.
PLACED = ["textbox", "ink", "line", "shape", "stamp", "imagestamp", "newfield"]


def translate(marks: DataFrame, dx: float, dy: float, width: float, height: float) -> DataFrame:
    """Move the freely placed marks of a page together, as far as their common box stays on the page; text markup stays where its text is.

    marks(page, kind, x0, y0, x1, y1). A group wider than the page keeps to its left, a higher one to its top.
    """
    w = Window.partitionBy("page")
    placed = F.col("kind").isin(PLACED)
    def step(d: float, low: str, high: str, side: float) -> Column:
        least, most = -F.min(F.when(placed, F.col(low))).over(w), side - F.max(F.when(placed, F.col(high))).over(w)
        return F.least(F.greatest(F.lit(float(d)), least), F.greatest(least, most))

    rows = marks.withColumns({"_dx": step(dx, "x0", "x1", width), "_dy": step(dy, "y0", "y1", height)})
    return rows.withColumns({c: F.when(placed, F.col(c) + F.col(d)).otherwise(F.col(c)) for c, d in (("x0", "_dx"), ("x1", "_dx"), ("y0", "_dy"), ("y1", "_dy"))}).drop("_dx", "_dy")


def scale(marks: DataFrame, sx: float, sy: float, ox: float, oy: float) -> DataFrame:
    """Scale marks(kind, x0, y0, x1, y1) about an origin: ends of lines and strokes move, boxes stay boxes at negative factors, a text box keeps its
    size and moves with its first corner, text markup stays."""
    kind = F.col("kind")
    new = {}
    for low, high, s, o in (("x0", "x1", sx, ox), ("y0", "y1", sy, oy)):
        a, b = o + (F.col(low) - o) * s, o + (F.col(high) - o) * s
        ends = kind.isin("line", "ink")
        new[low] = F.when(~kind.isin(PLACED), F.col(low)).when(ends | (kind == "textbox"), a).otherwise(F.least(a, b))
        new[high] = F.when(~kind.isin(PLACED), F.col(high)).when(kind == "textbox", a + F.col(high) - F.col(low)).when(ends, b).otherwise(F.greatest(a, b))
    return marks.withColumns(new)


def restyle(marks: DataFrame, color: str, width: float, fill: str | None, opacity: float = 1.0, arrows: tuple[bool, bool] | None = None, dashed: bool | None = None) -> DataFrame:
    """New colour, width and opacity of drawn kinds (shape, line, ink) in marks(kind, color, width, fill, opacity, arrow_start, arrow_end, dashed);
    fill for shapes alone, arrow ends for lines alone. arrows and dashed of None keep what a mark has; so do all other kinds."""
    drawn, shape, line = F.col("kind").isin("shape", "line", "ink"), F.col("kind") == "shape", F.col("kind") == "line"
    new = {"color": (drawn, color), "width": (drawn, width), "opacity": (drawn, opacity), "fill": (shape, fill)}
    if arrows is not None:
        new |= {"arrow_start": (line, arrows[0]), "arrow_end": (line, arrows[1])}
    if dashed is not None:
        new["dashed"] = (drawn, dashed)
    return marks.withColumns({c: F.when(of, F.lit(v)).otherwise(F.col(c)) for c, (of, v) in new.items()})


def mark_bounds(bars: DataFrame, key: list[str]) -> DataFrame:
    """The box around each mark's bars."""
    return bars.groupBy(*key).agg(F.min("x0").alias("x0"), F.min("line").alias("y0"), F.max("x1").alias("x1"), F.max("line").alias("y1"))


def quads_to_rects(points: DataFrame) -> DataFrame:
    """page, quad, x0, y0, x1, y1 of each four points(page, i, x, y) in order; what is left over is dropped."""
    quads = points.groupBy("page", F.floor(F.col("i") / 4).alias("quad")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))
    return quads.where("n = 4").drop("n")


def fingerprint(kind: Column, x0: Column, y0: Column, x1: Column, y1: Column, contents: Column, name: Column) -> Column:
    """A mark's identity: nm: and its own name, trimmed; without one fp: and 32 digits of a digest of kind, box to one decimal and contents."""
    box = F.concat_ws(",", *[F.bround(c.cast("double"), 1).cast("string") for c in (x0, y0, x1, y1)])
    own = F.trim(F.coalesce(name, F.lit("")))
    digest = F.substring(F.sha2(F.concat_ws("|", kind, box, F.coalesce(contents, F.lit(""))), 256), 1, 32)
    return F.when(own != "", F.concat(F.lit("nm:"), own)).otherwise(F.concat(F.lit("fp:"), digest))


def combine_moves(edits: DataFrame) -> DataFrame:
    """Repeated moves of one mark add up."""
    return edits.where("op = 'move'").groupBy("page", "print").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))


def live_foreign(foreign: DataFrame, edits: DataFrame) -> DataFrame:
    """What a viewer shows: all twins of a deleted mark are gone, a moved one is shifted by its last move."""
    gone = edits.where("op = 'delete'").select("page", "print").distinct()
    moved = edits.where("op = 'move'").groupBy("page", "print").agg(F.max_by("dx", "ord").alias("dx"))
    rows = foreign.join(gone, ["page", "print"], "left_anti").join(moved, ["page", "print"], "left")
    return rows.withColumns({"x0": F.col("x0") + F.coalesce("dx", F.lit(0)), "x1": F.col("x1") + F.coalesce("dx", F.lit(0))}).drop("dx")


def apply_foreign_edits(foreign: DataFrame, edits: DataFrame) -> DataFrame:
    """What a commit writes: the nth of equal marks takes the nth edit, deletions first, then moves."""
    twin = F.row_number().over(Window.partitionBy("page", "print").orderBy("z"))
    nth = F.row_number().over(Window.partitionBy("page", "print").orderBy(F.when(F.col("op") == "delete", 0).otherwise(1), "ord"))
    numbered = edits.select("page", "print", "op", "dx", nth.alias("twin"))
    rows = foreign.withColumn("twin", twin).join(numbered, ["page", "print", "twin"], "left").where(~F.coalesce("op", F.lit("")).eqNullSafe("delete"))
    return rows.withColumns({"x0": F.col("x0") + F.coalesce("dx", F.lit(0)), "x1": F.col("x1") + F.coalesce("dx", F.lit(0))}).drop("op", "dx", "twin")


def adopt(foreign: DataFrame, chosen: DataFrame, moves: DataFrame, author: str) -> tuple[DataFrame, DataFrame]:
    """(deletions of the originals, own copies with their pending move)."""
    rows = foreign.join(chosen.select("page", "z").distinct(), ["page", "z"], "left_semi")
    own = rows.join(moves.select("page", "print", "dx"), ["page", "print"], "left").withColumns({"x0": F.col("x0") + F.coalesce("dx", F.lit(0)), "x1": F.col("x1") + F.coalesce("dx", F.lit(0)), "author": F.lit(author)}).drop("dx")
    return rows.select("page", "z", "print", F.lit("delete").alias("op")), own


def commit_note(marks: DataFrame, edits: DataFrame) -> DataFrame:
    """The marks that change: a blank note is dropped, any other is kept as typed; an equal one is no edit."""
    new = F.when(F.trim("new_note") == "", None).otherwise(F.col("new_note"))
    rows = marks.join(edits.select("page", "z", "new_note"), ["page", "z"]).withColumn("new_note", new)
    return rows.where(~F.col("note").eqNullSafe(F.col("new_note"))).withColumn("note", F.col("new_note")).drop("new_note")


def remove_first(marks: DataFrame, values: list[str]) -> DataFrame:
    """Marks less the first of each set of equal ones that `drop` names."""
    nth = F.row_number().over(Window.partitionBy(*values).orderBy("z"))
    return marks.withColumn("_nth", nth).where(~(F.col("drop") & (F.col("_nth") == 1))).drop("_nth")


def hit_test(points: DataFrame, marks: DataFrame, pad: float = 2.0) -> DataFrame:
    """event_id, z of the topmost mark that holds each point(page, line, x); own marks before others."""
    m = marks.select(F.col("page").alias("mp"), F.col("line").alias("ml"), "x0", "x1", "z", "own")
    met = points.join(m, (F.col("page") == F.col("mp")) & (F.col("line") == F.col("ml")) & (F.col("x") >= F.col("x0") - pad) & (F.col("x") <= F.col("x1") + pad))
    return met.groupBy("event_id").agg(F.max(F.struct("own", "z")).alias("top")).select("event_id", F.col("top.z").alias("z"), F.col("top.own").alias("own"))


def near_line(points: DataFrame, segments: DataFrame, slack: float = 6.0) -> DataFrame:
    """event_id, z of segments(page, z, x0, y0, x1, y1, width) that lie within half their width and the slack of points(event_id, page, x, y); each mark once."""
    from quire.functions.scalars import segment_distance
    from quire.operators.boxes import point_pairs

    reach = F.col("width") / 2 + slack
    ends = {f"{c}{k}": (F.least(f"{c}0", f"{c}1") - reach if k == 0 else F.greatest(f"{c}0", f"{c}1") + reach) for c in ("x", "y") for k in (0, 1)}
    padded = segments.withColumn("s", F.struct("x0", "y0", "x1", "y1")).withColumns(ends)
    far = segment_distance(*[F.col(c).cast("double") for c in ("x", "y", "s.x0", "s.y0", "s.x1", "s.y1")])
    return point_pairs(points.select("event_id", "page", "x", "y"), padded, ["page"]).where(far <= reach).select("event_id", "z").distinct()


def marks_in_rect(rects: DataFrame, marks: DataFrame, width: float, height: float, pad: float = 3.0, cover: float = 0.98) -> DataFrame:
    """rect_id, page, z of the freely placed marks(page, z, kind, x0, y0, x1, y1) whose padded box overlaps one of rects(rect_id, page, rx0, ry0, rx1, ry1).

    Corners of a rect may come in any order. Marks that cover the page (`cover` of both sides) are left out, else any rect would catch them.
    """
    from quire.operators.boxes import box_pairs

    covers = (F.abs(F.col("x1") - F.col("x0")) >= cover * width) & (F.abs(F.col("y1") - F.col("y0")) >= cover * height)
    a = rects.select("rect_id", "page", *[F.col(f"r{c}").alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    return box_pairs(a, marks.where(F.col("kind").isin(PLACED) & ~covers), ["page"], pad=pad).select("rect_id", "page", "z")


def marks_over(marks: DataFrame, probes: DataFrame, kinds: list[str] | None = None, slack: float = 0.01) -> DataFrame:
    """probe_id, z, kind of the marks on the line of probes(probe_id, page, line, kind, x0, x1) that overlap it by more than the slack: those of the probe's
    own kind, or of the kinds given."""
    p = probes.select("probe_id", "page", "line", F.col("kind").alias("_kind"), F.col("x0").alias("p0"), F.col("x1").alias("p1"))
    both = p.join(marks if kinds is None else marks.where(F.col("kind").isin(kinds)), ["page", "line"])
    if kinds is None:
        both = both.where(F.col("kind") == F.col("_kind"))
    return both.where(F.least("x1", "p1") - F.greatest("x0", "p0") > slack).select("probe_id", "z", "kind")


def note_host(marks: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id, z of the mark that a note on each probe's span goes to: the topmost highlight, else the topmost underline or strikeout, else null."""
    over = marks_over(marks, probes, ["highlight", "underline", "strikeout"])
    best = over.groupBy("probe_id").agg(F.max(F.struct((F.col("kind") == "highlight").alias("h"), "z")).alias("w"))
    return probes.select("probe_id").distinct().join(best, "probe_id", "left").select("probe_id", F.col("w.z").alias("z"))


def nearest_word(points: DataFrame, lines: DataFrame) -> DataFrame:
    """event_id, line_no, word_no: the first word that holds the point(event_id, doc_id, page, x, y), its edges too, else the one whose middle has the least 4 dy^2 + dx^2; ties to the first.

    Only pages with points are split into words, once: the words are written, for every round over cells reads them.
    """
    from quire.operators.boxes import nearest
    from quire.sources.sinks import shared_path

    spark, path = points.sparkSession, shared_path(points.sparkSession, "words")
    near = lines.join(points.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    text_words(near).select("doc_id", "page", "line_no", "word_no", "c0", "c1").write.parquet(path)
    at = spark.read.parquet(path)
    held = points.withColumn("line_no", F.col("y")).join(at, ["doc_id", "page", "line_no"]).where("x BETWEEN c0 AND c1")
    held = held.groupBy("event_id").agg(F.min("word_no").alias("word_no"), F.first("line_no").alias("line_no")).select("event_id", "line_no", "word_no")
    middles = at.select("doc_id", "page", "line_no", "word_no", ((F.col("c0") + F.col("c1")) / 2).alias("x"), F.col("line_no").alias("y"))
    others = nearest(points.join(held, "event_id", "left_anti"), middles, ["doc_id", "page"], ["line_no", "word_no"])
    return held.unionByName(others)


def word_at(points: DataFrame, lines: DataFrame) -> DataFrame:
    """The word that holds the point, if there is one. Points meet whole lines, not words; a word's number is how many begin in the line up to the point."""
    at = lines.select("doc_id", "page", F.col("line_no").alias("y"), "line_no", "line")
    met = points.withColumn("x", F.floor("x").cast("int")).join(at, ["doc_id", "page", "y"]).where("x >= 0 AND x < length(line) AND substring(line, x + 1, 1) <> ' '")
    return met.select("event_id", "line_no", F.expr("size(filter(split(substring(line, 1, x + 1), ' ', -1), w -> w <> '')) - 1").alias("word_no"))


def annotation_rows(passages: DataFrame, clip_passage: int = 48, clip_note: int = 32) -> DataFrame:
    """page, z, row: page from 1, what the mark is called, passage and note where there are any, clipped."""
    from quire.functions.scalars import collapse_clip, mark_noun

    passage, note = collapse_clip(F.col("passage"), clip_passage), collapse_clip(F.col("note"), clip_note)
    rest = lambda lead, s: F.when(s != "", F.concat(F.lit(lead), s)).otherwise("")
    return passages.select("page", "z", F.concat(F.lit("p. "), (F.col("page") + 1).cast("string"), F.lit(" · "), mark_noun(F.col("kind")), rest(" · ", passage), rest(" — ", note)).alias("row"))


def degradations(foreign: DataFrame) -> DataFrame:
    """page, z, losses: what making a mark one's own would lose."""
    rules = [(F.col("dashed"), "dashes"), (F.col("has_reply"), "replies"), (F.col("opacity") < 1, "opacity"), (~F.col("kind").isin("highlight", "underline", "strikeout", "ink", "line"), "shape")]
    return foreign.select("page", "z", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules])), ",").alias("losses"))


_BARS = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
_MARK = f"struct<z:double,kind:string,color:string,note:string,bars:{_BARS}>"


def _meet(a: str, b: str) -> str:
    """SQL: some bar of a overlaps some bar of b."""
    return f"exists({a}, v -> exists({b}, w -> {overlaps('v', 'w')}))"


def merge_markup(marks: DataFrame, paints: DataFrame) -> DataFrame:
    """Paint over a page's marks, one paint after the other: marks and paints have page, z (paints: their order), kind, color, note and bars(x0, y0, x1, y1).

    Going once up the stack, a paint meets the marks of its kind that its bars, or those it has taken in so far, overlap. Those of its colour it takes in;
    of the others what its own bars don't cover stays, in pieces of a width of 1 at least. Notes of marks that are taken in or that
    nothing is left of pass to the paint, apart by an empty line. The result has the place of the first mark taken in, else it is on top. New z count from 0.

    Each paint depends on what the one before left, so a page's marks are one array, folded over its paints: what one reader has drawn on one page.
    """
    meets = f"(m.kind = p.kind AND {_meet('m.bars', 't.bars')})"
    # First who is met, from the bottom up: the reach grows by what is taken in. Then what stays of each mark: null where it is taken in.
    reach = f"aggregate(s, named_struct('bars', p.bars, 'met', cast(array() AS array<boolean>)), (t, m) -> named_struct('bars', if({meets} AND m.color <=> p.color, concat(t.bars, m.bars), t.bars), 'met', concat(t.met, array({meets}))))"
    stays = f"zip_with(s, r.met, (m, hit) -> named_struct('m', m, 'bars', CASE WHEN NOT hit THEN m.bars WHEN m.color <=> p.color THEN NULL ELSE {left_of('m.bars', 'p.bars')} END))"
    gone = "(x.bars IS NULL OR size(x.bars) = 0)"
    below = "size(filter(slice(k, 1, array_position(transform(k, x -> x.bars IS NULL), true)), x -> NOT {gone}))".replace("{gone}", gone)
    place = f"if(exists(k, x -> x.bars IS NULL), cast({below} AS int), size(kept))"
    notes = f"array_join(filter(concat(transform(filter(k, x -> {gone}), x -> x.m.note), array(p.note)), x -> x <> ''), '\n\n')"
    merged = f"named_struct('z', p.z, 'kind', p.kind, 'color', p.color, 'note', nullif({notes}, ''), 'bars', {joined('r.bars')})"
    kept = f"transform(filter(k, x -> NOT {gone}), x -> named_struct('z', x.m.z, 'kind', x.m.kind, 'color', x.m.color, 'note', x.m.note, 'bars', x.bars))"
    put = f"transform(array({kept}), kept -> transform(array({place}), i -> concat(slice(kept, 1, i), array({merged}), slice(kept, i + 1, size(kept))))[0])[0]"
    step = f"transform(array({reach}), r -> transform(array({stays}), k -> {put})[0])[0]"
    fold = f"aggregate(paints, marks, (s, p) -> if(size(p.bars) = 0, s, {step}))"
    shaped = lambda df, side: df.select("page", F.lit(side).alias("side"), F.struct(F.col("z").cast("double").alias("z"), "kind", "color", "note", F.col("bars").cast(_BARS).alias("bars")).cast(_MARK).alias("m"))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("m"))))
    pages = shaped(marks, 0).unionByName(shaped(paints, 1)).groupBy("page").agg(of(0).alias("marks"), of(1).alias("paints"))
    return pages.select("page", F.posexplode(F.expr(fold)).alias("z", "m")).select("page", F.col("z").cast("double").alias("z"), "m.kind", "m.color", "m.note", "m.bars")
