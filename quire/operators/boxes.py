"""Boxes with two dimensions: bars on bands, and joins of boxes, points and segments on a grid.

A join meets rows that share a cell of their page, never all of a page's rows with each other, so a page that holds most rows is as many tasks as it has
cells. A pair that shares several cells is reported in one of them, the one with the corner where the pair's overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOUCH = 0.01
_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def same_line(a: str, b: str) -> str:
    """SQL: the middle of either band lies in the other."""
    return f"(({a}.y0 + {a}.y1) / 2 BETWEEN {b}.y0 AND {b}.y1 OR ({b}.y0 + {b}.y1) / 2 BETWEEN {a}.y0 AND {a}.y1)"


def overlaps(a: str, b: str) -> str:
    """SQL: on one line, and across each other by more than a touch."""
    return f"({same_line(a, b)} AND {a}.x0 < {b}.x1 - {TOUCH}D AND {b}.x0 < {a}.x1 - {TOUCH}D)"


def joined(bars: str) -> str:
    """SQL: an array of bars, by y0 and x0 each put to the first box that it overlaps or touches on its line, which grows by it; boxes aren't put together again."""
    meets = f"({same_line('g', 'b')} AND b.x0 <= g.x1 + {TOUCH}D AND g.x0 <= b.x1 + {TOUCH}D)"
    grown = "named_struct('x0', least(g.x0, b.x0), 'y0', least(g.y0, b.y0), 'x1', greatest(g.x1, b.x1), 'y1', greatest(g.y1, b.y1))"
    put = f"transform(array(array_position(transform(u, g -> {meets}), true)), k -> if(k = 0, concat(u, array(b)), transform(u, (g, i) -> if(i = k - 1, {grown}, g))))[0]"
    order = "(p, q) -> CASE WHEN p.y0 < q.y0 THEN -1 WHEN p.y0 > q.y0 THEN 1 WHEN p.x0 < q.x0 THEN -1 WHEN p.x0 > q.x0 THEN 1 WHEN p.y1 < q.y1 THEN -1 WHEN p.y1 > q.y1 THEN 1 WHEN p.x1 < q.x1 THEN -1 WHEN p.x1 > q.x1 THEN 1 ELSE 0 END"
    return f"aggregate(array_sort({bars}, {order}), cast(array() AS array<{_BOX}>), (u, b) -> {put})"


def left_of(bars: str, cuts: str, least: float = 1.0) -> str:
    """SQL: what the cutters on its line leave of each bar, in pieces of a width of `least` at least; bars that none cuts are such pieces too."""
    spans = f"array_sort(transform(filter({cuts}, c -> {same_line('c', 'b')} AND c.x1 > b.x0 AND c.x0 < b.x1), c -> named_struct('x0', c.x0, 'x1', c.x1)))"
    step = "(a, s) -> named_struct('at', greatest(a.at, s.x1), 'out', if(s.x0 > a.at, concat(a.out, array(named_struct('x0', a.at, 'x1', s.x0))), a.out))"
    pieces = f"aggregate({spans}, named_struct('at', b.x0, 'out', cast(array() AS array<struct<x0:double,x1:double>>)), {step}, a -> if(a.at < b.x1, concat(a.out, array(named_struct('x0', a.at, 'x1', b.x1))), a.out))"
    return f"flatten(transform({bars}, b -> transform(filter({pieces}, p -> p.x1 - p.x0 >= {float(least)!r}D), p -> named_struct('x0', p.x0, 'y0', b.y0, 'x1', p.x1, 'y1', b.y1))))"


def _box() -> Column:
    return F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])


def union_boxes(bars: DataFrame, key: list[str]) -> DataFrame:
    """key, x0, y0, x1, y1: the bars(key, x0, y0, x1, y1) of a key by first fit (see `joined`).

    Bars of which no earlier one reaches down to the next can't meet: a key's bars are folded by such stretches, a line of text mostly.
    """
    w = Window.partitionBy(*key).orderBy("y0")
    before = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = bars.withColumn("_new", F.when(before.isNull() | (F.col("y0") > before), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    folded = rows.groupBy(*key, "_run").agg(F.collect_list(_box()).alias("_bars")).select(*key, F.explode(F.expr(joined("_bars"))).alias("_b"))
    return folded.select(*key, "_b.*")


def _cells(df: DataFrame, size: float, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1", pad: float = 0.0) -> DataFrame:
    """df with cx, cy: once for each cell that the padded box meets."""
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - pad) / size), F.floor((F.greatest(a, b) + pad) / size))
    return df.withColumn("cx", F.explode(span(x0, x1))).withColumn("cy", F.explode(span(y0, y1)))


def box_pairs(a: DataFrame, b: DataFrame, key: list[str], size: float = 64.0, pad: float = 0.0) -> DataFrame:
    """Rows of a(key, ax0, ay0, ax1, ay1, ...) with those of b(key, x0, y0, x1, y1, ...) whose box, padded, strictly overlaps theirs; each pair once."""
    low = {f"_{c}": F.least(f"{c}0", f"{c}1") - pad for c in ("x", "y")}
    met = _cells(a, size, "ax0", "ay0", "ax1", "ay1").join(_cells(b, size, pad=pad).withColumns(low), [*key, "cx", "cy"])
    for c in ("x", "y"):
        met = met.where((F.least(f"a{c}0", f"a{c}1") < F.greatest(f"{c}0", f"{c}1") + pad) & (F.greatest(f"a{c}0", f"a{c}1") > F.col(f"_{c}")))
        met = met.where(F.floor(F.greatest(F.least(f"a{c}0", f"a{c}1"), F.col(f"_{c}")) / size) == F.col(f"c{c}"))
    return met.drop("cx", "cy", "_x", "_y")


def point_pairs(points: DataFrame, b: DataFrame, key: list[str], size: float = 64.0, pad: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of points(key, x, y) with those of b(key, x0, y0, x1, y1) whose padded box holds them, edges too; a point is in one cell."""
    met = points.withColumns({"cx": F.floor(F.col(x) / size), "cy": F.floor(F.col(y) / size)}).join(_cells(b, size, pad=pad), [*key, "cx", "cy"])
    for c, a in ((x, "x"), (y, "y")):
        met = met.where((F.col(c) >= F.least(f"{a}0", f"{a}1") - pad) & (F.col(c) <= F.greatest(f"{a}0", f"{a}1") + pad))
    return met.drop("cx", "cy")


def subtract_boxes(bars: DataFrame, cutters: DataFrame, key: list[str], least: float = 1.0, size: float = 64.0) -> DataFrame:
    """What cutters(key, x0, y0, x1, y1) leave of bars(key, bar_id, x0, y0, x1, y1), bar_id unique: pieces of a width of `least` at least (see `left_of`)."""
    a = bars.select(*key, "bar_id", *[F.col(c).cast("double").alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    cut = cutters.select(*key, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).distinct()
    met = box_pairs(a, cut, key, size, pad=TOUCH)  # bands that touch in a line can be on one line; left_of decides
    cuts = met.groupBy(*key, "bar_id").agg(F.collect_list(_box()).alias("_cuts"))
    rows = bars.join(cuts, [*key, "bar_id"], "left").withColumn("_cuts", F.coalesce("_cuts", F.expr(f"cast(array() AS array<{_BOX}>)")))
    rows = rows.withColumn("_own", F.array(_box())).withColumn("_p", F.explode(F.expr(left_of("_own", "_cuts", least))))
    return rows.select(*[c for c in bars.columns if c not in ("x0", "y0", "x1", "y1")], "_p.*")


def _there(df: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows of df under keys that others has, so that no cells are dealt out for pages that can't meet anything."""
    return df.join(others.select(*key).distinct(), key, "left_semi")


def words_under_boxes(boxes: DataFrame, words: DataFrame, key: list[str], size: float = 64.0) -> DataFrame:
    """Rows of boxes(key, box_id, x0, y0, x1, y1) with the words(key, ..., x0, y0, x1, y1) that they strictly overlap."""
    a = boxes.select(*key, "box_id", *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    return box_pairs(a, _there(words, boxes, key), key, size).drop("ax0", "ay0", "ax1", "ay1")


def exclude_boxes(hits: DataFrame, overlays: DataFrame, key: list[str], hit: list[str], size: float = 64.0) -> DataFrame:
    """Hits(key, x0, y0, x1, y1), told apart by the columns `hit`, less those whose centre lies in an overlay, edges too."""
    middle = hits.select(*key, *[h for h in hit if h not in key], ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return hits.join(point_pairs(_there(middle, overlays, key), overlays, key, size).select(*hit).distinct(), hit, "left_anti")


def hit_test_boxes(points: DataFrame, marks: DataFrame, key: list[str], pad: float = 0.0, size: float = 64.0) -> DataFrame:
    """event_id, z, own of the topmost mark(key, z, own, x0, y0, x1, y1) that holds each point(key, event_id, x, y); own marks before others."""
    met = point_pairs(points, _there(marks, points, key), key, size, pad)
    return met.groupBy("event_id").agg(F.max(F.struct("own", "z")).alias("top")).select("event_id", "top.z", "top.own")


def nearest(points: DataFrame, targets: DataFrame, key: list[str], order: list[str], size: float = 16.0) -> DataFrame:
    """event_id and `order` of the target(key, order, x, y) with the least 4 dy^2 + dx^2 to each point(key, event_id, x, y), ties to the first in order.

    Rounds over ever larger cells: a point looks at its own cell and the eight around it, so whatever is nearer than a cell's side is met. Where that finds
    none so near, the point goes on to cells twice as large, until they are as large as the page.
    """
    from quire.sources.sinks import shared_path

    spark = points.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = shared_path(spark, "nearest")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    there = targets.select(*key, *order, F.col("x").cast("double").alias("tx"), (2 * F.col("y").cast("double")).alias("ty"))
    wanted = points.select("event_id", *key, F.col("x").cast("double").alias("x"), (2 * F.col("y").cast("double")).alias("y")).join(there.select(*key).distinct(), key, "left_semi")
    ends = there.agg(*[f(c) for c in ("tx", "ty") for f in (F.min, F.max)]).first()
    far = wanted.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    whole = max([0.0, *(max(ends[i + 1], far[i + 1]) - min(ends[i], far[i]) for i in (0, 2) if ends[0] is not None and far[0] is not None)])
    out, left = None, wanted
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    while True:
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        here = there if out is None else there.join(left.select(*key).distinct(), key, "left_semi")
        near = left.withColumn("r", ring).withColumns({"cx": cell("x") + F.col("r.i"), "cy": cell("y") + F.col("r.j")}).drop("r")
        met = near.join(here.withColumns({"cx": cell("tx"), "cy": cell("ty")}), [*key, "cx", "cy"])
        d = (F.col("tx") - F.col("x")) * (F.col("tx") - F.col("x")) + (F.col("ty") - F.col("y")) * (F.col("ty") - F.col("y"))
        best = met.groupBy("event_id").agg(F.min(F.struct(d.alias("d"), *order)).alias("n"))
        last = size > whole
        done = kept(best if last else best.where(F.col("n.d") <= size * size))
        out = done if out is None else out.unionByName(done)
        if last:
            return out.select("event_id", *[f"n.{c}" for c in order])
        left = kept(left.join(done, "event_id", "left_anti"))
        if left.isEmpty():
            return out.select("event_id", *[f"n.{c}" for c in order])
        size *= 2
