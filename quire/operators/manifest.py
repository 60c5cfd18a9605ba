"""Edits of ordered page lists, as set operations on (vdoc, pos): many documents are edited at once, and one of any size by many tasks.

New positions are running counts over stretches of the old ones (`ranks.prefix_sums`), so no task sees a whole vdoc.

A manifest has vdoc, pos (from 0, gapless), source_id, page, rotation and crop columns cx0, cy0, cx1, cy1. Selections have vdoc and pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ranks import prefix_sums

CROP = ["cx0", "cy0", "cx1", "cy1"]


def renumber(m: DataFrame, key: Column) -> DataFrame:
    """New gapless positions by a whole number within each vdoc."""
    return prefix_sums(m, ["vdoc"], key, "_new").withColumn("pos", F.col("_new")).drop("_new")


def seed_manifest(pages: DataFrame) -> DataFrame:
    """All pages(vdoc, source_id, page) in order, without overrides.

    Positions are summed over sources, not pages: a row for each of them, dealt into stretches of their ids.
    """
    counts = pages.groupBy("vdoc", "source_id").agg(F.count("*").alias("n"))
    starts = prefix_sums(counts, ["vdoc"], F.col("source_id"), "start", F.col("n")).drop("n")
    rows = pages.join(starts, ["vdoc", "source_id"])
    none = {c: F.lit(None).cast("double") for c in CROP} | {"rotation": F.lit(None).cast("int")}
    return rows.select("vdoc", (F.col("start") + F.col("page")).cast("long").alias("pos"), "source_id", "page").withColumns(none)


def _flagged(m: DataFrame, sel: DataFrame) -> DataFrame:
    """m with whether a row is selected; a position named twice counts once."""
    marks = sel.select("vdoc", "pos", F.lit(True).alias("sel")).distinct()
    return m.join(marks, ["vdoc", "pos"], "left").withColumn("sel", F.coalesce("sel", F.lit(False)))


def move_page(m: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(vdoc, src, dst), one a vdoc: take the page out, then put it in at dst; out of range is clamped."""
    rows = m.join(moves, "vdoc", "left")
    key = F.when(F.col("pos") == F.col("src"), 2 * F.col("dst") + F.when(F.col("dst") > F.col("src"), 1).otherwise(-1)).otherwise(2 * F.col("pos"))
    return renumber(rows.withColumn("key", F.coalesce(key, 2 * F.col("pos"))), F.col("key")).drop("src", "dst", "key")


def move_pages(m: DataFrame, sel: DataFrame, before: DataFrame) -> DataFrame:
    """Move the selected pages, in their order, before the page at before(vdoc, before); beyond the end is the end."""
    rows = _flagged(m, sel).join(before, "vdoc", "left")
    slot = F.when(F.col("before").isNull(), 0).when(F.col("sel"), 1).when(F.col("pos") < F.col("before"), 0).otherwise(2)
    return renumber(rows.withColumn("slot", slot.cast("long")), F.shiftleft("slot", 48) + F.col("pos")).drop("sel", "before", "slot")


def delete_pages(m: DataFrame, sel: DataFrame) -> DataFrame:
    return renumber(m.join(sel.select("vdoc", "pos").distinct(), ["vdoc", "pos"], "left_anti"), F.col("pos"))


def insert_pages(m: DataFrame, refs: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Splice refs(vdoc, at, nth, source_id, page, overrides) in before position at (null: at the end); unknown sources are an error.

    All refs for one place count as one row with a weight where positions are counted, and are numbered among themselves by nth.
    """
    if sources is not None:
        known = sources.select(F.col("source_id").alias("s")).distinct()
        refs = refs.join(known, F.col("source_id") == F.col("s"), "left")
        refs = refs.withColumn("source_id", F.when(F.col("s").isNotNull(), F.col("source_id")).otherwise(F.raise_error(F.lit("unknown source")).cast("long"))).drop("s")
    end = F.lit(1 << 60)
    place = F.coalesce(2 * F.col("at").cast("long"), end)
    new = prefix_sums(refs.drop("pos").withColumn("_place", place), ["vdoc", "_place"], F.col("nth"), "_nth", levels=2)
    spots = refs.groupBy("vdoc", place.alias("_place")).agg(F.count("*").alias("_many"))
    old = m.select("*", (2 * F.col("pos") + 1).alias("_place"), F.lit(1).cast("long").alias("_many"))
    counted = prefix_sums(old.unionByName(spots, allowMissingColumns=True), ["vdoc"], F.col("_place"), "_first", F.col("_many"))
    kept = counted.where("_place % 2 = 1").withColumn("pos", F.col("_first")).select(*m.columns)
    starts = counted.where("_place % 2 = 0").select("vdoc", "_place", "_first")
    placed = new.join(starts, ["vdoc", "_place"]).withColumn("pos", F.col("_first") + F.col("_nth"))
    return kept.unionByName(placed.drop("at", "nth", "_place", "_first", "_nth"), allowMissingColumns=True)


def import_pages(m: DataFrame, other: DataFrame, sel: DataFrame, target: DataFrame) -> DataFrame:
    """Copy selected pages of another manifest, with their overrides, to target(vdoc, into, at)."""
    taken = other.join(sel.select("vdoc", "pos").distinct(), ["vdoc", "pos"], "left_semi").join(target, "vdoc")
    return insert_pages(m, taken.withColumn("nth", F.col("pos")).drop("vdoc", "pos").withColumnRenamed("into", "vdoc"))


def cut_paste(m_from: DataFrame, sel: DataFrame, m_to: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origin without the pages, destination with them)."""
    return delete_pages(m_from, sel), import_pages(m_to, m_from, sel, target)


def subset(m: DataFrame, sel: DataFrame) -> DataFrame:
    """The selected pages, each once, in document order; origin keeps their place before."""
    return renumber(m.join(sel.select("vdoc", "pos").distinct(), ["vdoc", "pos"], "left_semi").withColumn("origin", F.col("pos")), F.col("pos"))


def duplicate_pages(m: DataFrame, sel: DataFrame) -> DataFrame:
    """Copies of the selected pages after the last of them."""
    chosen = m.join(sel.select("vdoc", "pos").distinct(), ["vdoc", "pos"], "left_semi")
    last = chosen.groupBy("vdoc").agg(F.max("pos").alias("_last"), F.count("*").alias("_many"))
    copies = prefix_sums(chosen, ["vdoc"], F.col("pos"), "_nth").join(last, "vdoc").withColumn("pos", F.col("_last") + 1 + F.col("_nth"))
    moved = m.join(last, "vdoc", "left").withColumn("pos", F.when(F.col("pos") > F.col("_last"), F.col("pos") + F.col("_many")).otherwise(F.col("pos")))
    return moved.select(*m.columns).unionByName(copies.select(*m.columns))


def rotate(m: DataFrame, sel: DataFrame, delta: int, native: str = "native_rotation") -> DataFrame:
    """Turn the selected pages by quarter turns from their override, else from their own rotation."""
    if delta % 90:
        raise ValueError("not a quarter turn")
    rows = _flagged(m, sel)
    turned = F.pmod(F.coalesce("rotation", native) + delta, F.lit(360)).cast("int")
    return rows.withColumn("rotation", F.when(F.col("sel"), turned).otherwise(F.col("rotation"))).drop("sel")


def set_rotation(m: DataFrame, sel: DataFrame, degrees: int) -> DataFrame:
    if degrees % 90:
        raise ValueError("not a quarter turn")
    return _flagged(m, sel).withColumn("rotation", F.when(F.col("sel"), F.lit(degrees % 360)).otherwise(F.col("rotation"))).drop("sel")


def crop(m: DataFrame, sel: DataFrame, rect: tuple[float, float, float, float] | None, frame: list[str]) -> DataFrame:
    """Crop the selected pages to a box within their frame columns; a page that the box misses stays as it is; None clears."""
    rows = _flagged(m, sel)
    if rect is None:
        return rows.withColumns({c: F.when(~F.col("sel"), F.col(c)) for c in CROP}).drop("sel")
    box = [F.greatest(F.lit(float(rect[k])), F.col(frame[k])) if k < 2 else F.least(F.lit(float(rect[k])), F.col(frame[k])) for k in range(4)]
    take = F.col("sel") & (box[0] < box[2]) & (box[1] < box[3])
    rows = rows.withColumn("take", take)
    return rows.withColumns({c: F.when(F.col("take"), b).otherwise(F.col(c)) for c, b in zip(CROP, box, strict=True)}).drop("sel", "take")


def reset_crop(m: DataFrame, sel: DataFrame, media: list[str]) -> DataFrame:
    """Give the selected pages their full frame, in content coordinates."""
    return _flagged(m, sel).withColumns({c: F.when(F.col("sel"), F.col(f)).otherwise(F.col(c)) for c, f in zip(CROP, media, strict=True)}).drop("sel")


def is_cropped(media: list[str], native: list[str]) -> Column:
    """Whether the override, else the page's own crop, differs from its media box."""
    out = F.lit(False)
    for c, f, n in zip(CROP, media, native, strict=True):
        out = out | (F.coalesce(F.col(c), F.col(n)) != F.col(f))
    return out


def visible_size(m: DataFrame, frame: list[str], native: str = "native_rotation") -> DataFrame:
    """vdoc, pos, width, height as shown: crop else frame, swapped by a quarter turn."""
    box = [F.coalesce(F.col(c), F.col(f)) for c, f in zip(CROP, frame, strict=True)]
    w, h = box[2] - box[0], box[3] - box[1]
    side = F.pmod(F.coalesce("rotation", native, F.lit(0)), F.lit(180)) != 0
    return m.select("vdoc", "pos", F.when(side, h).otherwise(w).alias("width"), F.when(side, w).otherwise(h).alias("height"))


def contiguous_runs(m: DataFrame) -> DataFrame:
    """vdoc, start, source_id, first_page, n: runs of pages that follow each other in one source.

    A run starts where the place before holds another page, and ends where the next run starts: two joins on the place, and a count of the starts.
    """
    own = m.select("vdoc", "pos", "source_id", "page")
    before = own.select("vdoc", (F.col("pos") + 1).alias("pos"), F.col("source_id").alias("_s"), (F.col("page") + 1).alias("_p"), F.lit(True).alias("_there"))
    goes_on = F.coalesce("_there", F.lit(False)) & F.col("_s").eqNullSafe(F.col("source_id")) & F.col("_p").eqNullSafe(F.col("page"))
    starts = prefix_sums(own.join(before, ["vdoc", "pos"], "left").where(~goes_on).drop("_s", "_p", "_there"), ["vdoc"], F.col("pos"), "_run")
    ends = starts.select("vdoc", (F.col("_run") - 1).alias("_run"), F.col("pos").alias("_end"))
    last = own.groupBy("vdoc").agg((F.max("pos") + 1).alias("_size"))
    rows = starts.join(ends, ["vdoc", "_run"], "left").join(last, "vdoc")
    return rows.select("vdoc", F.col("pos").alias("start"), "source_id", F.col("page").alias("first_page"), (F.coalesce("_end", "_size") - F.col("pos")).alias("n"))


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """vdoc, change: structural (count, order or geometry), content (marks alone) or none. The manifests have a column content."""
    geometry = F.struct("source_id", "page", "rotation", *CROP)
    side = lambda m, n: m.select("vdoc", "pos", geometry.alias(f"g{n}"), F.col("content").alias(f"c{n}"))
    both = side(a, 1).join(side(b, 2), ["vdoc", "pos"], "full_outer")
    rows = both.groupBy("vdoc").agg(F.bool_or(~F.col("g1").eqNullSafe(F.col("g2"))).alias("s"), F.bool_or(~F.col("c1").eqNullSafe(F.col("c2"))).alias("c"))
    return rows.select("vdoc", F.when(F.col("s"), "structural").when(F.col("c"), "content").otherwise("none").alias("change"))


def apply_to_pages(m: DataFrame, pages: DataFrame, mark: dict[str, Column]) -> DataFrame:
    """One mark on each page of pages(vdoc, pos); pages that are not there are passed over."""
    return m.select("vdoc", "pos").join(pages.select("vdoc", "pos").distinct(), ["vdoc", "pos"], "left_semi").withColumns(mark)
