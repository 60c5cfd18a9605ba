"""Links, outlines and form fields through an edited manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def link_targets(m: DataFrame) -> DataFrame:
    """vdoc, source_id, page, pos: where each source page stands first."""
    return m.groupBy("vdoc", "source_id", "page").agg(F.min("pos").alias("pos"))


def resolve_named(links: DataFrame, dests: DataFrame) -> DataFrame:
    """Links with a named destination get its page, null where no such name is; others stay."""
    found = links.join(dests.select("source_id", F.col("name").alias("dest"), F.col("page").alias("named_page")), ["source_id", "dest"], "left")
    return found.withColumn("target_page", F.when(F.col("kind") == "named", F.col("named_page")).otherwise(F.col("target_page"))).drop("named_page")


def remap_links(m: DataFrame, links: DataFrame) -> DataFrame:
    """vdoc, pos, link_no, target_pos: internal links of every page, pointed at their target's first place; those without one are gone."""
    inner = links.where(F.col("kind").isin("goto", "named") & F.col("target_page").isNotNull())
    at = m.select("vdoc", "pos", "source_id", "page").join(inner.select("source_id", "page", "link_no", "target_page"), ["source_id", "page"])
    to = link_targets(m).select("vdoc", "source_id", F.col("page").alias("target_page"), F.col("pos").alias("target_pos"))
    return at.join(to, ["vdoc", "source_id", "target_page"]).select("vdoc", "pos", "link_no", "target_pos")


def dangling_links(m: DataFrame, links: DataFrame) -> DataFrame:
    """vdoc, pos, link_no of internal links whose target page is not in the document."""
    inner = links.where(F.col("kind").isin("goto", "named"))
    at = m.select("vdoc", "pos", "source_id", "page").join(inner.select("source_id", "page", "link_no", "target_page"), ["source_id", "page"])
    there = link_targets(m).select("vdoc", "source_id", F.col("page").alias("target_page"))
    return at.join(there, ["vdoc", "source_id", "target_page"], "left_anti").select("vdoc", "pos", "link_no")


def lost_uris(src: DataFrame, out: DataFrame) -> DataFrame:
    """URIs of src(doc_id, page, uri, box) with no equal text and box, to 2 places, in out."""
    key = ["doc_id", "page", "uri", *[f"k{c}" for c in ("x0", "y0", "x1", "y1")]]
    keyed = lambda df: df.where("uri IS NOT NULL").withColumns({f"k{c}": F.bround(c, 2) for c in ("x0", "y0", "x1", "y1")})
    return keyed(src).join(keyed(out).select(*key).distinct(), key, "left_anti").select("doc_id", "page", "uri")


def remap_outline(outline: DataFrame, index_map: DataFrame) -> DataFrame:
    """Entries whose page(from 1) is in index_map(source_id, old, new; from 0), with the page's new number."""
    rows = outline.join(index_map, (outline["source_id"] == index_map["source_id"]) & (F.col("page") == F.col("old") + 1)).drop(index_map["source_id"])
    return rows.withColumn("page", F.col("new") + 1).drop("old", "new")


def section_of_page(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, seq of the last entry at or before each page; null before the first.

    Entries and pages are put in one order for each document, so the join is one shuffle and one pass.
    """
    marks = outline.select("doc_id", "page", F.lit(0).alias("side"), "seq")
    both = marks.unionByName(pages.select("doc_id", "page", F.lit(1).alias("side"), F.lit(None).cast("long").alias("seq")))
    w = Window.partitionBy("doc_id").orderBy("page", "side", "seq")
    return both.withColumn("found", F.last("seq", ignorenulls=True).over(w)).where("side = 1").select("doc_id", "page", F.col("found").alias("seq"))


def apply_fills(fields: DataFrame, fills: DataFrame) -> DataFrame:
    """Values by name on all pages; a field without a fill keeps its value, a null fill clears a text-like one."""
    there = fills.select("doc_id", "name", F.col("value").alias("new"), F.lit(True).alias("filled"))
    cleared = F.when(F.col("new").isNull(), F.when(F.col("type").isin("text", "combobox"), "").otherwise(F.col("value"))).otherwise(F.col("new"))
    return fields.join(there, ["doc_id", "name"], "left").withColumn("value", F.when(F.col("filled"), cleared).otherwise(F.col("value"))).drop("new", "filled")


def merge_fields(fields: DataFrame) -> DataFrame:
    """fields(vdoc, source_id, name): equal names of other sources are numbered from the second on, so all survive."""
    w = Window.partitionBy("vdoc", "name").orderBy("source_id")
    n = F.dense_rank().over(w)
    return fields.withColumn("n", n).withColumn("name", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("n").cast("string")))).drop("n")


def create_fields(new: DataFrame) -> DataFrame:
    """new(doc_id, ord, name, type, value, choices): default names by number, a dropdown's first choice, a check box's on or off."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    name = F.coalesce(F.when(F.trim("name") != "", F.trim("name")), F.concat(F.lit("Field"), number.cast("string")))
    value = F.when(F.col("type") == "combobox", F.coalesce("value", F.try_element_at("choices", F.lit(1)), F.lit(""))).when(F.col("type") == "checkbox", F.when(F.lower("value").isin("true", "on", "yes", "1"), "true").otherwise("false")).otherwise(F.coalesce("value", F.lit("")))
    return new.select("doc_id", "ord", name.alias("name"), "type", value.alias("value"))


def link_graph(pages: DataFrame, hrefs: DataFrame) -> DataFrame:
    """from_page, to_page, links: which held page links to which, by normalised path.

    A path that many pages link to and many pages hold makes as many rows as it has pairs, so nothing is grouped after that join: links are counted by page and path
    before it, and a path's linking pages are dealt to 16 parts. Only pages held at several paths are summed once more.
    """
    sent = hrefs.groupBy("from_page", "key").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64("from_page"), F.lit(16)))
    held = pages.where("key IS NOT NULL").groupBy("to_page", "key").agg(F.count("*").alias("m")).groupBy("to_page").agg(F.collect_list(F.struct("key", "m")).alias("at"))
    held = held.select("to_page", (F.size("at") > 1).alias("several"), F.explode("at").alias("at")).select("to_page", "several", "at.*")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    links = (F.col("n") * F.col("m")).alias("links")
    once = sent.join(held.where("NOT several"), ["key", "part"]).select("from_page", "to_page", links)
    more = sent.join(held.where("several"), ["key", "part"]).select("from_page", "to_page", links)
    return once.unionByName(more.groupBy("from_page", "to_page").agg(F.sum("links").alias("links")))


_CHUNK = 8  # bits: entries of one chunk have seq >> 8 in common
_OPEN = "array<struct<level:bigint,seq:bigint,title:string>>"


def _open_after(entries: str, start: str = f"cast(array() AS {_OPEN})") -> str:
    """SQL: the entries that are open after `entries`: each closes all open ones that are not above it."""
    return f"aggregate({entries}, {start}, (a, x) -> concat(filter(a, o -> o.level < x.level), array(named_struct('level', x.level, 'seq', x.seq, 'title', x.title))))"


def nested(outline: DataFrame) -> DataFrame:
    """doc_id, seq, title, page of outline(doc_id, seq, level, title, page) with depth, how many entries it stands in and one more, and above, those entries.

    An entry stands in the last one before it that has a smaller level, in whatever that one stands in, and so on, to any depth. A document's entries are dealt into
    chunks by seq. A chunk is summed up by its least level, which closes what is open before it, and by what it leaves open; the sums are put together in order,
    and each chunk starts from what is open before it. So an entry costs what is open, however long its document's outline is.
    """
    rows = outline.select(F.struct("doc_id").alias("doc"), F.shiftright(F.col("seq").cast("long"), _CHUNK).alias("chunk"), F.struct(F.col("seq").cast("long").alias("seq"), F.col("level").cast("long").alias("level"), "title", "page").alias("x"))
    chunks = rows.groupBy("doc", "chunk").agg(F.array_sort(F.collect_list("x")).alias("e"))
    sums = chunks.select("doc", F.struct("chunk", F.expr("array_min(transform(e, x -> x.level))").alias("low"), F.expr(_open_after("e")).alias("open")).alias("s"))
    kept = "filter(a.open, o -> o.level < s.low)"
    fold = f"""aggregate(ss, named_struct('open', cast(array() AS {_OPEN}), 'out', cast(array() AS array<struct<chunk:bigint,open:{_OPEN}>>)),
        (a, s) -> named_struct('open', concat({kept}, s.open), 'out', concat(a.out, array(named_struct('chunk', s.chunk, 'open', a.open))))).out"""
    starts = sums.groupBy("doc").agg(F.array_sort(F.collect_list("s")).alias("ss")).select("doc", F.explode(F.expr(fold)).alias("b")).select("doc", "b.chunk", "b.open")
    own = f"""aggregate(e, named_struct('open', open, 'out', cast(array() AS array<{_OPEN}>)), (a, x) -> transform(array(filter(a.open, o -> o.level < x.level)),
        k -> named_struct('open', concat(k, array(named_struct('level', x.level, 'seq', x.seq, 'title', x.title))), 'out', concat(a.out, array(k))))[0]).out"""
    done = chunks.join(starts, ["doc", "chunk"]).select("doc", F.explode(F.arrays_zip("e", F.expr(own).alias("above"))).alias("z"))
    return done.select("doc.doc_id", "z.e.seq", "z.e.title", "z.e.page", (F.size("z.above") + 1).cast("long").alias("depth"), F.col("z.above").alias("above"))


def repair_levels(outline: DataFrame) -> DataFrame:
    """Levels that begin with 1 and rise by one at most: each is the nesting depth among the levels before it."""
    return nested(outline).select("doc_id", "seq", F.col("depth").alias("level"), "title", "page")


def outline_tree(outline: DataFrame) -> DataFrame:
    """doc_id, seq, parent: the entry that each one stands in, null at the top; levels may be repaired or not."""
    return nested(outline).select("doc_id", "seq", F.try_element_at("above", F.lit(-1))["seq"].alias("parent"))


def outline_path(outline: DataFrame) -> DataFrame:
    """doc_id, seq, path: titles from the root, apart by ' > '; levels may be repaired or not."""
    return nested(outline).select("doc_id", "seq", F.concat_ws(" > ", F.col("above.title"), "title").alias("path"))
