"""Page ranges and predicates on marks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.ranks import prefix_sums

OWN_MARKUP = ["highlight", "underline", "strikeout"]
FOREIGN_MARKUP = ["highlight", "underline", "strikeout", "squiggly", "note"]
TEXT_MARKUP = ["highlight", "underline", "strikeout", "squiggly"]


def parse_page_range(df: DataFrame, key: str, spec: str, count: str) -> tuple[DataFrame, DataFrame]:
    """(key, page from 0 for each page that a row's range names, key and spec of the rows with an error).

    Terms are a, a-b, a-, -b and - (every page), apart by commas; b may be below a; empty terms count for nothing; a blank range is every page;
    beyond the last page is the last; 0, junk and a range of empty terms alone are errors. A document without pages has neither pages nor an error.
    """
    rows = df.select(F.col(key), F.col(spec), F.col(count).cast("long").alias("_n")).where("_n > 0")
    blank = F.trim(F.coalesce(spec, F.lit(""))) == ""
    given = F.filter(F.transform(F.split(spec, ",", -1), lambda x: F.trim(x)), lambda x: x != "")
    terms = rows.select(key, spec, "_n", F.explode_outer(F.when(blank, F.array(F.lit("-"))).otherwise(given)).alias("_t"))
    shape = r"^\+?(\d{0,18})\s*(-?)\s*\+?(\d{0,18})$"
    part = lambda i: F.regexp_extract("_t", shape, i)
    number = lambda i: F.when(part(i) != "", part(i).cast("long"))
    good, dash = F.col("_t").rlike(shape) & ((part(1) != "") | (part(2) == "-")), part(2) == "-"
    first, last = F.coalesce(number(1), F.lit(1)), F.when(dash, F.coalesce(number(3), F.col("_n"))).otherwise(number(1))
    parsed = terms.select(key, spec, "_n", F.when(good, first).alias("a"), F.when(good, last).alias("b"))
    bad = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") < 1) | (F.col("b") < 1)
    errors = parsed.where(bad).select(key, spec).distinct()
    low, high = F.least("a", "b", "_n"), F.least(F.greatest("a", "b"), F.col("_n"))
    pages = parsed.where(~bad).join(errors.select(key), key, "left_anti").select(key, F.explode(F.sequence(low, high)).alias("_p"))
    return pages.select(key, (F.col("_p") - 1).alias("page")).distinct(), errors


def format_page_range(pages: DataFrame, key: str) -> DataFrame:
    """key, spec: the shortest text, counted from 1, for the pages (key, page) of each key."""
    rows = prefix_sums(pages.select(key, "page").distinct(), [key], F.col("page"), "_before").withColumn("run", F.col("page") - F.col("_before"))
    runs = rows.groupBy(key, "run").agg((F.min("page") + 1).alias("a"), (F.max("page") + 1).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    ordered = F.sort_array(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ", ").alias("spec"))


def listed_marks(marks: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The marks that a listing shows: text markup only."""
    return marks.where(F.col("kind").isin(kinds or OWN_MARKUP))


def free_placed(foreign: DataFrame) -> DataFrame:
    """Marks that are placed freely, so not text markup."""
    return foreign.where(~F.col("kind").isin(TEXT_MARKUP))


def geometric(marks: DataFrame) -> DataFrame:
    """Marks with a box at least; a null list counts as none."""
    return marks.where(F.coalesce(F.size("bars"), F.lit(0)) > 0)


def image_only_pages(pages: DataFrame, words: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with an image and no word: no hit there means unreadable, not absent."""
    return pages.join(words, ["doc_id", "page"], "left_anti").join(images, ["doc_id", "page"], "left_semi")


def has_kind(marks: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """key, has: whether a document carries a mark of one of the kinds (redactions, baked content)."""
    return marks.groupBy(key).agg(F.bool_or(F.col("kind").isin(kinds)).alias("has"))


def without_page_covers(marks: DataFrame, width: float, height: float, share: float = 0.98) -> DataFrame:
    """Marks less those that cover the page, which no click may hit."""
    covers = ((F.col("x1") - F.col("x0")) >= share * width) & ((F.col("y1") - F.col("y0")) >= share * height)
    return marks.where(~covers)
