"""Metadata in two stores, with a three-state override: null carries the origin's, a map replaces, an empty map removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.readers import INFO_KEYS


def _empty() -> Column:
    return F.create_map().cast("map<string,string>")


def effective_metadata(meta: DataFrame) -> DataFrame:
    """Adds effective: what a reader of the result sees."""
    return meta.withColumn("effective", F.when(F.col("override").isNull(), F.col("info")).otherwise(F.col("override")))


def apply_metadata(meta: DataFrame, keys: list[str] = INFO_KEYS) -> DataFrame:
    """Write the override to both stores, removing both where it is empty; only writable keys go in; untouched rows carry both through."""
    kept = F.map_filter(F.coalesce("override", _empty()), lambda k, v: k.isin(keys))
    untouched, removed = F.col("override").isNull(), F.size(F.coalesce("override", _empty())) == 0
    write = lambda c: F.when(untouched, F.col(c)).when(removed, _empty()).otherwise(kept)
    return meta.select("*", write("info").alias("new_info"), write("xmp").alias("new_xmp")).drop("info", "xmp").withColumnsRenamed({"new_info": "info", "new_xmp": "xmp"})


def stage_override(meta: DataFrame, edits: DataFrame) -> DataFrame:
    """override from edits(page_id, edit): the stored values with the edited ones, or null when nothing changes."""
    rows = meta.join(edits, "page_id", "left")
    merged = F.map_concat(F.map_filter("info", lambda k, v: ~F.coalesce(F.map_contains_key("edit", k), F.lit(False))), F.coalesce("edit", _empty()))
    flat = lambda m: F.array_sort(F.map_entries(m))
    return rows.withColumn("override", F.when(flat(merged) != flat(F.col("info")), merged)).drop("edit")


def store_mismatch(meta: DataFrame) -> DataFrame:
    """page_id, name, info_value, xmp_value where the stores disagree; blank and absent are the same."""
    rows = meta.select("page_id", "info", "xmp", F.explode(F.array_distinct(F.concat(F.map_keys("info"), F.map_keys("xmp")))).alias("name"))
    value = lambda m: F.nullif(F.try_element_at(m, F.col("name")), F.lit(""))
    rows = rows.select("page_id", "name", value(F.col("info")).alias("info_value"), value(F.col("xmp")).alias("xmp_value"))
    return rows.where(~F.col("info_value").eqNullSafe(F.col("xmp_value")))


def metadata_after_merge(origin: DataFrame, meta: DataFrame) -> DataFrame:
    """A merged document's metadata is its origin(vdoc, page_id)'s; merged-in sources contribute none."""
    return origin.join(meta, "page_id").select("vdoc", "page_id", "info")
