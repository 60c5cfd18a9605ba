"""Places and running sums in ordered groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 12


def dealt(df: DataFrame, *by: str, rows: int = 250_000) -> DataFrame:
    """df dealt by the columns to partitions of some `rows` rows each, by a count, so that a task's windows sort that many, however many there are in all."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows + 1), *by)


def _before(window: Window, weight: str) -> Column:
    return F.coalesce(F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, by: list[str], key: Column, name: str, weight: Column | None = None, ties: list[Column] | None = None, levels: int = 1, bits: int = BITS) -> DataFrame:
    """df with `name`: the sum of weight (1 a row where none is given) over the rows of its group that come before it, by key and then by ties.

    key is a whole number; null keys come first, null groups are groups. The order is dealt by digits of the key: a directory holds the sum of each
    stretch of 2^bits keys, a second one the sum of each 2^bits such stretches, and so on for `levels` of them. Rows are shuffled once, by group and
    stretch; each window sees one stretch, whatever the group holds. Keys that repeat share a stretch, so give repeated ones as one row with a weight.
    """
    rows = df.withColumns({"_key": F.coalesce(key.cast("long"), F.lit(-(1 << 62))), "_weight": F.lit(1).cast("long") if weight is None else weight.cast("long"), "_group": F.struct(*by) if by else F.struct(F.lit(0).alias("one"))})
    rows = rows.withColumn("_d0", F.shiftright("_key", bits))
    sums = rows.groupBy("_group", "_d0").agg(F.sum("_weight").alias("_sum"))
    inside = rows.withColumn("_inside", _before(Window.partitionBy("_group", "_d0").orderBy("_key", *(ties or [])), "_weight"))
    out = inside.join(_directory(sums, 0, levels, bits), ["_group", "_d0"])
    return out.withColumn(name, F.col("_inside") + F.col("_start")).drop("_key", "_weight", "_group", "_d0", "_inside", "_start")


def _directory(sums: DataFrame, level: int, levels: int, bits: int) -> DataFrame:
    """_group, _d<level>, _start from sums(_group, _d<level>, _sum): what comes before each stretch."""
    own, over = f"_d{level}", f"_d{level + 1}"
    if level == levels:
        return sums.select("_group", own, _before(Window.partitionBy("_group").orderBy(own), "_sum").alias("_start"))
    rows = sums.withColumn(over, F.shiftright(own, bits))
    inside = rows.withColumn("_in", _before(Window.partitionBy("_group", over).orderBy(own), "_sum"))
    upper = _directory(rows.groupBy("_group", over).agg(F.sum("_sum").alias("_sum")), level + 1, levels, bits)
    return inside.join(upper, ["_group", over]).select("_group", own, (F.col("_in") + F.col("_start")).alias("_start"))


def numbered(df: DataFrame, order: list[Column], name: str = "nth") -> DataFrame:
    """df with its place from 0 in an order of the whole table, of rows that the order tells apart.

    Two passes: the rows are dealt by ranges of the order and written with their place in the range, so that a lost executor can't deal them anew; then
    the ranges are counted and each place is raised by the rows of the ranges before. One row a range is brought together.
    """
    from quire.sources.sinks import shared_path

    spark, path = df.sparkSession, shared_path(df.sparkSession, "ranges")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    dealt = spark.read.parquet(path).withColumns({"_part": F.shiftrightunsigned("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_part", _before(Window.orderBy("_part"), "_n").alias("_start"))
    return dealt.join(F.broadcast(parts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
