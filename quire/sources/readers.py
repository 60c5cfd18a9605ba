"""Readers: documents to lines, words, links, metadata; marks and fields. Everything is a column expression on one row, so no reader shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 40
INFO_KEYS = ["title", "author", "subject", "keywords", "creator", "producer", "creationDate", "modDate", "trapped"]


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a table of documents, one for each normalised path (the smallest source_id of equal ones), with their size."""
    from quire.functions.scalars import path_key

    docs = spark.read.parquet(path)
    rows = docs.select(F.col("doc_id").alias("source_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.length("text").cast("long").alias("size"))
    return rows.groupBy(path_key(F.col("path")).alias("key")).agg(F.min(F.struct("source_id", "path", "size")).alias("s")).select("s.source_id", "s.path", "s.size")


def text_lines(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """doc_id, ln, page, line_no, line for each line of docs(doc_id, text)."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    return rows.select("doc_id", "ln", F.floor(F.col("ln") / lines_per_page).cast("int").alias("page"), (F.col("ln") % lines_per_page).alias("line_no"), "line")


def running(numbers: str, chunk: int = 8) -> str:
    """SQL for what comes before each of an array's numbers: running sums by chunks of numbers and by stretches of 64 chunks.

    An entry is the sum of the stretches, of the chunks of its stretch and of the numbers of its chunk before it, so the cost grows with the array; an array that
    grows by a concat an entry is copied each time, so only the stretches are summed up that way.
    """
    total = lambda of: f"aggregate({of}, 0, (a, x) -> a + x)"
    sums = lambda of, n: f"transform(sequence(0, (size({of}) - 1) div {n}), k -> {total(f'slice({of}, int(k * {n} + 1), {n})')})"
    starts = "aggregate(tops, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    base = f"st[k div 64] + {total('slice(sums, int((k div 64) * 64 + 1), int(k % 64))')}"
    inside = f"transform(array(slice(lens, int(k * {chunk} + 1), {chunk})), c -> transform(array({base}), b -> transform(c, (x, i) -> b + {total('slice(c, 1, i)')}))[0])[0]"
    out = f"flatten(transform(sequence(0, size(sums) - 1), k -> {inside}))"
    out = f"transform(array({starts}), st -> {out})[0]"
    out = f"transform(array({sums('sums', 64)}), tops -> {out})[0]"
    out = f"transform(array({sums('lens', chunk)}), sums -> {out})[0]"
    return f"transform(array({numbers}), lens -> if(size(lens) = 0, lens, {out}))[0]"


def piece_starts(pieces: str, gap: str) -> str:
    """SQL for the column at which each of an array's pieces starts, `gap` characters apart."""
    return running(f"transform({pieces}, x -> length(x) + {gap})")


def line_words(lines: DataFrame) -> DataFrame:
    """doc_id, ln, page, line_no, word_no, word: the words between single blanks of each line, without their columns."""
    return lines.select("doc_id", "ln", "page", "line_no", F.posexplode_outer(F.filter(F.split("line", " ", -1), lambda x: x != "")).alias("word_no", "word")).where("word IS NOT NULL")


def line_texts(lines: DataFrame) -> DataFrame:
    """doc_id, ln, page, line_no, words: lines with words, these one blank apart in one text, so that what keeps whole lines needs no row for each word."""
    rows = lines.where("replace(line, ' ', '') <> ''")
    return rows.select("doc_id", "ln", "page", "line_no", F.array_join(F.filter(F.split("line", " ", -1), lambda x: x != ""), " ").alias("words"))


def text_words(lines: DataFrame) -> DataFrame:
    """doc_id, ln, page, line_no, word_no, word, c0, c1: the words between single blanks of each line, with the columns they take."""

    def cut(batch: pa.RecordBatch) -> Iterator:
        """Stretches of a batch with some 4 MB of text each, a line at least."""
        ends = np.cumsum(pc.binary_length(batch.column("line")).to_numpy().astype(np.int64)) >> 22
        at = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1], True]) if len(ends) else []
        for a, b in zip(at[:-1], at[1:]):
            yield batch.slice(a, b - a)

    def spans(batches: Iterator) -> Iterator:
        """Lines to words, a batch at a time: pieces, their lengths and running sums are whole columns of the batch."""
        for batch in (part for whole in batches for part in cut(whole)):
            pieces = pc.split_pattern(batch.column("line"), " ")
            words, row = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
            size = pc.utf8_length(words).to_numpy().astype(np.int64)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
            held = size > 0
            start, nth = np.cumsum(size + 1) - size - 1, np.cumsum(held) - held
            n = np.diff(np.r_[first, len(row)])
            start, nth = start - np.repeat(start[first], n), nth - np.repeat(nth[first], n)
            keep = pa.array(np.flatnonzero(held))
            keys = batch.select(["doc_id", "ln", "page", "line_no"]).take(pa.array(row[held]))
            own = [pa.array(nth[held].astype(np.int32)), words.take(keep), pa.array(start[held].astype(np.int32)), pa.array((start + size)[held].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*keys.columns, *own], names=[*keys.schema.names, "word_no", "word", "c0", "c1"])

    rows = lines.select("doc_id", "ln", "page", "line_no", "line").where("line <> ''")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(spans, f"{kept}, word_no int, word string, c0 int, c1 int")


def read_links(pages: DataFrame) -> DataFrame:
    """page_id, link_no, href, kind for each href in pages(page_id, html): internal (a path), page (a fragment) or uri."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link_no", "href"))
    kind = F.when(F.col("href").startswith("#"), "page").when(F.col("href").startswith("/"), "internal").otherwise("uri")
    return rows.withColumn("kind", kind)


def read_info(pages: DataFrame) -> DataFrame:
    """page_id, info (the writable keys, blank where absent) and xmp, the second store, from pages(page_id, url, html)."""
    part = lambda pattern: F.regexp_extract("html", pattern, 1)
    found = {"title": part("<title>([^<]*)</title>"), "subject": part('<html lang="([^"]*)"'), "creator": F.coalesce("url", F.lit(""))}
    info = F.map_from_arrays(F.array(*[F.lit(k) for k in INFO_KEYS]), F.array(*[found.get(k, F.lit("")) for k in INFO_KEYS]))
    xmp = F.create_map(F.lit("title"), part("<h1>([^<]*)</h1>"), F.lit("subject"), found["subject"])
    return pages.select("page_id", info.alias("info"), xmp.alias("xmp"))


def read_marks(marks: DataFrame, author: str, kinds: list[str]) -> DataFrame:
    """An author's own marks of the kinds that are modelled."""
    return marks.where((F.col("author") == author) & F.col("kind").isin(kinds))


def read_foreign(marks: DataFrame, author: str) -> DataFrame:
    """Everyone else's marks, those without an author among them; author trimmed, contents blank where absent."""
    other = ~F.coalesce(F.trim("author"), F.lit("")).eqNullSafe(F.lit(author))
    return marks.where(other).withColumns({"author": F.trim(F.coalesce("author", F.lit(""))), "contents": F.coalesce("contents", F.lit(""))})


def read_fields(widgets: DataFrame, new_fields: DataFrame, manifest: DataFrame) -> DataFrame:
    """Named fillable fields, stored and newly placed, a row for each place, in the order of the live pages."""
    kinds = ["text", "checkbox", "combobox", "listbox", "radiobutton"]
    both = widgets.unionByName(new_fields).where((F.coalesce("name", F.lit("")) != "") & F.col("type").isin(kinds))
    return both.join(manifest.select("vdoc", "pos", "source_id", "page"), ["source_id", "page"]).select("vdoc", "pos", "name", "type", "value")


def append_sources(batch: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """batch(record, ...) of JSON records -> (the readable ones with their fields, the others as they came, with the column record).

    A record is unreadable when it is no JSON object of the schema (DDL) or null; bad ones are reported and the rest goes in. Other columns come along.
    """
    others = [c for c in batch.columns if c != "record"]
    parsed = batch.withColumn("_r", F.from_json("record", f"{schema}, _quire_corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_quire_corrupt"}))
    bad = F.coalesce(F.col("_r._quire_corrupt").isNotNull() | F.col("_r").isNull(), F.lit(True))
    ok = parsed.where(~bad).select(*others, "_r.*").drop("_quire_corrupt")
    return ok, parsed.where(bad).select(*others, "record")
