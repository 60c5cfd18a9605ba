"""Sinks: atomic publication, extracts, labels for one file a page, flattening, size reports."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder, but in local mode alone."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quire-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """(the file system of a path, a function from text to its Path)."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it is not there."""
    fs, to_path = _files(spark, path)
    at = to_path(path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def _published(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """(number, record) of the last publication; None where there is none. Records without their last line feed aren't complete."""
    fs, to_path = _files(spark, path)
    for n in sorted((int(x) for x in _names(spark, f"{path}/published") if x.isdigit()), reverse=True):
        stream = fs.open(to_path(f"{path}/published/{n}"))
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("\n"):
            return n, json.loads(text)
    return None


def _publish(spark: SparkSession, path: str, last: tuple[int, dict] | None, record: dict) -> None:
    """Put a record under the number after `last` if none is there: of writers that publish the same number one wins, the others get FileExistsError.

    The store decides, not a look at it before: the record is written beside and then linked (local disks) or renamed (HDFS) to its number, which fails where there is
    a file of that name; other stores create an object under the condition that there is none, and show it whole when it is closed.
    """
    fs, to_path = _files(spark, path)
    context = spark.sparkContext
    at, raw = to_path(f"{path}/published/{last[0] + 1 if last else 0}"), (json.dumps(record) + "\n").encode()
    beside = fs.getScheme() in ("file", "hdfs", "viewfs", "webhdfs")
    written = to_path(f"{path}/published/_{uuid.uuid4().hex}") if beside else at
    try:
        stream = fs.create(written, False)
        stream.write(raw)
        stream.close()
        if fs.getScheme() == "file":
            nio, none = context._jvm.java.nio.file, context._gateway.new_array(context._jvm.java.lang.String, 0)
            nio.Files.createLink(*[nio.Paths.get(p.toUri().getPath(), none) for p in (at, written)])
        elif beside and not fs.rename(written, at):
            raise FileExistsError(f"{at} is published by another writer")
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
            raise
        raise FileExistsError(f"{at} is published by another writer") from e
    finally:
        if beside:
            fs.delete(written, False)


def commit(df: DataFrame, path: str, partition_by: list[str] | None = None, purge: bool = False) -> str:
    """Write a version of a table and publish it last: readers see the old version whole, or the new one whole.

    The version's folder is written first; then the number after the one that was last before the write is published, if nobody else has published it (see
    `_publish`). A write that fails leaves no number, so the published version stays. purge: every version that was there before the publication is removed from
    disk after it, unpublished leftovers too; a writer that began before it can't publish any more. Returns the version's name.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    last = _published(spark, path)
    df.write.partitionBy(*(partition_by or [])).parquet(f"{path}/versions/{version}")
    before = [x for x in _names(spark, f"{path}/versions") if x != version] if purge else []
    _publish(spark, path, last, {"version": version})
    fs, to_path = _files(spark, path)
    for name in before:
        fs.delete(to_path(f"{path}/versions/{name}"), True)
    return version


def committed(spark: SparkSession, path: str) -> bool:
    return _published(spark, path) is not None


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The version published last, or the buckets that make it up; an error where there is none."""
    last = _published(spark, path)
    if last is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    record = last[1]
    if "version" in record:
        return spark.read.parquet(f"{path}/versions/{record['version']}")
    return spark.read.schema(T.StructType.fromJson(record["schema"])).parquet(*[f"{path}/versions/{v}/_bucket={b}" for b, v in sorted(record["buckets"].items())])


def merge_buckets(rows: DataFrame, path: str, key: str, fold: Callable[[DataFrame], DataFrame], buckets: int = 64) -> list[int]:
    """Fold rows into the published table at `path`, which is dealt by `key` into buckets: the buckets that rows touch are read, folded and written, the others stay.

    fold takes the rows of a key, old and new, and gives those to keep, of the same columns. The record that is published says for each bucket which version
    has it. Folders that neither this record nor the one before names are removed. Returns the buckets written.
    """
    spark, version, last = rows.sparkSession, uuid.uuid4().hex, _published(rows.sparkSession, path)
    record = last[1] if last else {"buckets": {}, "n": buckets}
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(record["n"])).cast("int"))
    touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())
    if not touched:
        return []
    old = {b: v for b, v in record["buckets"].items() if int(b) in touched}
    merged = rows
    if old:
        merged = merged.unionByName(spark.read.schema(rows.schema).parquet(*[f"{path}/versions/{v}/_bucket={b}" for b, v in sorted(old.items())]))
    out = fold(merged).select(*rows.columns).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(record["n"])).cast("int"))
    out.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/versions/{version}")
    now = {"n": record["n"], "schema": json.loads(rows.schema.json()), "buckets": record["buckets"] | {str(b): version for b in touched}}
    _publish(spark, path, last, now)
    fs, to_path = _files(spark, path)
    named = {(v, b) for r in (record, now) for b, v in r["buckets"].items()}
    for v in {v for v, _ in named}:
        for folder in _names(spark, f"{path}/versions/{v}"):
            if folder.startswith("_bucket=") and (v, folder[8:]) not in named:
                fs.delete(to_path(f"{path}/versions/{v}/{folder}"), True)
    return touched


def export_pages(manifest: DataFrame, selected: DataFrame, path: str) -> bool:
    """Publish the selected pages, each once and in document order, in folders by vdoc; nothing, and False, when there are none."""
    from quire.operators.manifest import subset

    pages = subset(manifest, selected)
    if pages.isEmpty():
        return False
    commit(pages, path, ["vdoc"])
    return True


def page_labels(manifest: DataFrame, selected: DataFrame) -> DataFrame:
    """vdoc, pos, label of each selected page: its number, as wide as the document's last; blank when it is the only one."""
    last = manifest.groupBy("vdoc").agg((F.max("pos") + 1).alias("pages"))
    chosen = manifest.join(selected.select("vdoc", "pos").distinct(), ["vdoc", "pos"], "left_semi")
    rows = chosen.join(last, "vdoc").join(chosen.groupBy("vdoc").agg((F.count("*") == 1).alias("one")), "vdoc")
    number = F.lpad((F.col("pos") + 1).cast("string"), F.length(F.col("pages").cast("string")), "0")
    return rows.select("vdoc", "pos", F.when(F.col("one"), "").otherwise(number).alias("label"))


def flatten(lines: DataFrame, marks: DataFrame, fills: DataFrame) -> DataFrame:
    """doc_id, page, content: the words of each page's lines (see `line_texts`) with its marks' notes and its field values after them; nothing is editable any more.

    Lines go through whole. Lines of one number on a page, as of repeated documents, are put together by word.
    """
    parts = lines.select("doc_id", "page", F.lit(0).alias("layer"), F.col("ln").cast("long").alias("n"), F.col("words").alias("part"))
    notes = marks.where(F.coalesce("note", F.lit("")) != "").select("doc_id", "page", F.lit(1).alias("layer"), F.col("z").cast("long").alias("n"), F.col("note").alias("part"))
    values = fills.where("value IS NOT NULL").select("doc_id", "page", F.lit(2).alias("layer"), F.lit(0).cast("long").alias("n"), F.col("value").alias("part"))
    rows = parts.unionByName(notes).unionByName(values).groupBy("doc_id", "page").agg(F.collect_list(F.struct("layer", "n", "part")).alias("ls"))  # a page's lines
    told = "size(array_distinct(transform(filter(ls, x -> x.layer = 0), x -> x.n))) = size(filter(ls, x -> x.layer = 0))"
    words = "flatten(transform(ls, x -> transform(if(x.layer = 0, split(x.part, ' ', -1), array(x.part)), (w, i) -> named_struct('layer', x.layer, 'n', x.n, 'i', i, 'part', w))))"
    return rows.select("doc_id", "page", F.expr(f"array_join(if({told}, transform(array_sort(ls), x -> x.part), transform(array_sort({words}), x -> x.part)), ' ')").alias("content"))


def size_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """vdoc, bytes_before, bytes_after, smaller: by the lines' bytes; a document that is gone counts as 0."""
    size = lambda df, name: df.groupBy("vdoc").agg(F.sum(F.octet_length("line")).alias(name))
    both = size(before, "bytes_before").join(size(after, "bytes_after"), "vdoc", "full_outer")
    a, b = F.coalesce("bytes_before", F.lit(0)), F.coalesce("bytes_after", F.lit(0))
    return both.select("vdoc", a.alias("bytes_before"), b.alias("bytes_after"), (b < a).alias("smaller"))
