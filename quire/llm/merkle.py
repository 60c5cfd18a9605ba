"""Merkle trees over documents: a tree for each source, one over the sources, and a proof for each document.

Leaf coordinates come from bitmaps: each source's doc_ids are set bits of 64-bit words, merged over all tasks before and after the shuffle; only
words with a bit are kept. Up to 64 words, of 4,096 ids, are a container with the running counts of its words; a radix directory
(`quire.operators.ranks`) holds the running counts of containers. A leaf's place is what the directories and the bits below its own say: leaves are never sorted.
From then on a node's place names its run and slot, and levels are reduced two at a time: 256 nodes are one array. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ranks import numbered, prefix_sums

from .common import LOWER, UPPER, materialise

FANOUT = 16
_GROUP = FANOUT * FANOUT
_PATH = "array<struct<l:string,r:string>>"


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Lowercase hex sha256 of the five values, each its UTF-8 byte count, a colon and itself, or - where it is null."""
    parts = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def _containers(leaves: DataFrame) -> DataFrame:
    """k, hi, words(w, bits, n, before): the words of a container in order, with how many rows the words before hold; n, rows of the container."""
    words = leaves.groupBy("k", "hi", "w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"), F.count("*").alias("n"))
    rows = words.groupBy("k", "hi").agg(F.array_sort(F.collect_list(F.struct("w", "bits", "n"))).alias("ws"), F.sum("n").alias("n"))
    running = "aggregate(ws, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x.n)))"  # 64 words at most
    return rows.select("k", "hi", "n", F.expr(f"zip_with(ws, slice({running}, 1, size(ws)), (x, s) -> named_struct('w', x.w, 'bits', x.bits, 'n', x.n, 'before', s))").alias("words"))


def leaf_places(leaves: DataFrame) -> DataFrame:
    """leaves(k, id, leaf, ...) with p, a leaf's place among those of its k by id, and n, how many there are.

    Null ids come first. Rows that share an id are in order of their digests; such ids alone are counted one by one.
    """
    number = F.col("id").cast("long")
    keyed = leaves.withColumns({"hi": F.coalesce(F.shiftright(number, 12), F.lit(-(1 << 60))), "w": F.coalesce(F.shiftright(number, 6).bitwiseAND(63), F.lit(0)).cast("int"), "b": F.coalesce(number.bitwiseAND(63), F.lit(0)).cast("int")})
    made = materialise(_containers(keyed), "containers")
    # Where a word holds more rows than bits, some of its ids are held by several rows.
    crowded = made.select("k", "hi", F.explode("words").alias("x")).where("x.n > bit_count(x.bits)").select("k", "hi", F.col("x.w").alias("w"))
    placed = prefix_sums(made, ["k"], F.col("hi"), "start", F.col("n"), levels=3)
    total = placed.groupBy("k").agg(F.sum("n").alias("total"))
    directory = placed.join(total, "k").select("k", "hi", "words", "start", "total")
    rows = keyed.join(directory, ["k", "hi"])
    word = "element_at(filter(words, x -> x.w = w), 1)"
    rows = rows.withColumn("x", F.expr(word)).withColumn("p", F.expr("start + x.before + bit_count(shiftleft(x.bits, 63 - b)) - 1")).withColumnRenamed("total", "n")
    rows = rows.drop("words", "start", "x")
    if not crowded.isEmpty():
        ids = keyed.join(crowded, ["k", "hi", "w"], "left_semi").groupBy("k", "hi", "w", "b").agg((F.count("*") - 1).alias("more")).where("more > 0")
        more = ids.groupBy("k", "hi", "w").agg(F.collect_list(F.struct("b", "more")).alias("several"))  # ids of one word: 64 at most
        rows = rows.join(more, ["k", "hi", "w"], "left")
        rows = rows.withColumn("p", F.expr("p + coalesce(aggregate(filter(several, s -> s.b < b), 0L, (a, s) -> a + s.more), 0L)"))
        tied = F.expr("coalesce(exists(several, s -> s.b = b), false)")
        # Rows of one id by digest, dealt by its first digits, so that an id with very many rows is many stretches.
        some = prefix_sums(rows.where(tied), ["k", "hi", "w", "b"], F.conv(F.substring("leaf", 1, 12), 16, 10).cast("long"), "over", ties=[F.col("leaf")], levels=2)
        rows = rows.where(~tied).drop("several").unionByName(some.withColumn("p", F.col("p") + F.col("over")).drop("over", "several"))
    return rows.drop("hi", "w", "b")


def _grouped(nodes: DataFrame, *carried: str) -> DataFrame:
    """k, g, n, items(p, h, ...) in order, h (their digests), up (the digests one level up), node (the group's digest) from nodes(k, p, n, h, ...)."""
    rows = nodes.groupBy("k", F.shiftright("p", 8).alias("g")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "h", *carried))).alias("items"))
    rows = rows.withColumn("h", F.expr("transform(items, x -> x.h)"))
    rows = rows.withColumn("up", F.expr(f"transform(sequence(0, (size(h) - 1) div {FANOUT}), i -> sha2(array_join(slice(h, i * {FANOUT} + 1, {FANOUT}), ''), 256))"))
    return rows.withColumn("node", F.when(F.col("n") == 1, F.col("h")[0]).when(F.col("n") <= FANOUT, F.col("up")[0]).otherwise(F.sha2(F.array_join("up", ""), 256)))


def _own_path(j: str) -> str:
    """SQL: the siblings, left and right, of item j of a group, by level; a level that its tree does not have is left out."""
    beside = f"named_struct('l', array_join(slice(h, {j} div {FANOUT} * {FANOUT} + 1, {j} % {FANOUT}), ''), 'r', array_join(slice(h, {j} + 2, {FANOUT - 1} - {j} % {FANOUT}), ''))"
    above = f"named_struct('l', array_join(slice(up, 1, {j} div {FANOUT}), ''), 'r', array_join(slice(up, {j} div {FANOUT} + 2, {FANOUT - 1} - {j} div {FANOUT}), ''))"
    return f"CASE WHEN n = 1 THEN cast(array() AS {_PATH}) WHEN n <= {FANOUT} THEN array({beside}) ELSE array({beside}, {above}) END"


def _tree(nodes: DataFrame, largest: int, *carried: str) -> list[DataFrame]:
    """The groups of nodes(k, p, n, h), those of their nodes, and so on, until each k has one; `largest` is the greatest n."""
    groups = [materialise(_grouped(nodes, *carried), "merkle")]
    while largest > _GROUP:
        largest = -(-largest // _GROUP)
        up = groups[-1].select("k", F.col("g").alias("p"), F.ceil(F.col("n") / _GROUP).cast("long").alias("n"), F.col("node").alias("h"))
        groups.append(materialise(_grouped(up), "merkle"))
    return groups


def _paths(groups: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest groups with path, what lies above each of them: top(k, path) and the levels between."""
    above = groups[-1].join(top, "k")
    for lower in reversed(groups[:-1]):
        items = above.select("k", F.expr(f"transform(items, (x, j) -> named_struct('g', x.p, 'path', concat({_own_path('j')}, path)))").alias("items"))
        above = lower.join(items.select("k", F.explode("items").alias("x")).select("k", "x.g", "x.path"), ["k", "g"])
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs(doc_id, source, lang, n_chars, text).

    A source's leaves ascend by doc_id, null first, rows of one doc_id by their digests (equal rows are leaves of their own). Where 5 divides the
    unsigned crc32 of doc_id, the text's A-Z are lower-cased and the root is folded from that leaf and the original siblings; null doc_ids and null
    texts stay as they are. Sources are ordered null first, then by their bytes. An empty table gives an empty one. Other columns are not read.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.when((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & F.col("text").rlike("[A-Z]"), leaf_digest(*own, F.translate("text", UPPER, LOWER)))
    key = F.when(F.col("source").isNull(), F.lit(bytearray(b"\x00"))).otherwise(F.concat(F.lit(bytearray(b"\x01")), F.col("source").cast("binary")))
    leaves = materialise(docs.select(key.alias("k"), F.col("doc_id").alias("id"), leaf_digest(*own, F.col("text")).alias("leaf"), lowered.alias("changed")), "leaves")
    placed = leaf_places(leaves).withColumnRenamed("leaf", "h")
    largest = leaves.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    groups = _tree(placed, largest, "id", "changed")
    subroots = numbered(groups[-1].select("k", F.col("node").alias("subroot")), [F.col("k").asc()], "p")
    sources = materialise(subroots, "subroots")
    n = sources.count()
    over = _tree(sources.select(F.lit(0).alias("k"), "p", F.lit(n).cast("long").alias("n"), F.col("subroot").alias("h")), n)
    root = over[-1].select("node").first()
    root = root[0] if root else None
    ends = sources.sparkSession.range(1).select(F.lit(0).alias("k"), F.expr(f"cast(array() AS {_PATH})").alias("path"))
    reached = _paths(over, F.broadcast(ends)).select(F.explode(F.expr(f"transform(items, (x, j) -> named_struct('p', x.p, 'path', concat({_own_path('j')}, path)))")).alias("x"))
    top = sources.join(reached.select("x.p", "x.path"), "p").select("k", "path", "subroot")
    low = _paths(groups, top.select("k", "path")).join(top.select("k", "subroot"), "k")
    one = f"named_struct('doc_id', x.id, 'leaf', x.h, 'changed', x.changed, 'path', concat({_own_path('j')}, path))"
    rows = low.select("subroot", F.explode(F.expr(f"transform(items, (x, j) -> {one})")).alias("x")).select("subroot", "x.*")
    proof = F.expr("sha2(array_join(transform(path, x -> concat(x.l, x.r)), ''), 256)")
    folded = F.expr("aggregate(path, coalesce(changed, leaf), (t, x) -> sha2(concat(x.l, t, x.r), 256))")
    out = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
