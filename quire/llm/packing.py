"""Packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt to shards of bounded size; each shard is evolved on several islands, each a population of whole packings.
Crossover injects well-filled bins of one parent into the other, removes bins that hold a piece twice, and best-fits the
displaced pieces. After each epoch an island's elite goes to the next island of its shard. The emptiest bins of all shards
are then dissolved and packed again together, in groups of shards.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_slices
from .encoding import ENTRIES, default_tokenizer, encoder


def token_pieces(docs: DataFrame, limit: int = 4096, tokenizer: str | None = None, end_id: int = 1, cache_entries: int = ENTRIES, slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of docs(doc_id, text): ids, then end_id, cut at `limit`.

    Null and empty texts give one piece that holds end_id alone; repeated rows give pieces of their own. A worker keeps the ids of so many
    chunks and encodes so many bytes at once: less of either takes less memory and more time, for the same pieces.
    """
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                ids, sizes = encoder(tokenizer, cache_entries).encode(part["text"])
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                names, rows = part["doc_id"].to_pylist(), []
                for doc_id, size in zip(names, sizes.tolist(), strict=True):
                    for k, start in enumerate(range(0, size + 1, limit)):
                        stop = min(start + limit, size + 1)
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + min(stop, size))])
                        rows.append((doc_id, k, start, stop - start, zlib.crc32(end, crc) if stop > size else crc))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, items, free: list[int], limit: int, bins: np.ndarray) -> None:
    """Put each item into the fullest bin that still takes it, or a new one; bins[item] is set and free (room by bin) updated."""
    order = sorted((room, k) for k, room in enumerate(free) if room)
    for item in items:
        size = int(sizes[item])
        at = bisect.bisect_left(order, (size, -1))
        if at < len(order):
            room, k = order.pop(at)
        else:
            room, k = limit, len(free)
            free.append(limit)
        bins[item] = k
        free[k] = room - size
        if room > size:
            bisect.insort(order, (room - size, k))


def _fitness(sizes: np.ndarray, bins: np.ndarray, limit: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones (Falkenauer's mean square fill)."""
    fill = np.bincount(bins, weights=sizes)
    return -len(fill), float(((fill / limit) ** 2).mean())


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """A child: some of the father's best-filled bins whole, the mother's bins that share no piece with them, the rest best-fitted."""
    fill = np.bincount(father, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = rng.choice(good, max(1, len(good) // 2), replace=False)
    injected = np.isin(father, chosen)
    broken = np.zeros(int(mother.max()) + 1, bool)
    broken[mother[injected]] = True
    kept = ~injected & ~broken[mother]
    child = np.full(len(sizes), -1, np.int64)
    child[injected] = np.unique(father[injected], return_inverse=True)[1]
    first = len(chosen)
    child[kept] = first + np.unique(mother[kept], return_inverse=True)[1]
    count = int(child.max()) + 1
    free = (limit - np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=count).astype(np.int64)).tolist()
    loose = np.flatnonzero(child < 0)
    best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")].tolist(), free, limit, child)
    return child


def mutate(sizes: np.ndarray, bins: np.ndarray, limit: int, rng: np.random.Generator, share: float = 0.1) -> np.ndarray:
    """Dissolve the emptiest bin and some others at random, and best-fit their pieces again in random order of near-equal size."""
    fill = np.bincount(bins, weights=sizes)
    gone = np.zeros(len(fill), bool)
    gone[rng.choice(len(fill), max(1, int(share * len(fill))), replace=False)] = True
    gone[fill.argmin()] = True
    child = np.full(len(sizes), -1, np.int64)
    kept = ~gone[bins]
    if kept.any():
        child[kept] = np.unique(bins[kept], return_inverse=True)[1]
    free = (limit - np.bincount(child[kept], weights=sizes[kept]).astype(np.int64)).tolist() if kept.any() else []
    loose = np.flatnonzero(child < 0)
    best_fit(sizes, loose[np.argsort(-(sizes[loose] * rng.uniform(0.95, 1.05, len(loose))), kind="stable")].tolist(), free, limit, child)
    return child


def evolve(sizes: np.ndarray, elite: list[np.ndarray], limit: int, seed: int, population: int, generations: int) -> np.ndarray:
    """The best packing of one island after some generations. It stops early at the lower bound, which nothing can beat."""
    rng = np.random.default_rng(seed)
    if not len(sizes):
        return np.zeros(0, np.int64)
    least = -(-int(sizes.sum()) // limit)
    people = list(elite)
    while len(people) < population:
        noise = np.ones(len(sizes)) if not people else rng.uniform(0.9, 1.1, len(sizes))
        bins = np.full(len(sizes), -1, np.int64)
        best_fit(sizes, np.argsort(-(sizes * noise), kind="stable").tolist(), [], limit, bins)
        people.append(bins)
        if int(bins.max()) + 1 == least:
            return bins
    scored = sorted(((_fitness(sizes, p, limit), k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    for step in range(generations):
        if -scored[0][0][0] == least:
            break
        a, b = (scored[int(rng.integers(0, max(1, len(scored) // 2)))][2] for _ in range(2))
        child = crossover(sizes, a, scored[int(rng.integers(len(scored)))][2], limit, rng)
        for new in (child, mutate(sizes, b, limit, rng)):
            scored.append((_fitness(sizes, new, limit), population + 2 * step, new))
        scored = sorted(scored, key=lambda x: x[:2], reverse=True)[:population]
    return scored[0][2]


def _islands(groups: DataFrame, limit: int, islands: int, epochs: int, population: int, generations: int, label: str) -> DataFrame:
    """groups(shard, sizes) -> shard, sizes, bins: the best island's packing of each shard."""
    schema = "shard long, island int, sizes array<int>, elite array<array<int>>"
    state = groups.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.array().cast("array<array<int>>").alias("elite"))

    for epoch in range(epochs):
        def run(frames, epoch=epoch):
            for frame in frames:
                out = []
                for shard, island, sizes, elite in frame.itertuples(index=False):
                    best = evolve(np.asarray(sizes, np.int64), [np.asarray(x, np.int64) for x in elite], limit, hash((int(shard), int(island), epoch)) & 0xFFFFFFFF, population, generations)
                    out.append((shard, island, sizes, [best.astype(np.int32)]))
                yield pd.DataFrame(out, columns=["shard", "island", "sizes", "elite"])

        state = materialise(state.mapInPandas(run, schema), f"{label}-epoch{epoch}")
        if epoch + 1 < epochs:  # an island starts again from its own best and its neighbour's
            guests = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("guest"))
            state = state.join(guests, ["shard", "island"]).select("shard", "island", "sizes", F.concat("elite", "guest").alias("elite"))
    best = state.groupBy("shard").agg(F.min(F.struct(F.array_max(F.col("elite")[0]).alias("last"), "island")).alias("win"))
    return state.join(best, "shard").where(F.col("island") == F.col("win.island")).select("shard", "sizes", F.col("elite")[0].alias("bins"))


def pack(pieces: DataFrame, limit: int = 4096, shard_size: int = 8192, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 6, shards_per_group: int = 256) -> DataFrame:
    """Add sequence_id and offset to pieces(length, ...): sequences hold at most `limit` tokens, gapless from 0.

    All columns of `pieces` come back; its own sequence_id and offset are replaced. A piece longer than `limit` or shorter than 1 (or null) is an error. Empty input gives an empty
    result. A shard is a bounded array of lengths, whatever the table's size.
    """
    checked = F.when(F.col("length").between(1, limit), F.col("length")).otherwise(F.raise_error(F.lit(f"a piece's length is not in 1..{limit}")).cast("long"))
    every = materialise(pieces.drop("sequence_id", "offset").withColumns({"length": checked, "_quire_row": F.monotonically_increasing_id()}), "pieces")
    whole = every.where(F.col("length") == limit).withColumns({"sequence_id": -1 - F.col("_quire_row"), "offset": F.lit(0).cast("long")}).drop("_quire_row")
    # What is packed is known by its number alone; the pieces' own columns are joined in the end.
    rows = every.select(F.col("_quire_row").alias("row"), "length")
    loose = rows.where(F.col("length") < limit)
    shards = max(1, -(-loose.count() // shard_size))
    loose = materialise(loose.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))), "dealt")

    def packed(parts: DataFrame, label: str) -> DataFrame:
        """parts(shard, row, length) -> shard, row, length, bin."""
        groups = parts.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), "row")), asc=False).alias("items"))
        groups = materialise(groups, f"{label}-groups")
        best = _islands(groups.select("shard", F.col("items.length").alias("sizes")), limit, islands, epochs, population, generations, label)
        joined = groups.join(best.select("shard", "bins"), "shard")
        return joined.select("shard", F.explode(F.arrays_zip(F.col("items.row").alias("row"), F.col("items.length").alias("length"), F.col("bins").alias("bin"))).alias("x")).select("shard", "x.row", F.col("x.length").cast("long").alias("length"), F.col("x.bin").cast("long").alias("bin"))

    first = materialise(packed(loose.select("shard", "row", "length"), "first"), "first")
    if shards > 1:
        fill = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
        worst = fill.groupBy("shard").agg(F.min(F.struct("fill", "bin")).alias("x")).select("shard", F.col("x.bin").alias("bin"))
        again = first.join(worst, ["shard", "bin"], "left_semi").select(F.expr(f"shard div {shards_per_group}").alias("shard"), "row", "length")
        second = packed(again, "second").withColumn("shard", -1 - F.col("shard"))
        first = first.join(worst, ["shard", "bin"], "left_anti").unionByName(second)
    placed = first.groupBy("shard", "bin").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("items"))
    ends = F.expr("transform(items, (x, i) -> struct(x.row AS row, aggregate(slice(items, 1, i), 0L, (a, y) -> a + y.length) AS offset))")
    placed = placed.select((F.shiftleft("shard", 24) + F.col("bin")).alias("sequence_id"), F.explode(ends).alias("x")).select("sequence_id", F.col("x.row").alias("row"), F.col("x.offset").alias("offset"))
    placed = placed.withColumn("sequence_id", F.when(F.col("sequence_id") < 0, F.col("sequence_id") - (1 << 62)).otherwise(F.col("sequence_id")))
    placed = placed.withColumnRenamed("row", "_quire_row")
    return every.where(F.col("length") < limit).join(placed, "_quire_row").drop("_quire_row").unionByName(whole)
