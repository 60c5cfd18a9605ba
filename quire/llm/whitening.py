"""Whitening of embeddings by principal components, fitted on distinct vectors.

A vector's entries are put on a grid of 1/256, so equal vectors are equal whole numbers: they are grouped, and the fit counts each distinct one once, or
as often as it stands in the table. Sums and covariances are made per task from matrices of a bounded number of rows, centred before they are multiplied,
and added up by row of the matrix. Each distinct vector is whitened once; the rows get the results by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

GRID = 256
_FAR = 1 << 40  # entries beyond it can't be multiplied in 64 bits


def grid(vector: Column) -> Column:
    """floor(256 c) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, weights, places in the batch) of each length of vector in a batch of x, weight."""
    lists = batch["x"]
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    weights = batch["weight"].to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield flat[starts[at][:, None] + np.arange(d)], weights[at], at


def _add(total: dict, key: int, value: np.ndarray) -> None:
    total[key] = total[key] + value if key in total else value


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for x, w, _ in _matrix(batch):
            # Whole numbers of any size: Python's for far entries, else 64 bits.
            x = x.astype(object) if np.abs(x.astype(float)).max(initial=0) > _FAR / max(1, len(x)) / max(1, int(w.max(initial=1))) else x
            _add(total, x.shape[1], np.concatenate([[int(w.sum())], (x * w[:, None]).sum(axis=0)]).astype(object))
    for d, s in total.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * (d + 1), pa.int64()), "i": pa.array(range(-1, d), pa.int64()), "s": pa.array([str(v) for v in s])})


def _products(means: dict[int, np.ndarray]):
    """Rows of the weighted sums of products of centred entries, one matrix for each length of vector in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for x, w, _ in _matrix(batch):
                c = x - means[x.shape[1]]
                _add(total, x.shape[1], (c * w[:, None]).T @ c)
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * d, pa.int64()), "i": pa.array(range(d), pa.int64()), "row": pa.array([r.tobytes() for r in m], pa.binary())})

    return run


def _row_sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch["row"]:
            one = np.frombuffer(row.as_py())
            total = one if total is None else total + one
    yield pa.RecordBatch.from_pydict({"dim": [key[0].as_py()], "i": [key[1].as_py()], "row": pa.array([total.tobytes()], pa.binary())})


class Fit:
    """Of one length of vector: n, the sums S, unit components by falling eigenvalue, their eigenvalues and the share of the trace that each explains."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        keep = [k for k in range(min(components, len(values))) if values[k] > 1e-12 * max(values[0], 0)]
        self.values, self.vectors = values[keep], vectors[:, keep]
        self.explained = self.values / np.trace(covariance) if keep else self.values


def fit(distinct: DataFrame, components: int = 4) -> dict[int, Fit]:
    """A fit for each length of vector in distinct(x, weight). The driver holds one matrix of a length's side at a time, and its components."""
    parts = distinct.mapInArrow(_sums, "dim long, i long, s string").groupBy("dim", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums: dict[int, dict[int, int]] = {}
    for r in parts.collect():  # one row for each place of a vector
        sums.setdefault(r.dim, {})[r.i] = int(r.s)
    means = {d: np.array([s[i] / s[-1] for i in range(d)]) for d, s in sums.items()}
    rows = distinct.mapInArrow(_products(means), "dim long, i long, row binary").groupBy("dim", "i").applyInArrow(_row_sum, "dim long, i long, row binary")
    rows = materialise(rows, "covariance")
    found = {}
    for d, s in sums.items():
        matrix = np.zeros((d, d))
        for r in rows.where(F.col("dim") == d).collect():
            matrix[r.i] = np.frombuffer(r.row)
        found[d] = Fit(s[-1], [s[i] for i in range(d)], matrix / s[-1], components)
    return found


def _whitened(fits: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, white = [None] * batch.num_rows, [None] * batch.num_rows
            for x, _, at in _matrix(batch):
                f = fits[x.shape[1]]
                most = f.n * np.abs(x.astype(float)).max(initial=0) + max(map(abs, f.sums))
                exact = np.int64 if most * most * x.shape[1] < 1 << 62 else object  # 64 bits where the squares' sum surely fits, else Python's numbers
                away = f.n * x.astype(exact) - np.array(f.sums, exact)
                w = ((away / f.n).astype(float) @ f.vectors) / np.sqrt(f.values)
                for i, v, r in zip(at.tolist(), (away * away).sum(axis=1).tolist(), w.tolist(), strict=True):
                    far[i], white[i] = v if v < 1 << 63 else None, r
            yield pa.RecordBatch.from_arrays([batch["x"], batch["weight"], pa.array(far, pa.int64()), pa.array(white, pa.list_(pa.float64()))], names=["x", "weight", "deviation", "w"])

    return run


def _identity_errors(white: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """By length: the largest absolute entry of the covariance of the whitened vectors less the identity, over the fit list as it is weighted."""
    worst = {}
    for d, f in fits.items():
        k, rows = len(f.values), white.where(F.size("x") == d)
        if not k:
            continue
        w, n = [F.col("w")[i] for i in range(k)], F.sum("weight")
        mean = rows.agg(*[(F.sum(c * F.col("weight")) / n).alias(f"m{i}") for i, c in enumerate(w)]).first()
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = rows.agg(*[(F.sum((w[i] - mean[i]) * (w[j] - mean[j]) * F.col("weight")) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
        worst[d] = max(abs(got[at] - (i == j)) for at, (i, j) in enumerate(pairs))
    return worst


def whiten(rows: DataFrame, components: int = 4, weighted: bool = False) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of rows(vec_id, embedding) and component.

    Rows whose vector is null, empty, or holds an entry that is null or not finite are dropped. weighted: a vector counts in the fit as often as it stands
    in the table, else once. Vectors of another length are a population of their own, with a fit of its own. A component with no variance (all vectors equal,
    fewer distinct ones than components) has no rows. deviation is null beyond 64 bits. Null and repeated vec_ids each come back; other columns are
    not read.
    """
    placed = materialise(rows.where(usable(F.col("embedding"))).select("vec_id", grid(F.col("embedding")).alias("x")), "vectors")
    count = F.count("*") if weighted else F.lit(1).cast("long")
    distinct = materialise(placed.groupBy("x").agg(count.alias("weight")), "distinct")
    fits = fit(distinct, components)
    white = materialise(distinct.mapInArrow(_whitened(fits), "x array<long>, weight long, deviation long, w array<double>"), "whitened")
    errors = _identity_errors(white, fits)
    explained = F.create_map(*[F.lit(v) for d, f in fits.items() for v in (d, f.explained.tolist())]) if fits else F.lit(None).cast("map<int,array<double>>")
    number = F.create_map(*[F.lit(v) for d, f in fits.items() for v in (d, f.n)]) if fits else F.lit(None).cast("map<int,long>")
    error = F.create_map(*[F.lit(v) for d, e in errors.items() for v in (d, e)]) if errors else F.lit(None).cast("map<int,double>")
    size = F.size("x")
    each = white.select("x", "deviation", "w", number[size].cast("long").alias("n"), explained[size].alias("e"), error[size].cast("double").alias("identity_error"))
    out = placed.join(each, "x").select("vec_id", "n", "deviation", "identity_error", "e", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("e")[F.col("at")].alias("explained"), "identity_error")
