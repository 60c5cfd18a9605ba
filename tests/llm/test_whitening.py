"""Whitened embeddings against numpy over the whole table."""

import math

import numpy as np
import pytest

from quire.llm.queries import op13_multiplicity_whitening
from quire.llm.whitening import whiten

SF = "/root/testdata/sf0.01"


def plain(rows, components=4, weighted=False):
    """(vec_id, component) -> (n, deviation, whitened, explained) for vectors of one length; each distinct vector counts once, or as often as it stands there."""
    keep = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fitted = np.array([x for _, x in keep] if weighted else sorted({x for _, x in keep}), dtype=object)
    n, sums = len(fitted), fitted.sum(axis=0)
    x = fitted.astype(float) - (sums / n).astype(float)
    cov = x.T @ x / n
    values, vectors = np.linalg.eigh(cov)
    out = []
    for i, v in keep:
        away = n * np.array(v, dtype=object) - sums
        for k in range(components):
            e = values[-1 - k]
            out.append((i, k + 1, n, int((away * away).sum()), float((away / n).astype(float) @ vectors[:, -1 - k] / math.sqrt(e)), e / np.trace(cov)))
    return out


def same(found, want):
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    assert len(found) == len(want)
    for i, k, n, far, w, share in want:
        r = got[i, k].pop()
        assert (r.n, r.deviation) == (n, far) and math.isclose(r.explained, share, rel_tol=1e-6) and r.identity_error <= 1e-8
        if abs(w) > 1e-3:
            signs.setdefault(k, np.sign(w * r.whitened))
        assert abs(r.whitened - signs.get(k, 1) * w) < 1e-8


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(op13_multiplicity_whitening(spark, SF).collect(), plain(rows))


@pytest.mark.parametrize("weighted", [False, True])
def test_copies_and_bad_vectors(spark, weighted):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(80)] + [(100 + i, [0.5, 1.0, -1.0, 0.0, 0.25, 2.0]) for i in range(60)]
    bad = [(1000, None), (1001, []), (1002, [1.0, None, 1.0]), (1003, [1.0, float("nan")]), (1004, [1.0, float("inf")])]
    twice = [(207, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows + bad + twice, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "'n' AS n", "2 AS weight", "0 AS w")
    same(whiten(df, weighted=weighted).collect(), plain(rows + twice, weighted=weighted))


def test_grid_rounds_down_and_merges(spark):
    rows = [(1, [0.0]), (2, [-0.0]), (3, [0.0039]), (4, [-0.001]), (5, [3.0])]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.n for r in found} == {3} and len({r.whitened for r in found if r.vec_id < 4}) == 1 and {r.component for r in found} == {1}


def test_no_variance_other_lengths_and_empty(spark):
    shape = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape)).collect() == []
    empty = whiten(spark.createDataFrame([], shape))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    mixed = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [4.0, 3.0]), (3, [1.0]), (4, [5.0]), (5, [9.0])], shape)).collect()
    assert sorted((r.vec_id, r.n) for r in mixed) == [(1, 2), (2, 2), (3, 3), (4, 3), (5, 3)]


def test_far_entries(spark):
    found = whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [2e15, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and all(r.deviation is None and r.identity_error < 1e-4 for r in found if r.component == 1)
