"""Near duplicates against all pairs by brute force; sketches against what they estimate."""

import numpy as np
import pytest

from quire.llm.graph import components
from quire.llm.near_duplicates import BANDS, REGISTERS, band_values, estimate, from_bytes, near_duplicates, set_sketch, shingles, to_bytes, words

from .helpers import hard, key


def brute(rows, size):
    """(doc_id, n_shingles, component, kept) of each row; rows that share a doc_id are one document."""
    sets = [(i, shingles(words(t), size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[k + 1 :]:
            n = len(x & y)
            if i is not None and j is not None and x and y and 100 * n >= 80 * (len(x) + len(y) - n):
                u, v = sorted((find(i), find(j)))
                parent[v] = u
    return sorted(((i, len(x), (find(i) if x else i) if i is not None else None, i is None or (find(i) if x else i) == i) for i, x in sets), key=key)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for n, share in [(2000, 0.8), (2000, 0.5), (300, 0.9), (40, 0.8)]:
        found, equal = [], []
        for _ in range(12):
            union = rng.integers(0, 2**64, n, dtype=np.uint64)
            common = int(share * n)
            rest = (n - common) // 2
            a, b = union[: common + rest], np.concatenate([union[:common], union[common + rest :]])
            ra, rb = set_sketch(np.unique(a)), set_sketch(np.unique(b))
            assert (np.maximum(ra, rb) == set_sketch(np.unique(union))).all()
            found.append(estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0])
            equal.append((band_values(ra) == band_values(rb)).sum())
        assert abs(np.mean(found) - share) < 0.03
        assert np.mean(equal) == pytest.approx(BANDS * share**6, rel=0.5)
    assert set_sketch(np.zeros(0, np.uint64)).shape == (REGISTERS,)
    assert (from_bytes([to_bytes(ra), to_bytes(rb)]) == np.stack([ra, rb])).all()


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(spark, size):
    rng = np.random.default_rng(size)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(8)]
    rows = []
    for i in range(120):
        tokens = base[i % 8].split()
        for _ in range(int(rng.integers(0, 7))):
            tokens[int(rng.integers(60))] = f"z{rng.integers(10**6)}"
        rows.append((i, " ".join(tokens).upper() if i % 3 else "\n".join(tokens)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "two one"), (207, "a\x1cb c"), (208, "a b c"), (209, "word " * 9000), (210, "word " * 8000), (0, rows[0][1]), (211, "İa b"), (212, "x" * 5000)]
    rows += [(300, base[0]), (300, base[1]), (301, base[1])]  # one doc_id with two texts
    got = sorted((tuple(r) for r in near_duplicates(hard(spark, rows), size).collect()), key=key)
    assert got == brute(rows, size)


def test_a_large_group_and_many_that_just_miss(spark):
    tokens = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join([*tokens[:-1], f"v{i}"])) for i in range(120)]  # all linked
    rows += [(1000 + i, " ".join([*[f"u{k}" for k in range(40)], *[f"q{i}_{k}" for k in range(6)]])) for i in range(60)]  # 39 of 51: none linked
    assert sorted((tuple(r) for r in near_duplicates(hard(spark, rows), 2).collect()), key=key) == brute(rows, 2)


def test_a_shingle_of_many_keys(spark, monkeypatch):
    """The same pairs, whether one key or many hold the texts of a shingle."""
    from quire.llm import near_duplicates as N

    texts = spark.createDataFrame([(i, f"a b c {'d' if i % 2 else 'e'} w{i % 7} x{i % 5}", i % 6) for i in range(60)], "rep long, text string, component long")
    one = sorted(map(tuple, N.prefix_pairs(texts, 2, 50).collect()))
    monkeypatch.setattr(N, "_SALTED", 3)
    assert one and sorted(map(tuple, N.prefix_pairs(texts, 2, 50).collect())) == one


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f")]
    assert sorted((tuple(r) for r in near_duplicates(hard(spark, rows)).collect()), key=key) == sorted([(None, 2, None, True), (None, 2, None, True), (4, 2, 4, True), (5, 2, 4, False)], key=key)
    assert near_duplicates(hard(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7), (5, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
