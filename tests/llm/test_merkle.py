"""Merkle manifests against trees that are built plainly."""

import hashlib
import random
import zlib

import pytest

from quire.llm.merkle import leaf_places, manifest

from .helpers import key

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for nodes in tree[:-1]:
        s = i // 16 * 16
        yield "".join(nodes[s:i]), "".join(nodes[i + 1 : s + 16])
        i //= 16


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order, out = sorted(by, key=lambda s: (s is not None, (s or "").encode())), []
    trees = [levels([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in order]
    top = levels([t[-1][0] for t in trees])
    for i, k in enumerate(order):
        for j, (_, _, own, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            path = [*siblings(trees[i], j), *siblings(top, i)]
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in path:
                node = digest(left + node + right)
            out.append((r[0], own, trees[i][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=key)


def hard():
    """Nulls in every column, ties, repeated rows, far and negative ids, a source with most rows, more sources than one run, a very long text."""
    rng = random.Random(1)
    rows = [(None,) * 5, (None, None, None, None, "x"), (3, "", None, 1, "A"), (3, "", None, 1, "A"), (3, "", None, 1, "B"), (-5, "é", "en", 2, "Zz"), (1 << 62, "é", "en", 2, "İÀ"), (8, "é", "en", 2, "Long " * 200_000), (9, "é", "en", 0, "")]
    rows += [(rng.choice([i, i * 7919 - 100_000, None, 17]), rng.choice(["a", "b", "hot", "hot", "hot", None]), "en", i, f"T{i % 900}") for i in range(1500)]
    return rows + [(i * 3, f"s{i:03}", "en", i, "Some") for i in range(300)]


def test_equals_plain_trees(spark):
    rows = hard()
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("k", "p", "n", "h", "g", "id", "leaf", "root", "path"):  # names that the operator uses
        df = df.selectExpr("*", f"'x' AS {c}")
    assert sorted(map(tuple, manifest(df).collect()), key=key) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_sizes(spark, n):
    rows = [(i, "one", "en", 1, f"Text {i}") for i in range(n)]
    assert sorted(map(tuple, manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=key) == plain(rows)


def test_a_tampered_text_does_not_verify(spark):
    rows = [(i, f"s{i % 3}", "en", 1, t) for i in range(60) for t in ("Upper", "lower", None)]
    found = manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(not r.verified for r in found) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60))


def test_places_of_one_id_with_very_many_rows(spark):
    rows = [(bytearray(b"a"), None if i % 3 else 5, digest(str(i // 2))) for i in range(600)]
    found = leaf_places(spark.createDataFrame(rows, "k binary, id long, leaf string")).collect()
    want = sorted(((r[1] is not None, r[1] or 0, r[2]) for r in rows))
    assert sorted((r.p, r.id, r.leaf) for r in found) == [(p, 5 if there else None, h) for p, (there, _, h) in enumerate(want)]
