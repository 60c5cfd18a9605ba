"""Edit matching against plain edit distance."""

import random

from quire.llm.decontaminate import ItemBlock, contaminated, myers, plain

from .helpers import hard


def slow(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        last, row[0] = row[:], i + 1
        for j, d in enumerate(text):
            row[j + 1] = min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1)
    return min(row)


def test_myers_is_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        t = "".join(rng.choices("abc ", k=rng.randint(0, 120)))
        got, want = myers(p, t, len(p)), slow(p, t)
        assert (got[0] if got else None) == (want if t else None) or (not t and want == len(p))
        cut = myers(p, t, want - 1) if want else None
        assert cut is None


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = "q"
        elif kind == 1:
            s.insert(at, "z")
        else:
            del s[at]
    return "".join(s)


def test_all_copies_within_budget_are_found_and_no_others():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(30)]
    block = ItemBlock(items, 0.1, 12)
    for i, item in items:
        budget = min(int(0.1 * len(item)), len(item) // 12 - 1)
        for n in (0, 1, budget, budget + 1, 2 * budget + 4):
            text = plain(" ".join(word() for _ in range(60)) + " " + edited(rng, item, n) + " " + " ".join(word() for _ in range(60)))
            got = dict(block.find(text))
            want = {k: d for k, t in items if (d := slow(t, text)) <= min(int(0.1 * len(t)), len(t) // 12 - 1)}
            assert got == want


def test_the_whole_budget_is_used():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(2, 40)))) for i in range(10)]
    block, met = ItemBlock(items, 0.1), 0
    for i, item in items:
        budget = int(0.1 * len(item))
        spread = list(item)
        for e in range(budget):  # edits as evenly as they can lie
            spread[len(item) * (2 * e + 1) // (2 * budget)] = "q"
        for middle in ("".join(spread), edited(rng, item, budget), edited(rng, item, budget + 1)):
            for before, after in ((8, 8), (0, 8)):
                text = plain(" ".join([*(word() for _ in range(before)), middle, *(word() for _ in range(after))]))
                want = {k: d for k, t in items if (d := slow(t, text)) <= int(0.1 * len(t))}
                assert dict(block.find(text)) == want
                met += i in want and want[i] > max(0, len(item) // 12 - 1)
    assert met > 15


def test_table_and_edges(spark):
    passage = "That and onesen erblest it hein ti inenan eranenes whou therouou thon the"
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "?!"), (5, "short one"), (1, passage), (6, passage)], "item_id long, text string")
    rows = [(0, "x " + passage.upper().replace(" ", ",\n") + " y"), (1, None), (2, ""), (3, passage[:20]), (4, "a short  one."), (4, "a short one"), (None, passage), (7, "word " * 9000 + passage)]
    got = sorted({(-1 if r.doc_id is None else r.doc_id, r.item_id, r.n_edits) for r in contaminated(hard(spark, rows), items).collect()})
    assert got == [(d, i, 0) for d, i in [(-1, 1), (-1, 6), (0, 1), (0, 6), (4, 5), (7, 1), (7, 6)]]
    assert contaminated(hard(spark, []), items).count() == 0
    assert contaminated(hard(spark, rows), items.limit(0)).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    from quire.llm import decontaminate

    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    assert sorted(tuple(r) for r in contaminated(docs, items).collect()) == whole and len(whole) > 20


def test_operators_use_the_whole_budget(spark):
    from quire.llm.decontaminate import drop_contaminated

    item = "passage of eighty or more letters that the benchmark holds and a page quotes with errors"
    spread = list(item)
    for e in range(8):  # the 8 edits of 10 %
        spread[5 + 11 * e] = "q"
    docs = spark.createDataFrame([(0, "so " + "".join(spread) + " it is"), (1, "a clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r) for r in contaminated(docs, items).collect()] == [(0, 1, 8)]
    assert [r.doc_id for r in drop_contaminated(docs, items).collect()] == [1]
