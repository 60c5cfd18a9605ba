"""Toxicity scores: held-out accuracy, what the fit may read, and edge cases."""

import math
import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from quire.llm.toxicity import Comparer, Settings, beyond_chance, calibrated, cover, fit, pieces, runs, score, score_documents, telling_pieces, telling_windows, train, windows

from .helpers import HARD, hard


def tables(spark, sf="sf0.1"):
    return (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    got = score_documents(docs, labels)
    held = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    ranks, y = held.score.rank().values, held.toxic.values
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.75 and y[held.predicted == 1].mean() > 0.8 and held.predicted[y == 1].mean() > 0.42
    assert got.where("score < 0 OR score > 1 OR predicted <> (CASE WHEN score >= 0.7 THEN 1 ELSE 0 END)").count() == 0


def test_held_out_labels_are_never_read(spark):
    docs, labels = tables(spark, "sf0.01")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r for r in score_documents(docs, x).collect()} for x in (labels, flipped))
    assert one == two
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in one.items())


def test_windows_that_hold_toxic_words_save_bytes():
    rng = random.Random(3)
    plain = [" ".join(rng.choices("some quiet words about rivers and their old stones under tall green trees".split(), k=30)) for _ in range(300)]
    toxic = [f"{t} snarkling grumbold" for t in plain]
    quiet, telling = set(map(int, np.concatenate([pieces(t) for t in plain]))), np.concatenate([pieces(t) for t in toxic])
    telling = np.unique([p for p in telling.tolist() if p not in quiet])
    compare = Comparer(train([], Settings()), train([r for t in toxic for r in runs(t, telling)], Settings()), Settings())
    assert compare.gains("such a snarkling day")[0] >= 3 > compare.gains("such a quiet day")[0]
    assert windows(None, 8) == windows("  ", 8) == ["  "] and windows("A b\nC d", 3) == [" a b c ", " d "]


def test_telling_pieces_are_those_that_plain_counts_tell(spark):
    texts = [(part, toxic, t) for part in ("0", "2") for toxic, t in [(1, "you Vile grub"), (1, "a vile grub é"), (1, "vile  grubs"), (0, "a kind word"), (0, "kind words for you"), (0, "vile grin"), (1, ""), (0, "x")] * (1 if part == "0" else 2)]
    texts = list(dict.fromkeys((p, x, t + p) for p, x, t in texts))
    found = telling_pieces(spark.createDataFrame(texts, "part string, toxic int, text string"), Settings(least_texts=2, least_ratio=2.0))
    held = {t: {(" " + " ".join(t.lower().split()) + " ").encode()[i : i + 7] for i in range(200)} for _, _, t in texts}
    for (name, toxic), numbers in found.items():
        sides = [[t for p, x, t in texts if x == side and name in (p, "all")] for side in (toxic, 1 - toxic)]
        every = {g for t in sides[0] for g in held[t] if len(g) == 7}
        count = lambda g, side: sum(g in held[t] for t in side)
        want = {g for g in every if count(g, sides[0]) >= 2 and count(g, sides[0]) / len(sides[0]) >= 2 * (count(g, sides[1]) + 0.5) / len(sides[1])}
        assert numbers.tolist() == sorted(int.from_bytes(g, "big") for g in want)
        for t in sides[0]:
            raw = (" " + " ".join(t.lower().split()) + " ").encode()
            inside = [any(raw[i : i + 7] in want for i in range(max(0, k - 6), k + 1)) for k in range(len(raw))]
            assert b"|".join(runs(t, numbers)) == b"|".join(r for r in bytes(c if k else 0 for c, k in zip(raw, inside, strict=True)).split(b"\0") if r)


def test_scores_by_plain_compression(spark):
    """Window by window with zstandard itself: lengths, the calibrated step and the regression."""
    docs, labels = tables(spark, "sf0.01")
    model = fit(docs, labels)
    options = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=7, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    pair = [zstandard.ZstdCompressor(compression_params=options, dict_data=zstandard.ZstdCompressionDict(b"\n" * 8 + d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (model.ordinary, model.toxic)]

    def plain(text):
        own, saved = (text or "").lower().split(), []
        for k in range(0, max(1, len(own)), 3):
            w = (" " + " ".join(own[k : k + 3]) + " ").encode()
            saved.append(len(pair[0].compress(w)) - len(pair[1].compress(w)))
        saved.sort(reverse=True)
        n, hits = len(saved), sum(s >= model.step for s in saved)
        counts = [sum(s >= k for s in saved) for k in range(1, 13)] + [sum(s <= -k for s in saved) for k in (2, 4, 6)]
        x = [1, min(saved[0], 12), min(sum(saved[:3]) / len(saved[:3]), 12), sum(saved) / n, math.log1p(n), hits >= 1, hits >= 2, *[10 * c / n for c in counts], *map(math.log1p, counts)]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    rows = score(docs.unionByName(hard(spark).select("doc_id", "text"), allowMissingColumns=True), model).collect()
    assert len(rows) == docs.count() + len(HARD) and all(abs(r.toxicity - plain(r.text)) < 1e-9 for r in rows)


def test_calibration_and_labels_given_both_ways(spark):
    gains = np.zeros((2, 19))
    gains[:, 3], gains[0, 4:7] = 50, [30, 2, 1]
    assert (calibrated(gains, 0.02), calibrated(gains, 0.01), calibrated(gains, 0.0)) == (2, 3, 4)
    docs, labels = tables(spark, "sf0.01")
    both = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic")))
    assert fit(docs, both) is None


def test_edges(spark):
    docs, labels = tables(spark, "sf0.01")
    model = fit(docs, labels)
    assert model is not None
    rows = score(hard(spark).withColumn("toxicity", F.lit("x")), model).collect()
    assert len(rows) == len(HARD) and all(0 <= r.toxicity <= 1 for r in rows)
    assert len({r.toxicity for r in rows if not (r.text or "").strip()}) == 1
    assert score(hard(spark, []), model).count() == 0
    none = score_documents(hard(spark), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.0] * len(HARD)


def test_strings_cover_short_toxic_words_whatever_stands_before_them():
    """A match of a short word alone saves zstandard nothing; with what stands before it, it does. Near copies and pieces that chance brings don't count."""
    rng = random.Random(5)
    some = [a + b for a in ("tion", "ing", "her", "stone", "wh") for b in ("ed", "ou", "ly", "an")]
    toxic = [" ".join(rng.choices(some, k=9) + ["scum"] + rng.choices(some, k=9)) for _ in range(300)]
    sure = np.unique([p for w in ("d scum", "u scum", "y scum", "n scum") for p in pieces(w)[1:].tolist()])
    held = sorted({w for t in toxic for w in telling_windows(t, sure, 3)})
    every = {" ".join(["", *t.split()[k : k + 3], ""]) for t in toxic for k in range(19)}
    assert held == sorted(w.encode() for w in every if set(pieces(w[1:-1]).tolist()) & set(sure.tolist()))
    compare = Comparer(cover([], sure, Settings()), cover(held, sure, Settings()), Settings())
    fresh = [f"{rng.choice(some)} scum {rng.choice(some)}" for _ in range(50)]
    assert sum(compare.gains(t)[0] >= 3 for t in fresh) >= 40 and all(compare.gains(t.replace("scum", "calm"))[0] <= 0 for t in fresh)
    alone = Comparer(b"", train([r for t in toxic for r in runs(t, sure)], Settings()), Settings())
    assert sum(alone.gains(t)[0] >= 3 for t in fresh) < 40
    assert cover(held, sure, Settings(), len(held) + 1) == b""
    assert beyond_chance(np.array([3, 12, 12, 0]), np.array([0, 0, 12, 9]), 0.2, 10**6).tolist() == [False, True, False, False]
