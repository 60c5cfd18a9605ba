"""Encoding, token files, token counts and packing against plain brute-force versions."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from quire.llm.common import fresh_path
from quire.llm.encoding import ChunkEncoder, default_tokenizer
from quire.llm.packing import pack, token_pieces
from quire.llm.token_counts import UnigramCounter, count_tokens, default_vocabulary, read_vocabulary
from quire.llm.token_files import EliasFano, Segment, pack_segment, read_token_files, read_token_index, write_token_files

from .helpers import HARD, hard


def whole(text):
    t = Tokenizer.from_file(default_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r.text for r in rows] + [t for _, t in HARD]


def test_chunks_encode_as_whole_texts_do(texts):
    import pyarrow as pa

    coder = ChunkEncoder(default_tokenizer(), cache_entries=500)
    for part in (texts[:100], texts[100:]):
        ids, sizes = coder.encode(pa.array(part))
        cuts = np.cumsum(sizes)
        for text, a, b in zip(part, cuts - sizes, cuts, strict=True):
            assert ids[a:b].tolist() == whole(text), text


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2, 1000, 10**12], list(range(3000)), [3] * 2000 + [10**6]])
def test_elias_fano(values):
    coded, _ = EliasFano.from_bytes(EliasFano.of(np.array(values, np.int64)).to_bytes(), 0)
    assert coded.all().tolist() == values
    assert [coded[i] for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        coded[len(values)]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(EliasFano.of(ends).to_bytes()) < 10_000 * (2 + np.log2(1000)) / 8 * 1.2


def test_segment_far_ids_and_wide_vocabulary():
    s = Segment(pack_segment([None, -(2**62), 2**62], np.array([1, 2, 1]), np.array([70000, 1, 2, 3])))
    assert s.doc_ids == [None, -(2**62), 2**62]
    assert [s.document(k).tolist() for k in range(3)] == [[70000], [1, 2], [3]]


def test_token_files_round_trip(spark):
    path = fresh_path(spark, "t")
    docs = hard(spark)
    write_token_files(docs, path, segment_ids=1000)
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(spark, path).collect()), key=lambda x: x[0])
    assert [x[1] for x in got] == sorted([i for i, _ in HARD], key=lambda i: (i is not None, i or 0))
    at = 0
    for start, doc_id, ids in got:
        assert start == at and ids in [[*whole(t), 1] for i, t in HARD if i == doc_id]
        at += len(ids)
    index = {(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_index(spark, path).collect()}
    assert index == {(s, i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for s, i, x in got}


def test_token_files_empty(spark):
    path = fresh_path(spark, "t")
    write_token_files(hard(spark, []), path)
    assert read_token_index(spark, path).count() == 0


def test_counts_equal_the_unigram_model(spark, texts):
    vocabulary = read_vocabulary(default_vocabulary())
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0))
    low = min(s for _, s in vocabulary)
    assert low <= 0
    model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(__import__("tokenizers").Regex("[ \t\n\x0b\x0c\r]+"), "removed"), pre_tokenizers.Metaspace(split=False)])
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(hard(spark, rows)).collect()}
    for i, text in rows:
        assert got[i] == len(model.encode(text or "").ids), text


def test_count_tie_rules():
    vocabulary = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0), ("bc", -2.0), ("abc", -3.0)]
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0))
    counter = UnigramCounter(vocabulary)
    for word in ["abc", "abab", "xxabyy", "zab", "cba", "bcabc", "zzz"]:
        assert counter.count(word)[0] == len(model.encode(word).ids), word


def check_packing(rows, pieces, limit):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted((r.doc_id is not None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id is not None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces)
    return len(bins)


def test_pieces_and_packing(spark):
    docs = hard(spark)
    pieces = token_pieces(docs, limit=64)
    rows = pieces.collect()
    for doc_id, text in HARD:
        ids = [*whole(text), 1]
        cut = [(k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
        if doc_id != 9:
            assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id) == cut
    n = check_packing(pack(pieces, 64, shard_size=16, shards_per_group=4).collect(), rows, 64)
    assert n <= -(-sum(r.length for r in rows) // 64) + 3


def test_packing_reaches_the_bound_where_it_can(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):  # triples that fill 100 exactly
        a, b = sorted(rng.integers(1, 99, 2).tolist())
        rows += [(3 * i, 0, 0, a + 0, 0), (3 * i + 1, 0, 0, max(1, b - a), 0), (3 * i + 2, 0, 0, 100 - b, 0)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    least = -(-sum(r[3] for r in rows) // 100)
    assert check_packing(pack(pieces, 100).collect(), pieces.collect(), 100) <= least + 1


def test_packing_edges(spark):
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    assert pack(spark.createDataFrame([], schema)).count() == 0
    names = ["row", "shard", "place", "bin", "rank", "last", "sequence_id", "offset"]
    clash = pack(spark.createDataFrame([(1, 0, 0, 5, 0), (2, 0, 0, 4096, 0), (1, 0, 0, 5, 0)], schema).selectExpr("*", *[f"'x' AS `{n}`" for n in names])).collect()
    assert sorted(r.doc_id for r in clash) == [1, 1, 2] and all(r.row == r.bin == "x" and isinstance(r.offset, int) for r in clash)
    with pytest.raises(Exception, match="length"):
        pack(spark.createDataFrame([(1, 0, 0, None, 0)], schema)).collect()


def test_evolution_beats_best_fit():
    """Triples that fill a bin exactly: best fit wastes bins, crossover of whole well-filled bins wins some back."""
    from quire.llm.packing import best_fit, crossover, evolve

    won = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        a, b = rng.integers(260, 380, (2, 40))
        sizes = np.concatenate([a, b, 1000 - a - b])
        plain = np.full(len(sizes), -1, np.int64)
        best_fit(sizes, np.argsort(-sizes, kind="stable").tolist(), [], 1000, plain)
        best = evolve(sizes, [], 1000, seed, 12, 150)
        assert np.bincount(best, weights=sizes).max() <= 1000
        assert best.max() <= plain.max()
        won += best.max() < plain.max()
        child = crossover(sizes, plain, best, 1000, rng)
        assert (child >= 0).all() and np.bincount(child, weights=sizes).max() <= 1000
    assert won >= 3
