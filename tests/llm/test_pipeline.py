"""Each stage on what the one before kept, against its rule applied plainly."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quire.llm.decontaminate import ItemBlock, plain  # noqa: E402
from quire.llm.near_duplicates import shingles, words  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_toxicity(spark, stages):
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes
    gone = set(ids(stages[0])) - set(ids(stages[1]))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [labels[i] for i in gone if i in labels]
    assert gone and sum(known) >= 0.8 * len(known)


def test_one_of_each_group_stays(stages):
    sets = {r.doc_id: shingles(words(r.text), 5) for r in stages[1].collect()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    u, v = sorted((find(a), find(b)))
                    parent[v] = u
    assert ids(stages[2]) == [i for i in order if find(i) == i]


def test_contaminated_documents_go_and_others_stay(spark, stages):
    items = ItemBlock([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 0.1, 12)
    dirty = {r.doc_id for r in stages[2].collect() if list(items.find(plain(r.text)))}
    assert dirty and ids(stages[3]) == [i for i in ids(stages[2]) if i not in dirty]


def test_pseudonyms_and_packing(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[3:5])
    assert before.keys() == after.keys() and before != after
    assert ids(stages[5].where("piece = 0")) == sorted(after)
    fill = stages[5].groupBy("sequence_id").agg({"length": "sum"}).toPandas().iloc[:, 1]
    assert fill.max() <= 4096 and len(fill) <= -(-fill.sum() // 4096) + 1


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls, empty and repeated rows, other texts under one doc_id, and columns named as the operators' own."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(None, "no id 4111 1111 1111 1111"), (None, None), (9, "one text of nine words that stands under this id"), (9, "one text of nine words that stands under this id"), (9, "quite another text under nine which has no copy at all"), (7, None), (6, ""), (5, " \n "), (4, "long " * 30000)]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in extra], source.schema)
    for c in ("toxicity", "n_values", "row", "bin", "hash", "offset", "sequence_id", "component_id", "kept"):
        rows = rows.withColumn(c, corpus_pipeline.F.lit("x"))
    for docs, empty in ((rows, False), (rows.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.materialise(stage(spark, docs, SF), f"edges-{name}-{empty}")
            if name != "packing":
                assert out.columns == docs.columns
            docs = out if name == "packing" else out
            if empty:
                assert out.count() == 0
            elif name == "near_duplicates":
                texts = [r.text for r in out.where("doc_id = 9").collect()]
                assert sorted(texts) == sorted({t for i, t in extra if i == 9}) and out.where("doc_id IS NULL").count() == 2 and out.where("doc_id IN (4, 5, 6, 7)").count() == 4
            elif name == "personal_data":
                assert "4111" not in next(r.text for r in out.where("doc_id IS NULL AND text IS NOT NULL").collect())
            elif name == "packing":
                assert out.where("piece = 0").count() == 8


def test_near_copies_that_the_stage_catches(stages):
    """Recall of links by the exact sets for the queries with an id that 100 divides: the partner, or the query, is gone."""
    sets = {r.doc_id: shingles(words(r.text), 5) for r in stages[1].collect()}
    left, met = set(ids(stages[2])), []
    for q in (i for i in sets if i % 100 == 0):
        for d in sets:
            n = len(sets[q] & sets[d])
            if d != q and n and 100 * n >= 80 * (len(sets[q]) + len(sets[d]) - n):
                met.append(not {q, d} <= left)
    assert all(met)
