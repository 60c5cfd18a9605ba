"""What Python workers keep from one stage to the next."""

from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.encoding import default_tokenizer, encoder
from quire.llm.packing import token_pieces
from quire.llm.toxicity import Settings, _comparer, _count_pieces

from .helpers import hard


def test_a_worker_keeps_one_thing_at_a_time():
    first = encoder(default_tokenizer())
    assert encoder(default_tokenizer()) is first
    compare = _comparer(b"plain words here", b"other words here", Settings())
    assert list(common._kept.values()) == [compare]
    assert encoder(default_tokenizer()) is not first
    assert list(_count_pieces(iter([]))) == [] and not common._kept


def test_pieces_are_the_same_with_a_small_cache(spark):
    docs = hard(spark).withColumn("text", F.concat("text", F.lit(" and so on"))).unionByName(hard(spark)).repartition(1)
    one, two = (sorted(map(tuple, token_pieces(docs, **k).collect()), key=str) for k in ({}, {"cache_entries": 3, "slice_bytes": 64}))
    assert one == two
