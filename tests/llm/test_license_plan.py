"""The license scan works a text's places out once."""

from pyspark.sql import functions as F

from quire.llm import licenses as L


def test_places_are_worked_out_once(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "a mit b")], "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    found = L.template_matches(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains(") == 1
    assert [(r.doc_id, r.label, r.containment) for r in found.collect()] == [(1, "mit-notice", 1.0)]
