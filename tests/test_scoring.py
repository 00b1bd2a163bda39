from pyspark.sql import functions as F

from quarry.operators import inference


def test_scoring_holds_few_outputs_and_no_whole_batch_as_strings(spark):
    sizes = spark.range(2_500).coalesce(1).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("text"))
    rows = inference.score(sizes, lambda: str.upper)
    assert "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString() and rows.where("raw_output = 'A' and latency_ms >= 0").count() == 2_500
    assert inference.score(sizes.limit(1).select("id", F.lit(None).cast("string").alias("text")), lambda: lambda text: text or None).first().raw_output is None
