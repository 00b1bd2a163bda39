"""What is empty, and normal forms taken together."""

from pyspark.sql import functions as F

from quarry.operators import normalize
from quarry.plans import queries


def test_empty_values_by_their_type(spark):
    cases = [("[]", True), ("[null]", False), ("[[]]", False), ("{}", True), ('{"a": null}', False), ("null", True), ('" n/a "', True), ('"x"', False), ("0", False), ("false", False), ("[{}]", False), ('[null, "x"]', False)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", normalize.is_empty(F.parse_json("t")).alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [e for _, e in cases]
    assert spark.range(1).select(normalize.is_empty(F.parse_json(F.lit(None).cast("string"))).alias("e")).first().e


def test_forms_are_normal_record_and_empty_fields(spark):
    texts = ['{"name": " A  b ", "skills": ["X", null], "education": {}}', "[1]", '{"experience": [{"title": "T", "responsibilities": []}], "projects": [1], "email": 5}', "{}"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", F.parse_json("t"))
    got = rows.select(normalize.forms(F.col("v")).alias("f"), normalize.normal_record(F.col("v")).alias("n"), normalize.empty_fields(F.col("v")).alias("e")).collect()
    assert all(r.f.norm == r.n and r.f.empty == r.e for r in got) and "education" in got[0].e


def test_shared_tables_are_persisted_again_with_what_they_are_made_of(spark):
    """Otherwise a later query makes gold records anew for each of its parts."""
    d = "/root/testdata/sf0.001"
    queries._examples(spark, d)
    spark.catalog.clearCache()
    queries._examples(spark, d)
    assert all(queries._SHARED[k].storageLevel.useMemory for k in queries._SHARED if k[1] == d)
    spark.catalog.clearCache()
