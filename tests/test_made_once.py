"""Work that plans did several times over, or in one task."""

from pyspark.sql import functions as F

from quarry.plans import corpus, queries

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_one_partition_are_dealt(spark):
    rows = corpus.records(corpus.keys(spark, {"train": 40}).coalesce(1)).select("id", "experience")
    assert rows.groupBy(F.spark_partition_id()).count().count() > 1


def test_no_filter_makes_records_before_they_are_dealt(spark):
    assert not [line for line in _plan(queries.g5_experience(spark, SMALL)).split("\n") if "Filter" in line and "md5" in line]


def test_texts_are_not_made_twice_to_meet_their_records(spark):
    rows = corpus.proofs(corpus.examples(corpus.keys(spark, {"train": 3, "test": 3})))
    assert _plan(rows).count("Range (0, 3,") == 2 and rows.columns[:2] == ["id", "name"] and all(r.proven for r in rows.collect())


def test_the_round_trip_compares_what_was_made_for_the_files(spark):
    assert "md5" not in _plan(queries.s1_s2_json_round_trip(spark, SMALL))
