from quarry.operators import evaluate


def test_a_join_of_units_is_one_aggregate_and_nulls_match_nothing(spark):
    pred = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "x"), (None, "a")], "i int, k string")
    gold = spark.createDataFrame([(1, "a"), (1, None), (1, "b"), (3, "y"), (None, "a")], "i int, k string")
    out = evaluate.multiset_join(pred, gold, ["i"], "k")
    assert {tuple(r) for r in out.collect()} == {(1, 1, 2, 2), (2, 0, 1, 0), (3, 0, 0, 1), (None, 0, 1, 1)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
