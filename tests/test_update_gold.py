from pyspark.sql import functions as F

from quarry.operators import evaluate, inference, running_metrics


def test_an_update_takes_the_gold_records_of_its_ids_only(spark, tmp_path, monkeypatch):
    """The others were brought to their normal forms as well."""
    seen = []
    monkeypatch.setattr(running_metrics, "evaluate_examples", lambda outputs, gold, *a, **k: seen.append(gold.select("id").collect()) or evaluate.evaluate_examples(outputs, gold, *a, **k))
    rows = spark.createDataFrame([(x, "{}", "d") for x in "abc"], "id string, text string, slice string")
    gold = rows.select("id", "slice", F.parse_json("text").alias("gold"))
    inference.run_inference(rows.where("id = 'b'"), str(tmp_path / "p"), {"m": "1"}, lambda: lambda t: t, warm_up=0)
    assert running_metrics.update(str(tmp_path / "p"), str(tmp_path / "s"), gold, "m", ["slice"]) == 1
    assert [[r.id for r in ids] for ids in seen] == [["b"]]
