import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import compare, errors, evaluate

GOLD = {
    "name": "Ann Lee", "email": "ann@x.org", "phone": "+1-555-1", "location": None, "summary": None, "skills": ["SQL", "Python"], "projects": [], "certifications": [],
    "education": [{"degree": "BSc", "institution": "U", "field": "CS", "start_year": 2010, "end_year": 2013, "grade": None}],
    "experience": [{"title": "Dev", "company": "Acme", "location": None, "start_date": "2020-01", "end_date": None, "current": True, "responsibilities": ["built"]}, {"title": "Ops", "company": "Beta", "location": None, "start_date": "2018-01", "end_date": "2019-12", "current": False, "responsibilities": []}],
}


def edited(**changes):
    return json.dumps(GOLD | changes)


def jobs(**changes):
    return [GOLD["experience"][0] | changes, GOLD["experience"][1]]


def frames(spark, outputs):
    gold = spark.createDataFrame([("g", json.dumps(GOLD))], "id string, j string").withColumn("gold", F.parse_json("j")).drop("j")
    rows = spark.createDataFrame([(f"m{i}", "g", o, float(i)) for i, o in enumerate(outputs)], "model string, id string, raw_output string, latency_ms double")
    return rows, gold


def examples(spark, *outputs):
    rows = evaluate.evaluate_examples(*frames(spark, outputs)).collect()
    return [r for r in sorted(rows, key=lambda r: int(r.model[1:]))]


def test_counts(spark):
    perfect, no_email, wrong, invented, extra, garbage, dates, broken, empty = examples(
        spark, edited(), edited(email=None), edited(name="Bob"), edited(location="Rome"), edited(skills=["SQL", "Python", "Go"]), "prose only", edited(experience=jobs(start_date="Jan 2020", end_date="Present")), edited(skills="SQL"), "{}"
    )
    assert (perfect.fp, perfect.fn, perfect.field_f1, perfect.exact_match) == (0, 0, 1.0, True)
    assert (no_email.fp, no_email.fn, no_email.missing_fields) == (0, 1, 1)
    assert (wrong.fp, wrong.fn) == (1, 1) and (invented.fp, invented.fn) == (1, 0) and (extra.fp, extra.fn) == (1, 0)
    assert garbage.tp == 0 and garbage.fn == perfect.tp and garbage.missing_fields == garbage.gold_nonempty_fields == 6
    assert dates.exact_match and dates.fp == 0
    assert (broken.fp, broken.fn) == (1, 1) and not broken.schema_valid
    assert empty.tp == 0 and empty.fp == 0 and empty.schema_valid and not empty.exact_match


def test_duplicate_predictions_count_twice_and_unknown_ids_do_not(spark):
    rows, gold = frames(spark, [edited()])
    twice = rows.unionByName(rows.withColumn("raw_output", F.lit("junk"))).unionByName(rows.withColumn("id", F.lit("stranger")))
    head = evaluate.headline(evaluate.evaluate_examples(twice, gold), ["model"]).first()
    assert head.n == 2 and head.schema_validity == 0.5


def test_nearest_rank(spark):
    for n, ranks in ((75, (38, 72)), (76, (38, 73)), (78, (40, 75)), (1, (1, 1))):
        rows = spark.range(1, n + 1).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
        r = evaluate.nearest_rank(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
        want = lambda p: float(max(1, min(n, round(p * n + 0.5))))
        assert (r.p50, r.p95, r.samples) == (want(0.5), want(0.95), n)
        assert r.p50 == ranks[0]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_nearest_rank_of_any_numbers(spark, monkeypatch, broadcast):
    monkeypatch.setattr(evaluate, "BROADCAST_TARGETS", broadcast)
    rng = np.random.default_rng(8)
    rows = [("one", float(x)) for x in rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000)]
    rows += [(f"g{k % 400}", float(k % 7) - 3) for k in range(2000)] + [(None, -0.0), (None, 0.0), (None, 5.0), ("none", None)]
    rows += [("close", 1 + k * 2.0**-52) for k in range(50)] + [("odd", x) for x in (float("nan"), float("inf"), -float("inf"), 1.0)]
    got = {r.g: r for r in evaluate.nearest_rank(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", {"a": 0.03, "b": 0.5, "c": 0.95}).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        values.sort(key=lambda v: (v != v, v))
        for name, p in (("a", 0.03), ("b", 0.5), ("c", 0.95)):
            want = values[max(1, min(len(values), round(p * len(values) + 0.5))) - 1]
            assert got[g][name] == want or (want != want and got[g][name] != got[g][name])
        assert got[g].samples == len(values)


def test_nearest_rank_without_groups_of_integers(spark):
    rows = spark.range(-50, 51).select((F.col("id") * 2**55).alias("v"))
    r = evaluate.nearest_rank(rows, [], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.samples, r.p50, r.p95) == (101, 0, 45 * 2**55) and r.__fields__ == ["samples", "p50", "p95"]
    assert evaluate.nearest_rank(rows.limit(0), [], "v", {"p50": 0.5}).count() == 0


def test_multisets_of_any_length(spark):
    from collections import Counter

    rng = np.random.default_rng(4)
    cases = [([], []), (["a"], []), ([], ["a"]), (["a", "a", "b"], ["a", "b", "b"]), (["b", None], [None, None])]
    cases += [([f"x{k}" for k in rng.integers(0, 9, n)], [f"x{k}" for k in rng.integers(0, 9, m)]) for n, m in ((20, 30), (7, 50))]
    cases += [([f"item {k}" for k in rng.integers(0, 50_000, 200_000)], [f"item {k}" for k in rng.integers(0, 50_000, 150_000)])]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p array<string>, g array<string>")
    got = {r.i: r.n for r in rows.select("i", evaluate._multiset_matches(F.col("p"), F.col("g")).alias("n")).collect()}
    assert got == {i: sum((Counter(p) & Counter(g)).values()) for i, (p, g) in enumerate(cases)}
    assert spark.createDataFrame([(None, ["a"])], "p array<string>, g array<string>").select(evaluate._multiset_matches(F.col("p"), F.col("g")).alias("n")).first().n is None


def categories(spark, *outputs):
    rows = errors.categorize(*frames(spark, outputs)).collect()
    return [r.categories for r in sorted(rows, key=lambda r: int(r.model[1:]))]


def test_categories(spark):
    got = categories(
        spark, edited(), "prose", edited(extra=1), edited(phone="000"), edited(email=None), edited(location="Rome"), edited(skills=["SQL"]), edited(experience=jobs()[:1]),
        edited(experience=jobs(start_date="Jan 2020")), edited(experience=jobs(end_date="Present")), edited(experience=jobs(company="Other")), "[1]", edited(email="ANN@x.org"),
    )
    assert got == [
        [], ["malformed_json"], ["schema_violation"], ["wrong_value"], ["missing_field"], ["unsupported_value", "over_extraction"], ["under_extraction"], ["list_item_error", "under_extraction"],
        ["date_normalization_error"], [], ["section_association_error"], ["malformed_json"], ["wrong_value"],
    ]


def test_missing_prediction_is_malformed(spark):
    rows, gold = frames(spark, [edited()])
    more = gold.unionByName(gold.withColumn("id", F.lit("h")))
    assert {(r.id, r.primary_category) for r in errors.categorize(rows, more).collect()} == {("g", "none"), ("h", "malformed_json")}


def test_keep_last_and_first(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "id string, seq int, v string")
    assert {(r.id, r.v) for r in compare.keep_last(rows, ["id"]).collect()} == {("a", "z"), ("b", "q")}
    assert {(r.id, r.v) for r in compare.keep_first(rows, ["id"]).collect()} == {("a", "x"), ("b", "q")}


def test_field_relations(spark):
    rows = spark.createDataFrame([("base", "g", edited(email=None)), ("finetuned", "g", edited(name="Bob"))], "model string, id string, raw_output string")
    got = {r.field: r.relation for r in compare.field_relations(rows).collect()}
    assert got["email"] == "only_finetuned" and got["name"] == "differs" and got["skills"] == "match" and got["projects"] == "both_empty"


def test_appended_metrics_equal_a_full_run(spark, tmp_path):
    from quarry.operators import inference, running_metrics

    outputs = [edited(), edited(name="Bob"), "junk", edited(skills=["SQL"]), edited(phone=None, email="x@y.z"), edited(experience=jobs(company="Other")), edited(extra=1), edited(skills="SQL")]
    gold = spark.createDataFrame([(f"g{i}", json.dumps(GOLD), "odd" if i % 2 else "even") for i in range(40)], "id string, j string, part string").withColumn("gold", F.parse_json("j")).drop("j")
    rows = [(f"g{i}", outputs[i % len(outputs)]) for i in range(40)]
    table = lambda some: spark.createDataFrame(some, "id string, text string")
    predictions, path = str(tmp_path / "p"), str(tmp_path / "m")
    run = lambda some, mode="resume": inference.run_inference(table(some), predictions, {"m": "1"}, lambda: lambda t: t, mode, warm_up=0, rows_per_chunk=20)
    bring = lambda: running_metrics.update(predictions, path, gold, "m", ["part"])

    def same_as_full():
        latest = inference.latest(inference.stored(spark, predictions)).select(F.lit("m").alias("model"), "id", "raw_output", "latency_ms")
        examples = evaluate.evaluate_examples(latest, gold, keep=["part"])
        examples = examples.cache()
        columns = ["model", "part", "n", *evaluate.RATES, "output_chars_mean"]
        full = sorted(map(str, evaluate.headline(examples, ["model", "part"]).select(columns).collect()))
        assert sorted(map(str, running_metrics.rates(spark, path, ["part"]).select(columns).collect())) == full
        full = {r.field: (r.tp, r.fp, r.fn, r.f1) for r in evaluate.field_totals(examples, ["model"]).collect()}
        assert {r.field: (r.tp, r.fp, r.fn, r.f1) for r in running_metrics.field_totals(spark, path).collect()} == full

    run(rows[:15])
    assert bring() == 15
    run(rows)
    assert bring() == 25 and bring() == 0  # only what is new is parsed
    run([(f"g{i}", edited(name="New")) for i in range(5)], "fresh")  # new answers take the place of old ones
    assert bring() == 10
    same_as_full()
    inference.run_inference(table(rows), predictions, {"m": "2"}, lambda: lambda t: t, "force", warm_up=0)
    with pytest.raises(inference.StaleCache):
        bring()
