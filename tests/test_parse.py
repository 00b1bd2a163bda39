from pyspark.sql import functions as F

from quarry.operators import parse

OUTPUTS = [
    ("plain", '{"name": "A"}', "direct"), ("blanks", '  {"name": "A"} \n', "direct"), ("fenced", 'Sure:\n```json\n{"name": "A"}\n```\nbye', "code_fence"), ("prose", 'Here: {"name": "A"} done', "brace_slice"),
    ("garbage", "not json at all", None), ("empty", "", None), ("null input", None, None), ("cut", '{"name": "A", "skills": [', None), ("array", '["a", "b"]', "direct"),
    ("trailing", '{"a":1} xyz', "brace_slice"), ("two", '{"a":1}{"b":2}', None), ("bracket", '{"a":1}]', "brace_slice"), ("twice", '{"a":1,"a":2}', "direct"), ("json null", "null", None),
    ("bad fence then object", '```json\n{"a":\n```\nso {"a": 2}', None), ("quote trick", '{"a":1},"x"', "brace_slice"),
]


def test_three_stages(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = parse.parse_outputs(spark.createDataFrame([(a, b) for a, b, _ in OUTPUTS], "k string, raw_output string")).collect()
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    got = {r.k: r.matched_via for r in rows}
    assert got == {k: v for k, _, v in OUTPUTS}
    by = {r.k: r for r in rows}
    assert by["empty"].error == "empty output" and by["garbage"].error == "unparseable output" and by["plain"].error is None
    assert not by["array"].is_object and by["array"].json_valid and by["plain"].is_object


def test_dropped_brace_never_balances(spark):
    row = parse.parse_outputs(spark.createDataFrame([('{"a": {"b": 1}, "c": [{"d": 2}]',)], "raw_output string")).first()
    assert not row.json_valid


def schema(spark, *texts):
    rows = parse.check_schema(parse.parse_outputs(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_output string")))
    return [(r.schema_valid, r.schema_error) for r in rows.orderBy("i").collect()]


def test_schema_accepts_and_rejects(spark):
    good = ['{}', '{"name": null, "skills": []}', '{"education": [{"start_year": "2018", "end_year": 2020.0}]}', '{"experience": [{"current": "yes", "title": "x"}]}', '{"certifications": [{"year": true}]}']
    bad = ['{"extra": 1}', '{"skills": "Python"}', '{"skills": null}', '{"skills": ["a", 1]}', '{"name": 3}', '{"experience": [{"current": "yes-please"}]}', '{"experience": [{"current": null}]}',
           '{"education": [{"start_year": 2018.5}]}', '{"education": [{"where": "x"}]}', '{"education": ["x"]}', '{"education": {}}', '[1]']
    assert [ok for ok, _ in schema(spark, *good)] == [True] * len(good)
    assert [ok for ok, _ in schema(spark, *bad)] == [False] * len(bad)


def test_schema_messages_are_capped(spark):
    (ok, text), = schema(spark, '{"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "g": 1}')
    assert not ok and text.endswith("(+2 more)") and text.count(";") == 4


def test_outcomes(spark):
    rows = parse.parse_outputs(spark.createDataFrame([("m", "{}"), ("m", "x"), ("m", "{}")], "model string, raw_output string"))
    assert {(r.outcome, r.n) for r in parse.parse_outcomes(rows, ["model"]).collect()} == {("direct", 2), ("unparseable output", 1)}
    assert rows.select(F.col("matched_via")).count() == 3
