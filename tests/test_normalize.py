from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.normalize import normal_record, records_equal


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_scalars(spark):
    assert apply(spark, T.text, "  John   Doe \n", "n/a", "None", "-", " ", None, " A B") == ["John Doe", None, None, None, None, None, "A B"]
    assert apply(spark, T.email, " A@B.C ") == ["a@b.c"]
    assert apply(spark, T.phone, "+91-98765 43210", "(555) 123-4567") == ["+919876543210", "5551234567"]
    assert apply(spark, T.grade, "CGPA: 8.5/10", "8.5", "85%", "85 %", "first class") == ["8.5", "8.5", "85%", "85%", "first class"]
    assert apply(spark, T.year, "2018", " 2018 ", "20x8", None) == [2018, 2018, None, None]
    assert apply(spark, T.flag, "true", "maybe", "No", "1") == [True, None, False, True]


def test_dates(spark):
    given = ["June 2022", "Jun 2022", "06/2022", "2022-06", "2022", "Present", "Till Date", "2022-6-05", "2022-13", "13/2022", "n/a", "Spring 2020", None]
    assert apply(spark, T.date, *given) == ["2022-06"] * 4 + ["2022", T.PRESENT, T.PRESENT, "2022-06", None, "13-2022", None, "spring 2020", None]


def test_redact_and_limits(spark):
    assert apply(spark, lambda c: T.redact(c, ["abc"]), "x abc y", None) == ["x ***REDACTED*** y", ""]
    assert apply(spark, T.acceptable, "a", " \n", None, "x" * 20001) == [True, False, False, False]


def record(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").withColumn("n", normal_record(F.parse_json("v")))
    return [r.n for r in rows.orderBy("i").collect()]


def test_records(spark):
    a, b, c = record(spark, '{"skills": ["SQL", "python", "SQL"], "name": 5, "x": 1}', '{"skills": "Python", "education": [1]}', '{"experience": [{"title": "T", "end_date": "Present", "current": true}, {"title": "U", "end_date": "Present"}]}')
    assert a.skills == ["python", "sql", "sql"] and a.name == "5" and a.education == []
    assert b.skills is None and b.education is None
    assert '"current":true,"end_date":null' in "".join(c.experience) and T.PRESENT in "".join(c.experience)


def test_equality_ignores_order_and_case_of_skills(spark):
    rows = spark.createDataFrame([('{"skills": ["A", "b"]}', '{"skills": ["B", "a"], "extra": 1}', True), ('{"skills": ["a", "a"]}', '{"skills": ["a"]}', False), ('{"email": "X@y"}', '{"email": "x@Y"}', True), ('{"name": "X"}', '{"name": "x"}', False)], "a string, b string, same boolean")
    got = rows.select("same", records_equal(normal_record(F.parse_json("a")), normal_record(F.parse_json("b"))).alias("e")).collect()
    assert all(r.same == r.e for r in got)
