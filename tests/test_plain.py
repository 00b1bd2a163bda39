"""Records of plain types take a shorter way; it must say what the general one says."""

from pyspark.sql import functions as F

from quarry.functions import variant as V
from quarry.operators import normalize, parse
from quarry.spec import RESUME

GOOD = ['{}', '{"name": null, "skills": ["a"], "experience": []}', '{"certifications": [{"year": 2010, "name": "C"}]}', '{"experience": [{"current": true, "title": " T ", "responsibilities": ["b", "A"]}]}']
ODD = [
    '{"skills": ["a", null]}', '{"skills": null}', '{"extra": 1}', '{"name": 5}', '{"experience": [{"current": null, "responsibilities": []}]}', '{"experience": [null]}', '{"projects": [{"technologies": null}]}',
    '{"projects": [{"technologies": ["x", null], "where": 1}]}', '{"certifications": [{"year": "2010"}, {"year": 2010}]}', '{"education": null}', '{"education": {}}',
]


def test_type_alone_settles_plain_records_and_no_wrong_one(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(GOOD + ODD)], "i int, t string").withColumn("v", F.parse_json("t"))
    got = rows.select("i", parse.surely_valid(F.col("v")).alias("sure"), F.size(parse.schema_messages(F.col("v"))).alias("n")).orderBy("i").collect()
    assert [r.sure for r in got[1:4]] == [True, True, True]
    assert not [r.i for r in got if r.sure and r.n]


def test_plain_items_have_the_general_keys(spark):
    items = [
        '[{"title": "  Dev  Ops ", "company": "n/a", "start_date": "Jan 2020", "end_date": "Present", "current": true, "responsibilities": [" B", "a", null, "None"]}]',
        '[{"title": "A\\u00a0B", "start_date": "2020-13", "end_date": "2019", "current": null}]', '[null]', '[]', '[{"responsibilities": null, "start_date": "13/2020"}]',
    ]
    rows = spark.createDataFrame([(t,) for t in items], "t string").withColumn("v", F.parse_json("t"))
    fits, _ = V.plain_items(F.col("v"), RESUME.records["experience"])
    general = F.transform(V.as_array(F.col("v")), lambda x: normalize.item_key(x, RESUME, "experience"))
    general = F.when(~F.exists(general, lambda k: k.isNull()), F.sort_array(general))
    got = rows.select(fits.alias("fits"), normalize.record_list(F.col("v"), RESUME, "experience").alias("plain"), general.alias("general")).collect()
    assert all(r.fits for r in got) and [r.plain for r in got] == [r.general for r in got]


def test_notes_of_odd_values_name_each_difference_once(spark):
    from quarry.operators import errors

    cases = [
        ('{"skills": [null], "name": ""}', '{"skills": ["a", "b"]}', ["unsupported_value", "under_extraction"]), ('{"experience": [1, {"title": "T"}]}', '{"experience": [{"title": "T"}]}', []),
        ('{"skills": ["b", "a"]}', '{"skills": ["a", "b"]}', []), ('{"name": 5}', '{"name": "5"}', []), ('{"projects": [1]}', '{"projects": []}', ["over_extraction"]),
    ]
    rows = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, p string, g string")
    got = rows.select("i", errors.notes(F.parse_json("p"), F.parse_json("g")).alias("n"), errors._raw_empty(F.parse_json("p")).alias("e")).orderBy("i").collect()
    assert [[n.category for n in r.n] for r in got] == [c for _, _, c in cases] and not any(r.e for r in got)
