"""Gold records and model outputs derived from the driver tables by keyed hashes; no random functions.

``GOLD_SQL`` and ``PRED_SQL`` state the same rules for an independent engine, as counts of units and buckets: it never parses JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import keyed_hash

MODELS = ("base", "finetuned")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _h(*parts) -> F.Column:
    return keyed_hash(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, custkey, template_id, difficulty, split, target: one record per customer."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    skills = read(spark, sf_dir, "part").agg(F.sort_array(F.collect_set("p_type")).alias("types"))  # as many as there are part types
    month = F.date_format("o_orderdate", "yyyy-MM")
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    jobs = read(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(newest)).where("rn <= 3").select(
        "o_custkey", "rn",
        F.struct(
            F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("Company "), "o_orderstatus").alias("company"), F.lit(None).cast("string").alias("location"),
            month.alias("start_date"), F.when(F.col("rn") > 1, month).alias("end_date"), (F.col("rn") == 1).alias("current"), F.array("o_orderpriority").alias("responsibilities"),
        ).alias("job"),
    )
    jobs = jobs.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "job"))), lambda x: x["job"]).alias("experience"))
    key = F.col("c_custkey")
    cust = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).crossJoin(F.broadcast(skills)).join(jobs, key == F.col("o_custkey"), "left")
    cust = cust.withColumn("id", F.concat(F.lit("c"), key.cast("string")))
    ident = F.col("id")
    picks = F.transform(F.sequence(F.lit(1), (F.lit(4) + _h("n", ident) % 9).cast("int")), lambda k: F.get(F.col("types"), (_h("s", ident, "|", k.cast("string")) % F.size("types")).cast("int")))
    study = F.struct(
        F.lit("B.Sc").alias("degree"), F.col("r_name").alias("institution"), F.col("c_mktsegment").alias("field"), (2000 + key % 20).cast("int").alias("start_year"), (2003 + key % 20).cast("int").alias("end_year"),
        F.when(key % 4 == 1, "8.5").alias("grade"),
    )
    project = F.struct(F.concat(F.lit("Project "), key.cast("string")).alias("name"), F.array("c_mktsegment", "n_name").alias("technologies"), F.lit(None).cast("string").alias("description"))
    certificate = F.struct(F.concat(F.lit("Cert "), (key % 7).cast("string")).alias("name"), F.col("n_name").alias("issuer"), (2010 + key % 15).cast("int").alias("year"))
    record = F.struct(
        F.col("c_name").alias("name"),
        F.when(_h("e", ident) % 10 >= 3, F.concat(F.lower("c_mktsegment"), key.cast("string"), F.lit("@example.org"))).alias("email"),
        F.when(_h("p", ident) % 20 >= 7, F.concat(F.lit("+91-9"), F.lpad((_h("q", ident) % 1000000000).cast("string"), 9, "0"))).alias("phone"),
        F.when(key % 5 != 0, F.concat_ws(", ", "n_name", "r_name")).alias("location"),
        F.when(key % 4 != 0, F.concat(F.lit("Works in "), "c_mktsegment")).alias("summary"),
        picks.alias("skills"), F.array(study).alias("education"), F.coalesce("experience", F.array().cast("array<struct<title:string,company:string,location:string,start_date:string,end_date:string,current:boolean,responsibilities:array<string>>>")).alias("experience"),
        F.when(key % 2 == 0, F.array(project)).otherwise(F.array().cast("array<struct<name:string,technologies:array<string>,description:string>>")).alias("projects"),
        F.when(key % 3 == 0, F.array(certificate)).otherwise(F.array().cast("array<struct<name:string,issuer:string,year:int>>")).alias("certifications"),
    )
    number = (1 + key % 12).cast("int")
    return cust.select(
        "id", key.alias("custkey"), F.format_string("template_%02d", number).alias("template_id"),
        F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (1 + key % 3).cast("int")).alias("difficulty"),
        F.when(number <= 8, "train").when(number <= 10, "validation").otherwise("test").alias("split"), record.alias("target"),
    )


BUCKETS = 22


def predictions(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """model, id, seq, raw_output, latency_ms: gold JSON with one edit by bucket; some outputs are missing.

    0 plain, 1 fenced, 2 prose around, 3 cut off, 4 prose only, 5 no email, 6 other name, 7 one skill more, 8 unknown key, 9 dates spelled, 10 newest job at
    another company, 11 no education, 12 a made-up location, 13 no skills, 14 skills as a text, 15 phone spelled, 16 grade spelled and years as texts, 17 newest job twice,
    18 name as a number, 19 a text among the certificates, 20 a year that is none, 21 flags that are none. The tuned model has 0 in place of 3, 4 and 8.
    """
    rows = (gold(spark, sf_dir) if records is None else records).withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    ident, model = F.col("id"), F.col("model")
    b = (_h(model, "|", ident) % BUCKETS).cast("int")
    rows = rows.where(_h("x", model, ident) % 50 != 0).withColumn("b", F.when((model == "finetuned") & b.isin(3, 4, 8), 0).otherwise(b))
    t, jobs, phone = F.col("target"), F.col("target.experience"), F.col("target.phone")
    cut = lambda c, at, n: F.substring(c, at, n)
    spelled = lambda d: F.date_format(F.to_date(F.concat(d, F.lit("-01"))), "MMM yyyy")
    newest = lambda change: F.transform(jobs, lambda j, i: F.when(i == 0, change(j)).otherwise(j))
    edits = {  # of the same type as the record
        5: t.withField("email", F.lit(None).cast("string")), 6: t.withField("name", F.concat(F.lit("Not "), t["name"])), 7: t.withField("skills", F.concat(t["skills"], F.array(F.lit("EXTRA SKILL")))),
        9: t.withField("experience", F.transform(jobs, lambda j: j.withField("start_date", spelled(j["start_date"])).withField("end_date", spelled(j["end_date"])))),
        10: t.withField("experience", newest(lambda j: j.withField("company", F.lit("Other Ltd")))), 11: t.withField("education", F.slice(t["education"], 1, 0)), 12: t.withField("location", F.lit("Nowhere")),
        13: t.withField("skills", F.slice(t["skills"], 1, 0)), 15: t.withField("phone", F.concat(F.lit("+91 ("), cut(phone, 5, 5), F.lit(") "), cut(phone, 10, 2), F.lit("."), cut(phone, 12, 3))),
        17: t.withField("experience", F.concat(F.slice(jobs, 1, 1), jobs)),
    }
    studied = lambda change: t.withField("education", F.transform(t["education"], change))
    retyped = {
        14: t.withField("skills", F.lit("Python")), 18: t.withField("name", F.lit(5)), 19: t.withField("certifications", F.array(F.lit("x"))), 20: studied(lambda e: e.withField("start_year", F.lit("20x8"))),
        16: studied(lambda e: e.withField("start_year", e["start_year"].cast("string")).withField("grade", F.concat(F.lit("CGPA: "), e["grade"], F.lit("/10")))),
        21: t.withField("experience", F.transform(jobs, lambda j: j.withField("current", F.lit("maybe")))),
    }
    edited = t
    for k, change in edits.items():
        edited = F.when(F.col("b") == k, change).otherwise(edited)
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    json = text(edited)
    for k, change in retyped.items():
        json = F.when(F.col("b") == k, text(change)).otherwise(json)
    rows = rows.withColumn("json", json)
    json = F.col("json")
    raw = (
        F.when(F.col("b") == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(F.col("b") == 2, F.concat(F.lit("Here is the record:\n"), json, F.lit("\nThat is all.")))
        .when(F.col("b") == 3, F.substring(json, F.lit(1), F.char_length(json) - 1)).when(F.col("b") == 4, "I could not find a record in this text.")
        .when(F.col("b") == 8, F.concat(F.lit('{"extra": 1, '), F.substring(json, F.lit(2), F.char_length(json)))).otherwise(json)
    )
    return rows.select("model", "id", F.col("custkey").alias("seq"), raw.alias("raw_output"), (_h("l", model, ident) % 5000).cast("double").alias("latency_ms"))


_H = lambda x: f"(('0x' || substr(md5({x}), 1, 8))::BIGINT)"

#: unit counts of the gold records: nm em ph lo su sk ed ex pr ce, and dates: whether a job has a date
GOLD_SQL = f"""
g0 AS (
  SELECT c_custkey AS k, 'c' || c_custkey AS id, c_name FROM customer
), gx AS (
  SELECT o_custkey, least(count(*), 3) AS ex FROM orders GROUP BY o_custkey
), g AS (
  SELECT k, id, 'template_' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') AS template_id,
    CASE k % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
    CASE WHEN k % 12 <= 7 THEN 'train' WHEN k % 12 <= 9 THEN 'validation' ELSE 'test' END AS split,
    1 AS nm, CASE WHEN {_H("'e' || id")} % 10 >= 3 THEN 1 ELSE 0 END AS em, CASE WHEN {_H("'p' || id")} % 20 >= 7 THEN 1 ELSE 0 END AS ph,
    CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END AS lo, CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END AS su, 4 + {_H("'n' || id")} % 9 AS sk,
    1 AS ed, coalesce(ex, 0) AS ex, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS pr, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS ce
  FROM g0 LEFT JOIN gx ON o_custkey = k
)"""

#: the outcome of each prediction by its bucket b, with tp, fp and fn by field
PRED_SQL = f"""{GOLD_SQL}, m(model) AS (VALUES ('base'), ('finetuned')
), p0 AS (
  SELECT model, g.*, {_H("model || '|' || id")} % {BUCKETS} AS b0, CAST({_H("'l' || model || id")} % 5000 AS DOUBLE) AS latency_ms
  FROM m, g WHERE {_H("'x' || model || id")} % 50 <> 0
), p AS (
  SELECT *, CASE WHEN model = 'finetuned' AND b0 IN (3, 4, 8) THEN 0 ELSE b0 END AS b FROM p0
), fu AS (
  SELECT *, unnest(['name', 'email', 'phone', 'location', 'summary', 'skills', 'education', 'experience', 'projects', 'certifications']) AS field,
    unnest([nm, em, ph, lo, su, sk, ed, ex, pr, ce]) AS u FROM p
), f AS (
  SELECT *,
    CASE WHEN b IN (3, 4) THEN 0 WHEN b || field IN ('5email', '6name', '11education', '12location', '13skills', '14skills', '18name', '19certifications', '20education') THEN 0
      WHEN b || field IN ('10experience', '21experience') THEN greatest(u - 1, 0) ELSE u END AS tp,
    CASE WHEN b || field IN ('6name', '7skills', '12location', '14skills', '18name', '19certifications', '20education') THEN 1
      WHEN b || field IN ('10experience', '17experience', '21experience') THEN least(u, 1) ELSE 0 END AS fp,
    CASE WHEN b IN (3, 4) OR b || field IN ('5email', '6name', '11education', '12location', '13skills') THEN u
      WHEN b || field IN ('10experience', '14skills', '18name', '19certifications', '20education', '21experience') THEN least(u, 1) ELSE 0 END AS fn,
    b IN (3, 4) OR (u = 0 AND b || field NOT IN ('12location', '19certifications')) OR b || field IN ('5email', '11education', '13skills') AS void
  FROM fu
), t AS (
  SELECT model, id, template_id, difficulty, split, b, ex, lo, em, latency_ms, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) FILTER (u > 0 AND void) AS missing,
    count(*) FILTER (u > 0) AS filled,
    b NOT IN (3, 4) AS json_valid, b NOT IN (3, 4, 8, 14, 18, 19, 20) AND NOT (b = 21 AND ex > 0) AS schema_valid, b NOT IN (3, 4) AND sum(fp) + sum(fn) = 0 AS exact_match
  FROM f GROUP BY model, id, template_id, difficulty, split, b, ex, lo, em, latency_ms
)"""
