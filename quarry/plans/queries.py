"""Registered queries and, where SQL can state them, the same in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed as K
from ..functions import text as T
from ..operators import bootstrap, compare, errors, evaluate, inference, parse, running_metrics, sft, validate
from ..sources import files
from ..spec import EXAMPLE_DDL, RECORD_DDL, RESUME
from . import corpus, fixtures
from .fixtures import GOLD_SQL, PRED_SQL, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f
    return add


KEEP = ["template_id", "difficulty", "split"]


_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def _shared(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Tables that several parts of a query read: parsed once and persisted; later plans see a leaf in place of the expressions."""
    def get(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, d, build.__name__)
        if key not in _SHARED or not _SHARED[key].storageLevel.useMemory:  # where the cache was cleared, what the table is made of is persisted anew as well
            for old in [k for k in _SHARED if k[:2] != key[:2]]:  # tables of other folders are done with
                _SHARED.pop(old).unpersist()
            _SHARED[key] = build(spark, d)
        return _SHARED[key].persist()

    return get


@_shared
def _gold_records(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.gold(spark, d)


@_shared
def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.predictions(spark, d, _gold_records(spark, d))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.gold_variants(_gold_records(spark, d))


@_shared
def _examples(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate_examples(_predictions(spark, d), _gold(spark, d), keep=KEEP)


@_shared
def _categorized(spark: SparkSession, d: str) -> DataFrame:
    return errors.categorize(_predictions(spark, d), _gold(spark, d), keep=["difficulty"])


_R = lambda a, b: f"CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"
_MEASURES = f"""
  {_R("sum(tp)", "sum(tp) + sum(fp)")} AS precision, {_R("sum(tp)", "sum(tp) + sum(fn)")} AS recall, {_R("2 * sum(tp)", "2 * sum(tp) + sum(fp) + sum(fn)")} AS f1,
  avg(CAST(exact_match AS INT)) AS exact_match, avg(CAST(json_valid AS INT)) AS json_validity, avg(CAST(schema_valid AS INT)) AS schema_validity,
  {_R("sum(fp)", "sum(tp) + sum(fp)")} AS unsupported_rate, {_R("sum(missing)", "sum(filled)")} AS missing_rate"""
_FIELD_MEASURES = f"""
  CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  {_R("sum(tp)", "sum(tp) + sum(fp)")} AS precision, {_R("sum(tp)", "sum(tp) + sum(fn)")} AS recall, {_R("2 * sum(tp)", "2 * sum(tp) + sum(fp) + sum(fn)")} AS f1"""
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"


# --- evaluation -----------------------------------------------------------------------------------------------------------

@query("m5_headline", f"WITH {PRED_SQL} SELECT model, count(*) AS n, {_MEASURES}, avg(latency_ms) AS latency_mean FROM t GROUP BY model")
def m5_headline(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.headline(_examples(spark, d), ["model"]).drop("output_chars_mean")


@query("m4_examples", f"""WITH {PRED_SQL} SELECT model, id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {_F1} AS field_f1,
  CAST(missing AS BIGINT) AS missing_fields, CAST(filled AS BIGINT) AS gold_nonempty_fields, exact_match, json_valid, schema_valid FROM t""")
def m4_examples(spark: SparkSession, d: str) -> DataFrame:
    long = ["tp", "fp", "fn", "missing_fields", "gold_nonempty_fields"]
    rows = _examples(spark, d)
    return rows.select("model", "id", *(F.col(c).cast("long").alias(c) for c in long), "field_f1", "exact_match", "json_valid", "schema_valid")


@query("a1_field_totals", f"WITH {PRED_SQL} SELECT model, field, {_FIELD_MEASURES} FROM f GROUP BY GROUPING SETS ((model, field), (model))")
def a1_field_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.field_totals(_examples(spark, d), ["model"])


@query("a7_latency", f"""WITH {PRED_SQL}, r AS (SELECT model, latency_ms, row_number() OVER (PARTITION BY model ORDER BY latency_ms) AS k, count(*) OVER (PARTITION BY model) AS n FROM t)
SELECT model, n AS samples, min(latency_ms) FILTER (k >= greatest(1, least(n, round_even(0.5 * n + 0.5, 0)))) AS latency_p50,
  min(latency_ms) FILTER (k >= greatest(1, least(n, round_even(0.95 * n + 0.5, 0)))) AS latency_p95 FROM r GROUP BY model, n""")
def a7_latency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency(_predictions(spark, d), ["model"])


@query("a7_event_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n AS samples, min(value) FILTER (k >= greatest(1, least(n, round_even(0.5 * n + 0.5, 0)))) AS p50,
  min(value) FILTER (k >= greatest(1, least(n, round_even(0.95 * n + 0.5, 0)))) AS p95 FROM r GROUP BY event_type, n""")
def a7_event_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nearest_rank(read(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("a8_output_length", "SELECT source, lang, avg(length(coalesce(text, ''))) AS mean_chars FROM documents GROUP BY ALL")
def a8_output_length(spark: SparkSession, d: str) -> DataFrame:
    """Texts stand for outputs here, as another engine does not build the outputs' JSON."""
    return evaluate.output_length(read(spark, d, "documents"), ["source", "lang"], "text")


_RANKED = """r AS (SELECT model, latency_ms, row_number() OVER (PARTITION BY model ORDER BY latency_ms) AS k, count(*) OVER (PARTITION BY model) AS n FROM t),
 l AS (SELECT model, avg(latency_ms) AS latency_mean, min(latency_ms) FILTER (k >= greatest(1, least(n, round_even(0.5 * n + 0.5, 0)))) AS latency_p50,
  min(latency_ms) FILTER (k >= greatest(1, least(n, round_even(0.95 * n + 0.5, 0)))) AS latency_p95 FROM r GROUP BY model)"""
_DELTAS = """SELECT metric, max(v) FILTER (model = 'base') AS base, max(v) FILTER (model = 'finetuned') AS finetuned, max(v) FILTER (model = 'finetuned') - max(v) FILTER (model = 'base') AS delta,
  count(DISTINCT model) < 2 AS partial FROM u GROUP BY metric"""
_TIMED = "latency_mean, latency_p50, latency_p95"


_METRICS = ", ".join(evaluate.RATES)


@query("a10_deltas", f"""WITH {PRED_SQL}, {_RANKED}, h AS (SELECT model, {_MEASURES} FROM t GROUP BY model), j AS (SELECT * FROM h JOIN l USING (model)),
 u AS (UNPIVOT j ON {_METRICS}, {_TIMED} INTO NAME metric VALUE v) {_DELTAS}""")
def a10_deltas(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.headline_table(_examples(spark, d)).where("metric <> 'output_chars_mean'")


# outputs are texts here, as another engine can measure them; the other ten rows are those of a10_deltas
@query("a11_output_length_row", """WITH h AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'finetuned' END AS model, avg(length(coalesce(text, ''))) AS v FROM documents GROUP BY ALL)
SELECT 'mean_chars' AS metric, max(v) FILTER (model = 'base') AS base, max(v) FILTER (model = 'finetuned') AS finetuned,
  max(v) FILTER (model = 'finetuned') - max(v) FILTER (model = 'base') AS delta, false AS partial FROM h""")
def a11_output_length_row(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, "base").otherwise("finetuned").alias("model"), "text")
    return evaluate.compare_metrics(evaluate.output_length(rows, ["model"], "text"), ["mean_chars"])


@query("c3_partial", f"""WITH {PRED_SQL}, h AS (SELECT model, {_MEASURES} FROM t WHERE model = 'base' GROUP BY model), u AS (UNPIVOT h ON {_METRICS} INTO NAME metric VALUE v)
SELECT metric, v AS base, CAST(NULL AS DOUBLE) AS finetuned, CAST(NULL AS DOUBLE) AS delta, true AS partial FROM u""")
def c3_partial(spark: SparkSession, d: str) -> DataFrame:
    only = _predictions(spark, d).where("model = 'base'")
    return evaluate.compare_metrics(evaluate.headline(evaluate.evaluate_examples(only, _gold(spark, d)), ["model"]))


@query("a12_per_field", f"""WITH {PRED_SQL}, s AS (SELECT model, field, {_FIELD_MEASURES} FROM f GROUP BY model, field)
SELECT CAST(list_position({list(RESUME.fields)}, b.field) AS BIGINT) AS position, b.field, b.precision AS base_precision, b.recall AS base_recall, b.f1 AS base_f1,
  t.precision AS finetuned_precision, t.recall AS finetuned_recall, t.f1 AS finetuned_f1, t.f1 - b.f1 AS delta_f1
FROM s b JOIN s t ON b.field = t.field AND b.model = 'base' AND t.model = 'finetuned'""")
def a12_per_field(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_field_table(_examples(spark, d))


@query("a16_slices", f"WITH {PRED_SQL} SELECT model, difficulty, template_id, count(*) AS n, {_MEASURES}, avg(latency_ms) AS latency_mean FROM t GROUP BY GROUPING SETS ((model), (model, difficulty), (model, template_id))")
def a16_slices(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sliced(_examples(spark, d), ["difficulty", "template_id"]).drop("output_chars_mean")


@query("p2_outcomes", f"""WITH {PRED_SQL} SELECT model, CASE WHEN b = 1 THEN 'code_fence' WHEN b = 2 THEN 'brace_slice' WHEN b IN (3, 4) THEN 'unparseable output' ELSE 'direct' END AS outcome,
  b NOT IN (3, 4) AS is_object, count(*) AS n FROM t GROUP BY ALL""")
def p2_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_outcomes(parse.parse_outputs(evaluate.dealt(_predictions(spark, d))), ["model"])


_MESSAGES = """CASE WHEN b IN (3, 4) THEN 'not an object' WHEN b = 8 THEN 'extra: unknown key' WHEN b = 14 THEN 'skills: not a list of strings' WHEN b = 18 THEN 'name: not a string'
  WHEN b = 19 THEN 'certifications.0. not an object' WHEN b = 20 THEN 'education.0.start_year: not an integer'
  WHEN b = 21 AND ex > 0 THEN array_to_string(list_transform(range(ex), lambda i: 'experience.' || i || '.current: not a boolean'), '; ') END"""


@query("p3_schema", f"WITH {PRED_SQL} SELECT model, schema_valid, {_MESSAGES} AS schema_error, count(*) AS n FROM t GROUP BY ALL")
def p3_schema(spark: SparkSession, d: str) -> DataFrame:
    rows = parse.check_schema(parse.parse_outputs(evaluate.dealt(_predictions(spark, d))))
    return rows.groupBy("model", "schema_valid", "schema_error").agg(F.count(F.lit(1)).alias("n"))


@query("j7_multiset_join", """WITH p AS (SELECT l_orderkey, l_returnflag AS k, count(*) AS p FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey, l_linestatus AS k, count(*) AS g FROM lineitem GROUP BY ALL),
 u AS (SELECT l_orderkey, coalesce(p, 0) AS p, coalesce(g, 0) AS g FROM p FULL JOIN g USING (l_orderkey, k))
SELECT l_orderkey, CAST(sum(least(p, g)) AS BIGINT) AS tp, CAST(sum(p - least(p, g)) AS BIGINT) AS fp, CAST(sum(g - least(p, g)) AS BIGINT) AS fn FROM u GROUP BY l_orderkey""")
def j7_multiset_join(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    return evaluate.multiset_join(lines.select("l_orderkey", F.col("l_returnflag").alias("k")), lines.select("l_orderkey", F.col("l_linestatus").alias("k")), ["l_orderkey"], "k")


@query("m3_long_lists", """WITH s AS (SELECT o_custkey, o_orderpriority, count(*) AS g, count(*) FILTER (o_orderkey % 7 <> 0) + count(*) FILTER (o_orderkey % 11 = 0) AS p FROM orders GROUP BY ALL)
SELECT 'c' || o_custkey AS id, 'skills' AS field, CAST(sum(least(p, g)) AS BIGINT) AS tp, CAST(sum(p - least(p, g)) AS BIGINT) AS fp, CAST(sum(g - least(p,
  g)) AS BIGINT) AS fn FROM s GROUP BY o_custkey
UNION ALL SELECT 'c' || o_custkey, 'experience', count(*) FILTER (o_orderkey % 5 <> 0), count(*) FILTER (o_orderkey % 5 = 0), count(*) FILTER (o_orderkey % 5 = 0) FROM orders
  GROUP BY o_custkey""")
def m3_long_lists(spark: SparkSession, d: str) -> DataFrame:
    """All orders of a customer as one record's lists, one of texts that repeat and one of records, with items dropped, doubled and changed."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    job = F.struct(
        F.concat_ws(" ", priority, key.cast("string")).alias("title"), F.concat(F.lit("Company "), "o_orderstatus").alias("company"), F.lit(None).cast("string").alias("location"),
        F.date_format("o_orderdate", "yyyy-MM").alias("start_date"), F.lit(None).cast("string").alias("end_date"), F.lit(False).alias("current"), F.array(priority).alias("responsibilities"),
    )
    told = F.concat(F.when(key % 7 != 0, F.array(priority)).otherwise(F.array().cast("array<string>")), F.when(key % 11 == 0, F.array(priority)).otherwise(F.array().cast("array<string>")))
    changed = F.when(key % 5 == 0, job.withField("company", F.lit("Other Ltd"))).otherwise(job)
    rows = read(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")).agg(
        F.collect_list(priority).alias("skills"), F.flatten(F.collect_list(told)).alias("told"), F.collect_list(job).alias("experience"), F.collect_list(changed).alias("changed"))
    record = lambda skills, experience: F.struct(F.col(skills).alias("skills"), F.col(experience).alias("experience"))
    gold = evaluate.gold_variants(rows.select("id", record("skills", "experience").alias("target")))
    outputs = rows.select(F.lit("m").alias("model"), "id", F.to_json(record("told", "changed")).alias("raw_output"), F.lit(0.0).alias("latency_ms"))
    stats = evaluate.evaluate_examples(outputs, gold).select("id", F.inline("stats")).where(F.col("field").isin("skills", "experience"))
    return stats.select("id", "field", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))


# --- error analysis and comparison ------------------------------------------------------------------------------------------

_CATEGORY = f"""{PRED_SQL}, c AS (
  SELECT m.model, g.id, g.difficulty, CASE WHEN t.b IS NULL OR t.b IN (3, 4) THEN ['malformed_json'] WHEN NOT t.schema_valid THEN ['schema_violation'] WHEN t.b = 5
    AND g.em = 1 THEN ['missing_field']
    WHEN t.b = 6 THEN ['wrong_value'] WHEN t.b = 7 THEN ['unsupported_value'] WHEN t.b = 9 AND g.ex > 0 THEN ['date_normalization_error'] WHEN t.b = 10
      AND g.ex > 0 THEN ['section_association_error']
    WHEN t.b = 11 THEN ['list_item_error', 'missing_field', 'under_extraction'] WHEN t.b = 12 AND g.lo = 1 THEN ['wrong_value'] WHEN t.b = 12 THEN ['unsupported_value',
      'over_extraction']
    WHEN t.b = 13 THEN ['missing_field', 'under_extraction'] WHEN t.b = 17 AND g.ex > 0 THEN ['list_item_error', 'unsupported_value'] ELSE [] END AS categories,
      coalesce(categories[1], 'none') AS category
  FROM m CROSS JOIN g LEFT JOIN t ON t.model = m.model AND t.id = g.id)"""


@query("e8_categories", f"WITH {_CATEGORY} SELECT model, id, category AS primary_category, array_to_string(categories, ',') AS categories FROM c")
def e8_categories(spark: SparkSession, d: str) -> DataFrame:
    return _categorized(spark, d).select("model", "id", "primary_category", F.array_join("categories", ",").alias("categories"))


@query("a13_error_summary", f"""WITH {_CATEGORY}, n AS (SELECT unnest({[*errors.CATEGORIES, "none"]}) AS category, unnest(range(0, {len(errors.CATEGORIES) + 1})) AS position),
 y AS (SELECT model, unnest(categories) AS category FROM c), x AS (SELECT model, category, count(*) AS k FROM y GROUP BY ALL), s AS (SELECT model, count(*) AS total FROM c
   GROUP BY model)
SELECT position, n.category, s.model, coalesce(k, 0) AS n, coalesce(k, 0) / total AS share FROM n CROSS JOIN s LEFT JOIN x ON x.model = s.model AND x.category = n.category""")
def a13_error_summary(spark: SparkSession, d: str) -> DataFrame:
    return errors.summary(_categorized(spark, d))


@query("a14_error_totals", f"WITH {_CATEGORY} SELECT model, count(*) AS examples, count(*) FILTER (category <> 'none') AS failures FROM c GROUP BY model")
def a14_error_totals(spark: SparkSession, d: str) -> DataFrame:
    return errors.totals(_categorized(spark, d))


@query("f5_error_filter", f"""WITH {_CATEGORY} SELECT id, difficulty, max(category) FILTER (model = 'base') AS base, max(category) FILTER (model = 'finetuned') AS finetuned
FROM c WHERE difficulty = 'easy' GROUP BY id, difficulty HAVING count(*) FILTER (list_contains(categories, 'missing_field')) > 0""")
def f5_error_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = errors.with_category(errors.paired(_categorized(spark, d), ["difficulty"]), "missing_field", "easy")
    return rows.select("id", "difficulty", F.col("base.primary_category").alias("base"), F.col("finetuned.primary_category").alias("finetuned"))


_SIDES = f"""{PRED_SQL}, s AS (SELECT *, {_F1} AS f1 FROM t), c1 AS (
  SELECT g.id, g.difficulty, b.json_valid AS base_json_valid, b.schema_valid AS base_schema_valid, b.exact_match AS base_exact_match, b.f1 AS base_field_f1,
    t.json_valid AS finetuned_json_valid, t.schema_valid AS finetuned_schema_valid, t.exact_match AS finetuned_exact_match, t.f1 AS finetuned_field_f1,
    coalesce(t.f1, 0) - coalesce(b.f1, 0) AS f1_delta, b.f1 IS NULL OR t.f1 IS NULL AS partial
  FROM g LEFT JOIN s b ON b.id = g.id AND b.model = 'base' LEFT JOIN s t ON t.id = g.id AND t.model = 'finetuned')"""


@query("c1_comparison", f"WITH {_SIDES} SELECT * FROM c1")
def c1_comparison(spark: SparkSession, d: str) -> DataFrame:
    return compare.comparison(_examples(spark, d), _gold(spark, d), ["difficulty"])


@query("e10_representatives", f"""WITH {_SIDES}, k AS (SELECT *, {fixtures._H("'42|' || id")} AS r FROM c1), o AS (SELECT *, coalesce(base_schema_valid, false) AS bs, coalesce(finetuned_schema_valid, false) AS fs FROM k)
SELECT 'worst_delta' AS selection_reason, id, f1_delta AS delta FROM (FROM o ORDER BY f1_delta, id LIMIT 1) UNION ALL SELECT 'best_delta', id, f1_delta FROM (FROM o
  ORDER BY f1_delta DESC, id LIMIT 1)
UNION ALL SELECT 'schema_fixed', id, f1_delta FROM (FROM o WHERE NOT bs AND fs ORDER BY id LIMIT 1) UNION ALL SELECT 'schema_broken', id, f1_delta FROM (FROM o WHERE bs
  AND NOT fs ORDER BY id LIMIT 1)
UNION ALL SELECT 'random', id, f1_delta FROM (FROM o ORDER BY r, id LIMIT 5)""")
def e10_representatives(spark: SparkSession, d: str) -> DataFrame:
    rows = c1_comparison(spark, d)
    scores = rows.select("id", F.col("base_field_f1").alias("base_f1"), F.col("finetuned_field_f1").alias("finetuned_f1"))
    return errors.representatives(errors.paired(_categorized(spark, d)), scores)


@query("c2_agreement", f"""WITH {PRED_SQL}, w AS (
  SELECT f.model, f.id, f.field, CASE WHEN NOT schema_valid OR void THEN '' WHEN f.b || field IN ('6name', '7skills', '12location') THEN 'own'
    WHEN f.b || field IN ('10experience', '17experience') THEN 'own' || f.b ELSE 'gold' END AS v
  FROM f JOIN t USING (model, id)
), x AS (SELECT id, field, coalesce(max(v) FILTER (model = 'base'), '') AS bv, coalesce(max(v) FILTER (model = 'finetuned'), '') AS tv FROM w GROUP BY ALL)
SELECT field, CASE WHEN bv = '' AND tv = '' THEN 'both_empty' WHEN tv = '' THEN 'only_base' WHEN bv = '' THEN 'only_finetuned' WHEN bv = tv THEN 'match'
  ELSE 'differs' END AS relation, count(*) AS n FROM x GROUP BY ALL""")
def c2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return compare.agreement(compare.field_relations(_predictions(spark, d)))


# --- bootstrap ------------------------------------------------------------------------------------------------------------

N_BOOT = 1000
_MIXED = lambda x: f"(xor({x}, {x} >> 16) * 569420461) & 4294967295 AS {x}1, (xor({x}1, {x}1 >> 15) * 1935289751) & 4294967295 AS {x}2, xor({x}2, {x}2 >> 15)"


def _draws(rows: str, by: str) -> str:
    """``rows`` (keys, draw, k1, k2, number, c, upto, lft) with own: the quantile of a binomial variable of lft draws and the share c / upto."""
    ahead = "(d - x.k) / (x.k + 1) * odds"
    fold = lambda step: f"list_reduce(list_transform(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1), lambda k: {{'w': 1.0::DOUBLE, 'c': 1.0::DOUBLE, 'k': k}}), lambda x, y: {step})"
    go = f"{{'w': x.w * ({ahead}), 'c': x.c + x.w * ({ahead}), 'k': x.k + 1}}"
    return f"""SELECT * EXCLUDE (u, d, p, odds, dev, lo, hi, total), CASE WHEN c = upto THEN lft ELSE {fold(f"CASE WHEN x.c < u * total THEN {go} ELSE x END")}.k END AS own FROM (
      SELECT *, CASE WHEN c = upto THEN 1 ELSE {fold(go)}.c END AS total FROM (
        SELECT *, lft AS d, c / upto AS p, sqrt(d * p * (1 - p)) AS dev, p / nullif(1 - p, 0) AS odds, greatest(floor(d * p - 8 * dev - 10), 0) AS lo,
          least(ceil(d * p + 8 * dev + 10), d) AS hi FROM (
          SELECT {by}, draw, i, number, c, upto, lft, ((a & 2147483647) * 2147483648 + (b & 2147483647) + 0.5::DOUBLE) / 4611686018427387904 AS u FROM (
            SELECT *, (a + k2 + (number >> 32)) & 4294967295 AS y, {_MIXED("y")} AS b FROM (SELECT *, xor(number & 4294967295, k1) AS x, {_MIXED("x")} AS a FROM ({rows}))))))"""


def _resamples(metric: str, source: str, measures: list[str], value: str, seed: int, by: str = "model") -> str:
    """Point and 95 % interval of a metric: draws are split over buckets of tuples, then over the tuples of a bucket, one after another."""
    text = ", ".join(f"coalesce(CAST({m} AS VARCHAR), '')" for m in measures)
    names, n_boot = ", ".join(measures), N_BOOT
    return f"""SELECT {by}, '{metric}' AS metric, any_value(point) AS point, max(value) FILTER (r = {int(0.025 * n_boot)}) AS low, max(value) FILTER (r = {min(n_boot - 1, int(0.975 * n_boot))}) AS high FROM (
  WITH RECURSIVE o AS MATERIALIZED (SELECT {by}, {names}, count(*) AS c, CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 13) AS BIGINT) AS h, h >> 42 AS bucket
    FROM {source} GROUP BY ALL),
   n AS (SELECT {by}, sum(c) AS n, {value.replace("sum(", "sum(c * ")} AS point FROM o GROUP BY {by}),
   k AS MATERIALIZED (SELECT draw, {fixtures._H(f"'{seed}|' || draw")} AS k1, {fixtures._H(f"'{seed}|' || draw || '|second'")} AS k2 FROM range({n_boot}) r(draw)),
   b AS MATERIALIZED (SELECT {by}, bucket, CAST(sum(c) AS BIGINT) AS c, row_number() OVER (PARTITION BY {by} ORDER BY bucket) AS i, CAST(sum(sum(c)) OVER (PARTITION BY {by}
     ORDER BY bucket DESC) AS BIGINT) AS upto FROM o GROUP BY {by}, bucket),
   s1 AS (SELECT {by}, draw, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS number, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS upto, CAST(n AS BIGINT) AS lft,
     CAST(0 AS BIGINT) AS own FROM n, k UNION ALL
     {_draws(f"SELECT b.{by}, s1.draw, b.i, b.bucket AS number, b.c, b.upto, s1.lft - s1.own AS lft, k1, k2 FROM s1 JOIN b ON b.{by} = s1.{by} AND b.i = s1.i + 1 JOIN k ON k.draw = s1.draw", by)}),
   m AS MATERIALIZED (SELECT *, row_number() OVER w AS i, CAST(sum(c) OVER (PARTITION BY {by}, bucket ORDER BY h DESC,
     {", ".join(f"{m} DESC" for m in measures)}) AS BIGINT) AS upto FROM o WINDOW w AS (PARTITION BY {by}, bucket ORDER BY h, {names})),
   s2 AS (SELECT {by}, draw, CAST(0 AS BIGINT) AS i, CAST(number << 42 AS BIGINT) AS number, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS upto, own AS lft,
     CAST(0 AS BIGINT) AS own FROM s1 WHERE i > 0 UNION ALL
     {_draws(f"SELECT m.{by}, s2.draw, m.i, m.h + 1024 AS number, m.c, m.upto, s2.lft - s2.own AS lft, k1, k2 FROM s2 JOIN m ON m.{by} = s2.{by} AND m.i = s2.i + 1 AND m.bucket = (CASE WHEN s2.i = 0 THEN s2.number ELSE s2.number - 1024 END) >> 42 JOIN k ON k.draw = s2.draw", by)}),
   v AS (SELECT s2.{by}, draw, {value.replace("sum(", "sum(own * ").replace("count(*)", "sum(own)")} AS value FROM s2 JOIN m ON m.{by} = s2.{by} AND m.h + 1024 = s2.number
     AND s2.i > 0 GROUP BY s2.{by}, draw)
  SELECT {by}, point, value, row_number() OVER (PARTITION BY {by} ORDER BY value) - 1 AS r FROM v JOIN n USING ({by})) GROUP BY {by}"""


_MEAN = lambda x: f"sum({x}) / sum(1)"


@query("b1_bootstrap", f"SELECT * EXCLUDE k FROM ({_resamples('quality', '(SELECT 1 AS k, quality FROM labels)', ['quality'], _MEAN('quality'), 43, 'k')})")
def b1_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").select(F.lit("quality").alias("metric"), "quality")
    return bootstrap.confidence(rows, ["metric"], ["quality"], bootstrap.mean_of("quality"), n_boot=N_BOOT, seed=43)


@query("b2_ratio_of_sums", "SELECT * EXCLUDE k FROM (" + _resamples(
    "toxic share", "(SELECT 1 AS k, toxic, toxic + quality AS marks FROM labels)", ["toxic", "marks"], _R("sum(toxic)", "sum(marks)"), 7, "k") + ")")
def b2_ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").select(F.lit("toxic share").alias("metric"), "toxic", (F.col("toxic") + F.col("quality")).alias("marks"))
    return bootstrap.confidence(rows, ["metric"], ["toxic", "marks"], bootstrap.ratio_of_sums("toxic", "marks"), n_boot=N_BOOT, seed=7)


_RATED = """(SELECT model, CAST(schema_valid AS INT) AS schema_valid, CAST(exact_match AS INT) AS exact_match, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp + fp AS BIGINT) AS units FROM t)"""


@query("b3_headline_intervals", f"WITH {PRED_SQL} " + " UNION ALL ".join([
    _resamples("schema_validity", _RATED, ["schema_valid"], _MEAN("schema_valid"), 43), _resamples("exact_match", _RATED, ["exact_match"], _MEAN("exact_match"), 44),
    _resamples("field_f1", _RATED, ["tp", "fp", "fn"], _R("2.0 * sum(tp)", "2 * sum(tp) + sum(fp) + sum(fn)"), 42), _resamples("unsupported_rate", _RATED, ["fp", "units"], _R("sum(fp)", "sum(units)"), 45)]))
def b3_headline_intervals(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.headline_intervals(_examples(spark, d), n_boot=N_BOOT)


# --- dataset quality --------------------------------------------------------------------------------------------------------

def _dataset(spark: SparkSession, d: str) -> DataFrame:
    """Documents as examples; the benchmark is a second part of the test split."""
    n = (1 + F.col("doc_id") % 12).cast("int")
    split = F.when(n <= 8, "train").when(n <= 10, "validation").otherwise("test")
    docs = read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), split.alias("split"), "text", F.format_string("template_%02d", n).alias("template_id"), F.col("lang").alias("record_key"))
    items = read(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("test").alias("split"), "text", F.lit("template_01").alias("template_id"), F.lit("item").alias("record_key"))
    rows = docs.unionByName(items)
    return rows.withColumns({"file_split": F.col("split"), "difficulty": F.when(F.length("id") % 4 == 0, "odd").otherwise("easy"), "schema_version": F.lit("1.0"), "schema_valid": F.lit(True)})


_BLANKS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_KEY = f"lower(trim(regexp_replace(text, '{_BLANKS}', ' ', 'g')))"
_DATASET = f"""x AS (
  SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 12 <= 7 THEN 'train' WHEN doc_id % 12 <= 9 THEN 'validation' ELSE 'test' END AS split, text,
    'template_' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') AS template_id FROM documents
  UNION ALL SELECT 'b' || item_id, 'test', text, 'template_01' FROM benchmark)"""


@query("v1_row_rules", f"""WITH {_DATASET} SELECT 'error' AS severity, 'unknown_difficulty' AS rule, split, id FROM x WHERE length(id) % 4 = 0
UNION ALL SELECT 'error', 'missing_text', split, id FROM x WHERE text IS NULL UNION ALL SELECT 'error', 'blank_text', split, id FROM x WHERE text IS NULL OR {_KEY} = ''
UNION ALL SELECT 'error', 'template_of_other_split', split, id FROM x WHERE template_id = 'template_01' AND split <> 'train'""")
def v1_row_rules(spark: SparkSession, d: str) -> DataFrame:
    return validate.row_violations(_dataset(spark, d))


@query("v2_duplicate_ids", """WITH x AS (SELECT 'c' || o_custkey AS id, o_orderstatus AS split FROM orders) SELECT id, count(*) AS copies, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM x GROUP BY id HAVING count(*) > 1""")
def v2_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("split"))
    return validate.duplicate_ids(rows).withColumn("splits", F.array_join("splits", ","))


@query("v3_text_across_splits", f"""WITH {_DATASET}, k AS (SELECT {_KEY} AS k, split FROM x WHERE text IS NOT NULL)
SELECT sha256(k) AS key_hash, k[1:120] AS key, count(*) AS copies, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM k
  GROUP BY k HAVING count(DISTINCT split) > 1""")
def v3_text_across_splits(spark: SparkSession, d: str) -> DataFrame:
    return validate.across_splits(validate.text_duplicates(_dataset(spark, d).where("text is not null"))).withColumn("splits", F.array_join("splits", ","))


_PLACE = """x AS (SELECT c_mktsegment AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE n_name END AS location,
  CASE WHEN c_custkey % 12 <= 7 THEN 'train' WHEN c_custkey % 12 <= 9 THEN 'validation' ELSE 'test' END AS split FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("v4_record_across_splits", f"""WITH {_PLACE}, k AS (SELECT '{{"name":"' || name || '","location":' || coalesce('"' || location || '"', 'null') || '}}' AS key, split FROM x)
SELECT key, count(*) AS copies, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM k GROUP BY key HAVING count(DISTINCT split) > 1""")
def v4_record_across_splits(spark: SparkSession, d: str) -> DataFrame:
    """Canonical records of customers by segment and nation, which recur."""
    k = F.col("c_custkey") % 12
    place = F.struct(F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 7 != 0, F.col("n_name")).alias("location"))
    rows = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.when(k <= 7, "train").when(k <= 9, "validation").otherwise("test").alias("split"), sft.canonical_target(place, "struct<name:string,location:string>").alias("record_key"))
    return validate.across_splits(validate.record_duplicates(rows)).select("key", "copies", F.array_join("splits", ",").alias("splits"))


@query("v5_template_leakage", f"""WITH {_DATASET} SELECT template_id, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, 'train' AS expected_split, 'outside_split' AS problem FROM x WHERE template_id = 'template_01' GROUP BY template_id""")
def v5_template_leakage(spark: SparkSession, d: str) -> DataFrame:
    return validate.template_leakage(_dataset(spark, d)).withColumn("splits", F.array_join("splits", ","))


@query("v6_repeats_within_split", f"""WITH {_DATASET}, k AS (SELECT split, {_KEY} AS k, count(*) AS c FROM x GROUP BY ALL) SELECT split, count(*) FILTER (c > 1) AS repeated_keys FROM k GROUP BY split""")
def v6_repeats_within_split(spark: SparkSession, d: str) -> DataFrame:
    return validate.within_splits(_dataset(spark, d), T.dedup_key(F.col("text")))


@query("v7_expected_counts", f"""WITH {_DATASET}, e(split, expected) AS (VALUES ('train', 100), ('validation', 50), ('other', 7)), n AS (SELECT split, count(*) AS n FROM x GROUP BY split)
SELECT 'warning' AS severity, 'expected_count' AS rule, split, coalesce(n, 0) AS n, CAST(coalesce(expected, 0) AS BIGINT) AS expected FROM e FULL JOIN n USING (split)
  WHERE coalesce(n, 0) <> coalesce(expected, 0)""")
def v7_expected_counts(spark: SparkSession, d: str) -> DataFrame:
    return validate.expected_counts(_dataset(spark, d), {"train": 100, "validation": 50, "other": 7})


@query("v8_report", f"""WITH {_DATASET}, k AS (SELECT split, CASE WHEN id[1] = 'b' THEN 'item' ELSE lang END AS record, CASE WHEN text IS NOT NULL THEN {_KEY} END AS k, x.* EXCLUDE (split) FROM x LEFT JOIN (SELECT 'd' || doc_id AS id, lang FROM documents) USING (id)), r(severity, rule, n) AS (
  SELECT 'error', 'unknown_difficulty', count(*) FROM k WHERE length(id) % 4 = 0 UNION ALL SELECT 'error', 'missing_text', count(*) FROM k WHERE text IS NULL UNION ALL
    SELECT 'error', 'blank_text', count(*) FROM k WHERE coalesce(k, '') = ''
  UNION ALL SELECT 'error', 'missing_record_key', count(*) FROM k WHERE record IS NULL
  UNION ALL SELECT 'error', 'template_of_other_split', count(*) FROM k WHERE template_id = 'template_01' AND split <> 'train' UNION ALL SELECT 'error',
    'template_outside_split', count(DISTINCT template_id) FROM k WHERE template_id = 'template_01' AND split <> 'train'
  UNION ALL SELECT 'error', CASE WHEN n > 1 THEN 'id_in_several_splits' ELSE 'duplicate_id' END, count(*) FROM (SELECT id, count(DISTINCT split) AS n FROM k
    GROUP BY id HAVING count(*) > 1) GROUP BY ALL
  UNION ALL SELECT 'error', 'text_in_several_splits', count(*) FROM (SELECT k FROM k GROUP BY k HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'error',
    'record_in_several_splits', count(*) FROM (SELECT record FROM k GROUP BY record HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'warning', 'repeated_text', count(DISTINCT split) FROM (SELECT split, k FROM k GROUP BY ALL HAVING count(*) > 1))
SELECT severity, rule, n, NOT bool_or(severity = 'error') OVER () AS ok FROM r WHERE n > 0""")
def v8_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.report(validate.findings(_dataset(spark, d)))


@query("a9_distribution", f"WITH {_DATASET} SELECT split, template_id AS value, count(*) AS n FROM x GROUP BY ALL")
def a9_distribution(spark: SparkSession, d: str) -> DataFrame:
    return validate.distribution(_dataset(spark, d), ["split"], "template_id")


@query("f2_assign_split", f"WITH {_DATASET} SELECT split, CASE WHEN template_id <= 'template_08' THEN 'train' WHEN template_id <= 'template_10' THEN 'validation' ELSE 'test' END AS expected_split, count(*) AS n FROM x GROUP BY ALL")
def f2_assign_split(spark: SparkSession, d: str) -> DataFrame:
    return validate.assign_split(_dataset(spark, d)).groupBy("split", "expected_split").agg(F.count(F.lit(1)).alias("n"))


@query("f7_acceptable", rf"SELECT doc_id, length(text) BETWEEN 1 AND 20000 AND {_KEY} <> '' AS acceptable FROM documents")
def f7_acceptable(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.acceptable(F.col("text")).alias("acceptable"))


@query("n13_dedup_key", f"SELECT doc_id, md5({_KEY}) AS key FROM documents")
def n13_dedup_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(T.dedup_key(F.col("text"))).alias("key"))


@query("n15_redact", "SELECT doc_id, md5(replace(replace(coalesce(text, ''), 'the', '***REDACTED***'), 'token', '***REDACTED***')) AS redacted FROM documents")
def n15_redact(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"), ["the", "token"])).alias("redacted"))


# --- scalar functions on spelled columns -----------------------------------------------------------------------------------

_SPELLED = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%Y') WHEN 2 THEN strftime(o_orderdate, ' %b  %Y') WHEN 3 THEN strftime(o_orderdate, '%B %Y')
  WHEN 4 THEN strftime(o_orderdate, '%Y') ELSE 'Till Date' END"""


@query("n6_dates", f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN strftime(o_orderdate, '%Y') WHEN 5 THEN '{T.PRESENT}' ELSE strftime(o_orderdate, '%Y-%m') END AS canonical,
  trim({_SPELLED}) <> strftime(o_orderdate, '%Y-%m') AND o_orderkey % 6 < 4 AS format_only FROM orders""")
def n6_dates(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    spelled = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "MM/yyyy")).when(k == 2, F.date_format(day, "' 'MMM'  'yyyy")).when(k == 3, F.date_format(day, "MMMM yyyy")).when(k == 4, F.date_format(day, "yyyy")).otherwise("Till Date")
    rows = read(spark, d, "orders").withColumn("spelled", spelled).withColumn("plain", F.date_format(day, "yyyy-MM"))
    return rows.select("o_orderkey", T.date(F.col("spelled")).alias("canonical"), T.differs_in_format_only(F.col("spelled"), F.col("plain")).alias("format_only"))


@query("n1_n5_scalars", """SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(c_mktsegment) || '@example.org' END AS email, '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '9') AS phone,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 10 AS VARCHAR) || '.5' WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 100 AS VARCHAR) || '%' ELSE 'first class' END AS grade,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(2000 + c_custkey % 20 AS INT) END AS year, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM customer""")
def n1_n5_scalars(spark: SparkSession, d: str) -> DataFrame:
    k, rows = F.col("c_custkey"), read(spark, d, "customer")
    s = k.cast("string")
    mail = F.when(k % 5 == 0, " N/A ").otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit("@Example.org")))
    grade = F.when(k % 3 == 0, F.concat(F.lit("CGPA: "), (k % 10).cast("string"), F.lit(".5/10"))).when(k % 3 == 1, F.concat((k % 100).cast("string"), F.lit(" %"))).otherwise("first   class")
    year = F.when(k % 2 == 0, F.concat(F.lit(" "), (2000 + k % 20).cast("string"))).otherwise("20x8")
    flag = F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "0").otherwise("maybe")
    return rows.select("c_custkey", T.text(F.concat(F.lit("  "), F.col("c_name"), F.lit(" \n"))).alias("name"), T.email(mail).alias("email"), T.phone(F.concat(F.lit("+91-("), F.lpad(s, 10, "9"), F.lit(")"))).alias("phone"),
                       T.grade(grade).alias("grade"), T.year(year).alias("year"), T.flag(flag).alias("flag"))


# --- joins, limits and order over the prediction log ---------------------------------------------------------------------

@query("w2_keep_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def w2_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return compare.keep_last(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("j5_pending", f"WITH {PRED_SQL} SELECT id FROM g WHERE id NOT IN (SELECT id FROM p WHERE model = 'base')")
def j5_pending(spark: SparkSession, d: str) -> DataFrame:
    return inference.pending(_gold_records(spark, d), _predictions(spark, d).where("model = 'base'")).select("id")


@query("j6_completeness", f"WITH {PRED_SQL} SELECT m.model, count(*) AS expected, count(p.id) AS stored, count(*) = count(p.id) AS complete FROM m CROSS JOIN g LEFT JOIN p ON p.model = m.model AND p.id = g.id GROUP BY m.model")
def j6_completeness(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d).select("model", "id", F.lit(1).alias("there"))
    rows = errors.for_each_model(_gold_records(spark, d).select("id"), p).join(p, ["model", "id"], "left")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("expected"), F.count("there").alias("stored")).withColumn("complete", F.col("expected") == F.col("stored"))


@query("f3_first_n", f"WITH {GOLD_SQL} SELECT id, split FROM g ORDER BY id LIMIT 75")
def f3_first_n(spark: SparkSession, d: str) -> DataFrame:
    return _gold_records(spark, d).select("id", "split").orderBy("id").limit(75)


@query("w5_seeded_sample", f"SELECT doc_id FROM documents ORDER BY {fixtures._H("'42|' || doc_id")}, doc_id LIMIT 20")
def w5_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id").orderBy(K.keyed_hash("42", F.col("doc_id")), "doc_id").limit(20)


@query("f6_capped_lists", """SELECT split, doc_id FROM (SELECT source AS split, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10""")
def f6_capped_lists(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return read(spark, d, "documents").select(F.col("source").alias("split"), "doc_id", rank.alias("r")).where("r <= 10").drop("r")


# --- fine-tuning rows ---------------------------------------------------------------------------------------------------------

@query("t1_messages", rf"""SELECT doc_id, 2 AS turns, md5('Extract the record.' || chr(10) || chr(10) || '<DOCUMENT>' || chr(10) || regexp_replace(text, '^{_BLANKS}|{_BLANKS}$', '', 'g') || chr(10) || '</DOCUMENT>') AS user_turn FROM documents""")
def t1_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").withColumn("m", sft.messages(F.col("text")))
    return rows.select("doc_id", F.size("m").alias("turns"), F.md5(F.col("m")[1]["content"]).alias("user_turn"))


@query("t2_canonical_target", f"""WITH {GOLD_SQL} SELECT id, c_name AS name, CASE WHEN em = 1 THEN lower(c_mktsegment) || k || '@example.org' END AS email, CASE WHEN lo = 1 THEN n_name || ', ' || r_name END AS location, sk AS n_skills, ex AS n_experience,
  'name,email,phone,location,summary,skills,education,experience,projects,certifications' AS keys
FROM g JOIN customer ON c_custkey = k JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def t2_canonical_target(spark: SparkSession, d: str) -> DataFrame:
    rows = _gold_records(spark, d).select("id", sft.canonical_target(F.col("target"), RECORD_DDL).alias("json"))
    rows = rows.select("id", F.array_join(F.json_object_keys("json"), ",").alias("keys"), F.from_json("json", RECORD_DDL).alias("t"))
    return rows.select("id", "t.name", "t.email", "t.location", F.size("t.skills").cast("long").alias("n_skills"), F.size("t.experience").cast("long").alias("n_experience"), "keys")


_PAIRS = rf"""a AS (SELECT conv_id, turn, coalesce(text, '') AS target FROM conversations WHERE role = 'assistant'),
 b AS (SELECT a.conv_id, a.turn, a.target, coalesce(string_agg(c.role || ': ' || coalesce(c.text, ''), chr(10) ORDER BY c.turn), '') AS prompt FROM a LEFT
   JOIN conversations c ON c.conv_id = a.conv_id AND c.turn < a.turn GROUP BY ALL),
 c AS (SELECT conv_id, turn, list_filter(string_split_regex(prompt, '{_BLANKS}'), lambda x: x <> '') AS a, list_filter(string_split_regex(target, '{_BLANKS}'),
   lambda x: x <> '') AS b FROM b),
 w AS (SELECT conv_id, turn, list_transform(a, lambda x: {fixtures._H("x")} % 1048576 + 1) AS pi, list_transform(b, lambda x: {fixtures._H("x")} % 1048576 + 1) || [0] AS ti,
   len(pi) AS p, len(ti) AS t FROM c)"""
_IDS = lambda c: f"md5(array_to_string({c}, ','))"


def _features(spark: SparkSession, d: str, **length: int) -> DataFrame:
    words = sft.word_ids()
    shifted = lambda c: F.transform(words(c), lambda x: x + 1)  # noqa: E731  0 is the end of a text
    return sft.conversation_features(read(spark, d, "conversations"), shifted, eos=0, **length)


def _feature_rows(rows: DataFrame) -> DataFrame:
    long = lambda c: c.cast("long")
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return rows.select("conv_id", "turn", long(F.col("n_prompt")).alias("n_prompt"), long(F.col("n_target")).alias("n_target"), "truncated", digest("input_ids").alias("ids"), digest("labels").alias("labels"),
                       long(F.aggregate("attention_mask", F.lit(0), lambda n, x: n + x)).alias("attended"))


def _feature_lengths(rows: DataFrame) -> DataFrame:
    return sft.length_stats(sft.trainable(rows.withColumn("split", F.lit("train"))), ["split"]).withColumn("max_length", F.col("max_length").cast("long"))


def _feature_queries(name: str, length: int) -> None:
    """Features, their lengths and what is left without labels, at one length; ``name`` is what sets them apart."""
    ids, labels = f"list_slice(pi || ti, 1, {length})", f"list_slice(list_transform(pi, lambda x: -100) || ti, 1, {length})"
    query(f"t3_features{name}", f"WITH {_PAIRS} SELECT conv_id, turn, p AS n_prompt, t AS n_target, p + t > {length} AS truncated, {_IDS(ids)} AS ids, {_IDS(labels)} AS labels, least(p + t, {length}) AS attended FROM w")(
        lambda spark, d: _feature_rows(_features(spark, d, max_length=length)))
    query(f"t4_length_stats{name}", f"WITH {_PAIRS} SELECT 'train' AS split, count(*) AS n, count(*) FILTER (p + t > {length}) AS n_truncated, avg(least(p + t, {length})) AS mean_length, max(least(p + t, {length})) AS max_length FROM w")(
        lambda spark, d: _feature_lengths(_features(spark, d, max_length=length)))
    query(f"t5_unsupervised{name}", f"WITH {_PAIRS} SELECT conv_id, turn FROM w WHERE p >= {length}")(lambda spark, d: sft.unsupervised(_features(spark, d, max_length=length)).select("conv_id", "turn"))


_feature_queries("", 2048)
_feature_queries("_256", 256)


# --- inference ----------------------------------------------------------------------------------------------------------------

def _toy_extractor():
    import json
    import re
    mail, number = re.compile(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), re.compile(r"[0-9]+")

    def extract(text: str) -> str:
        m, n = mail.search(text), number.search(text)
        return json.dumps({"email": m[0] if m else None, "phone": n[0] if n else None, "skills": []})

    return extract


def _extractable(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")


@query("i2_inference", """SELECT 'd' || doc_id AS id, NULLIF(regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+'), '') AS email, NULLIF(regexp_extract(text, '[0-9]+'), '') AS phone, true AS schema_valid,
  row_number() OVER (ORDER BY 'd' || doc_id) AS position FROM documents""")
def i2_inference(spark: SparkSession, d: str) -> DataFrame:
    docs, path = _extractable(spark, d), files.scratch(spark)
    half = docs.where(F.col("id").endswith("1"))
    inference.run_inference(half, path, {"model": "toy"}, _toy_extractor)  # a first run that was cut short
    found = inference.positions(inference.run_inference(docs, path, {"model": "toy"}, _toy_extractor))
    rows = parse.check_schema(parse.parse_outputs(found))
    value = lambda k: F.try_variant_get("parsed", f"$.{k}", "string").alias(k)
    return rows.select("id", value("email"), value("phone"), "schema_valid", F.col("position").cast("long").alias("position"))


@query("a16_appended", f"""WITH {PRED_SQL} SELECT difficulty, template_id, count(*) AS n, {_MEASURES} FROM t WHERE model = 'base' GROUP BY GROUPING SETS ((difficulty), (template_id), ())""")
def a16_appended(spark: SparkSession, d: str) -> DataFrame:
    """Rates by slice from sums that grew with the predictions: a part, then the rest, of which only what was new was parsed."""
    gold, path = _gold(spark, d), files.scratch(spark)
    outputs = _predictions(spark, d).where("model = 'base'").select("id", F.col("raw_output").alias("text"))
    for part in (outputs.where(F.col("id").endswith("1")), outputs):
        inference.run_inference(part, f"{path}/predictions", {"model": "base"}, lambda: lambda text: text, warm_up=0)
        running_metrics.update(f"{path}/predictions", f"{path}/metrics", gold, "base", ["difficulty", "template_id"])
    whole = None
    for by in (["difficulty"], ["template_id"], []):
        rows = running_metrics.rates(spark, f"{path}/metrics", by)
        columns = [F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in ("difficulty", "template_id")]
        rows = rows.select(*columns, "n", *evaluate.RATES)
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


@query("i1_refusals", """SELECT unnest(['first', 'resume', 'fresh', 'force']) AS mode, unnest(['one', 'other', 'other', 'other']) AS settings, unnest([false, true, true, false]) AS refused, count(*) AS stored FROM documents""")
def i1_refusals(spark: SparkSession, d: str) -> DataFrame:
    """What each mode does to predictions that were stored under other settings."""
    docs, path, out = _extractable(spark, d), files.scratch(spark), []
    for mode, settings in (("first", "one"), ("resume", "other"), ("fresh", "other"), ("force", "other")):
        refused = False
        try:
            inference.run_inference(docs, path, {"model": settings}, _toy_extractor, "resume" if mode == "first" else mode)
        except inference.StaleCache:
            refused = True
        out.append((mode, settings, refused, inference.stored(spark, path).count()))
    return spark.createDataFrame(out, "mode string, settings string, refused boolean, stored long")


@query("i3_modes", """SELECT unnest(['resume', 'resume again', 'fresh', 'force']) AS run, count(*) * unnest([1, 1, 2, 1]) AS stored, count(*) AS predicted, count(*) * unnest([1, 0, 1, 1]) AS scored FROM documents""")
def i3_modes(spark: SparkSession, d: str) -> DataFrame:
    """Rows stored, examples with a prediction, and rows that the run scored, mode after mode."""
    docs, path, out, before = _extractable(spark, d), files.scratch(spark), [], 0
    for run in ("resume", "resume again", "fresh", "force"):
        predicted = inference.run_inference(docs, path, {"model": "toy"}, _toy_extractor, run.split()[0], rows_per_chunk=5_000).count()
        stored = inference.stored(spark, path).count()
        out.append((run, stored, predicted, stored if run == "force" else stored - before))
        before = stored
    return spark.createDataFrame(out, "run string, stored long, predicted long, scored long")


# --- synthetic corpus -----------------------------------------------------------------------------------------------------------

def _named(spark: SparkSession, d: str) -> DataFrame:
    """As many examples as there are documents: of eight, six are train, one validation, one test."""
    k = F.col("doc_id") % 8
    split = F.when(k < 6, "train").when(k == 6, "validation").otherwise("test")
    index = F.floor(F.col("doc_id") / 8) * F.when(k < 6, 6).otherwise(1) + F.when(k < 6, k).otherwise(0)
    return corpus.keys_for(read(spark, d, "documents").select(F.col("doc_id").alias("n"), split.alias("split"), index.alias("index")))


_NAMED = """x AS (SELECT doc_id AS n, CASE WHEN doc_id % 8 < 6 THEN 'train' WHEN doc_id % 8 = 6 THEN 'validation' ELSE 'test' END AS split,
   CASE WHEN doc_id % 8 < 6 THEN (doc_id // 8) * 6 + doc_id % 8 ELSE doc_id // 8 END AS i FROM documents),
 y AS (SELECT 'resume_' || lpad(CAST(n + 1 AS VARCHAR), 6, '0') AS id, split, CASE split WHEN 'train' THEN 1 + i % 8 WHEN 'validation' THEN 9 + i % 2
   ELSE 11 + i % 2 END AS number, i AS index FROM x),
 z AS (SELECT *, '42|' || split || '|' || number || '|' || index AS key FROM y)"""


@query("g1_g2_keys", f"WITH {_NAMED} SELECT id, split, CAST(number AS INT) AS number, CAST(index AS INT) AS index, {fixtures._H("key || '|first'")} AS first_draw FROM z")
def g1_g2_keys(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("id", "split", "number", "index", K.keyed_hash(F.col("key"), "first").alias("first_draw"))


_D = lambda slot: fixtures._H(f"key || '|{slot}'")


@query("g3_contact", f"""WITH {_NAMED} SELECT id, number NOT IN (5, 11) AND {_D("email")} / 4294967296.0 < 0.70 AS has_email, CASE WHEN number NOT IN (5, 11) AND {_D("phone")} / 4294967296.0 < 0.65 THEN
  CASE WHEN {_D("country")} / 4294967296.0 < 0.75 THEN '+91-' || (6 + {_D("p1")} % 4) || lpad(CAST({_D("p2")} % 1000000000 AS VARCHAR), 9, '0')
  ELSE '+1-' || (200 + {_D("p3")} % 790) || '-' || (200 + {_D("p4")} % 790) || '-' || (1000 + {_D("p5")} % 9000) END END AS phone FROM z""")
def g3_contact(spark: SparkSession, d: str) -> DataFrame:
    return corpus.records(_named(spark, d)).select("id", F.col("email").isNotNull().alias("has_email"), "phone")


_U = lambda slot: f"({_D(slot)} / 4294967296.0)"
_STUDY = f"e AS (SELECT *, 2008 + {_D('study start')} % 11 AS a, 3 + {_D('study years')} % 2 AS y, {_U('post')} < 0.30 AND a + y + 2 <= 2022 AS post, a + y + CASE WHEN post THEN 2 ELSE 0 END AS career FROM z)"
_GRADE = lambda kind: f"""CASE WHEN {_U(kind + " grade")} < 0.25 THEN CASE WHEN {_U(kind + " grade kind")} < 0.5 THEN 'points' ELSE (60 + {_D(kind + " grade percent")} % 36) || '%' END END"""


@query("g4_education", f"""WITH {_NAMED}, {_STUDY} SELECT id, CAST(CASE WHEN post THEN 2 ELSE 1 END AS INT) AS n, CAST(career AS INT) AS career_start, CAST(CASE WHEN post THEN a + y ELSE a END AS INT) AS start_year,
  CAST(career AS INT) AS end_year, CASE WHEN post THEN {_GRADE("second degree")} ELSE {_GRADE("first degree")} END AS grade,
    {corpus.SUBJECTS}[1 + {_D("first degree subject")} % {len(corpus.SUBJECTS)}] AS first_field FROM e""")
def g4_education(spark: SparkSession, d: str) -> DataFrame:
    """The newest entry, with points only marked as such, and the field of the oldest."""
    newest, points = F.col("education")[0], F.col("education")[0]["grade"]
    return corpus.records(_named(spark, d)).select(
        "id", F.size("education").alias("n"), "career_start", newest["start_year"].alias("start_year"), newest["end_year"].alias("end_year"),
        F.when(points.rlike("^([6-8][.][0-9]|9[.][0-8])$"), "points").otherwise(points).alias("grade"), F.element_at("education", -1)["field"].alias("first_field"),
    )


_JOBS = f"""j AS (SELECT *, (2026 - career) * 12 AS m, 1 + {_D("jobs")} % greatest(1, least(3, m // 12)) AS n FROM e),
 w AS (SELECT *, list_transform(range(1, n + 1), lambda i: 1 + {fixtures._H("key || '|weight|' || i")} % 100) AS w FROM j), l AS (SELECT *, list_transform(w,
   lambda x: 5 + CAST(floor((m - 5 * n) * x / list_sum(w)) AS BIGINT)) AS len FROM w),
 q AS (SELECT *, unnest(range(1, n + 1)) AS i FROM l), v AS (SELECT *, coalesce(list_sum(len[1:i - 1]), 0) AS since, CASE WHEN i = n THEN m
   ELSE list_sum(len[1:i]) END - 1 AS upto, i = n AND {_U("current")} < 0.70 AS current FROM q)"""


@query("g5_experience", f"""WITH {_NAMED}, {_STUDY}, {_JOBS}
SELECT id, CAST(career AS INT) AS career_start, n - i AS place, (career + since // 12) || '-' || lpad(CAST(since % 12 + 1 AS VARCHAR), 2, '0') AS start_date,
  CASE WHEN NOT current THEN (career + upto // 12) || '-' || lpad(CAST(upto % 12 + 1 AS VARCHAR), 2, '0') END AS end_date, current,
    1 + {fixtures._H("key || '|duties|' || i")} % 4 AS duties,
  CASE WHEN {fixtures._H("key || '|job place|' || i")} / 4294967296.0 < 0.30 THEN {corpus.CITIES}[1 + {fixtures._H("key || '|job city|' || i")} % {len(corpus.CITIES)}] END AS location FROM v""")
def g5_experience(spark: SparkSession, d: str) -> DataFrame:
    # every record has a job; the plain form would ask for that first, before records are dealt, and make each twice
    rows = corpus.records(_named(spark, d)).select("id", "career_start", F.posexplode_outer("experience").alias("place", "job"))
    job = F.col("job")
    return rows.select("id", "career_start", F.col("place").cast("long").alias("place"), job["start_date"].alias("start_date"), job["end_date"].alias("end_date"), job["current"].alias("current"),
                       F.size(job["responsibilities"]).cast("long").alias("duties"), job["location"].alias("location"))


@query("g6_extras", f"""WITH {_NAMED} SELECT id, {_U("summary")} < 0.75 AS has_summary, CASE WHEN number NOT IN (3, 10) AND {_U("projects")} >= 0.45 THEN 1 + {_D("n projects")} % 2 ELSE 0 END AS n_projects,
  CASE WHEN {_U("certs")} >= 0.40 THEN 1 + {_D("n certs")} % 3 ELSE 0 END AS n_certifications, CASE WHEN number IN (8, 9, 10, 11) THEN 8 + {_D("n skills")} % 7
    ELSE 4 + {_D("n skills")} % 9 END AS n_skills FROM z""")
def g6_extras(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return corpus.records(_named(spark, d)).select("id", F.col("summary").isNotNull().alias("has_summary"), size("projects").alias("n_projects"), size("certifications").alias("n_certifications"), size("skills").alias("n_skills"))


@query("g7_difficulty", """WITH r AS (SELECT c_custkey AS k, coalesce(n, 0) AS jobs FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey),
 h AS (SELECT k, k % 3 AS base, CAST(k % 8 IN (2, 5, 6,
   7) AS INT) + CAST(k % 5 = 4 AS INT) + CAST((CAST(k % 2 = 0 AS INT) + CAST(k % 3 = 0 AS INT) + CAST(k % 5 = 0 AS INT) + CAST(k % 7 = 0 AS INT) + CAST(k % 4 = 1 AS INT) + CAST(k % 6 = 1 AS INT)) >= 3 AS INT)
   + CAST(k % 13 >= 10 AS INT) + CAST(jobs * (k % 4) >= 6 AS INT) + CAST(jobs >= 3 AS INT) AS n FROM r)
SELECT k AS c_custkey, CAST(n AS INT) AS hardships, CASE base WHEN 0 THEN CASE WHEN n >= 3 THEN 'hard' WHEN n = 2 THEN 'medium' ELSE 'easy' END WHEN 1 THEN CASE
  WHEN n >= 2 THEN 'hard' ELSE 'medium' END ELSE 'hard' END AS difficulty FROM h""")
def g7_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """The rule over records made of customers and their orders."""
    k = F.col("c_custkey")
    few = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    jobs = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("jobs"))
    rows = read(spark, d, "customer").select("c_custkey").join(jobs, "c_custkey", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)).cast("int"))
    stated = {name: F.when(k % m != r, "x") for name, m, r in (("email", 2, 0), ("phone", 3, 0), ("location", 5, 0), ("summary", 7, 0))}
    lists = {"projects": few((k % 4 != 1).cast("int")), "certifications": few((k % 6 != 1).cast("int")), "skills": few(k % 13), "experience": F.transform(few(F.col("jobs")), lambda _: F.struct(few(k % 4).alias("responsibilities")))}
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    rows = rows.withColumns(stated | lists | {"hard_style": (k % 8).isin(2, 5, 6, 7), "date_policy": of(corpus.POLICIES), "base_level": (k % 3).cast("int")})
    return corpus.difficulty(rows).select("c_custkey", "hardships", "difficulty")


@query("g8_examples")
def g8_examples(spark: SparkSession, d: str) -> DataFrame:
    return corpus.examples(_named(spark, d)).select("id", "text", "metadata.template_id", "metadata.difficulty", F.size("target.skills").alias("n_skills"))


_PHONE = f"""CASE WHEN number NOT IN (5, 11) AND {_D("phone")} / 4294967296.0 < 0.65 THEN CASE WHEN {_D("country")} / 4294967296.0 < 0.75 THEN '+91-' || (6 + {_D("p1")} % 4) || lpad(CAST({_D("p2")} % 1000000000 AS VARCHAR), 9, '0')
  ELSE '+1-' || (200 + {_D("p3")} % 790) || '-' || (200 + {_D("p4")} % 790) || '-' || (1000 + {_D("p5")} % 9000) END END"""


@query("g8_read_back", f"""WITH {_NAMED}, {_STUDY}, {_JOBS}, o AS (
  SELECT id, (career + since // 12) || '-' || lpad(CAST(since % 12 + 1 AS VARCHAR), 2, '0') || '..' || CASE WHEN current THEN 'now'
    ELSE (career + upto // 12) || '-' || lpad(CAST(upto % 12 + 1 AS VARCHAR), 2, '0') END AS span,
    1 + {fixtures._H("key || '|duties|' || i")} % 4 AS duties, n - i AS place FROM v), a AS (SELECT id, string_agg(span, ',' ORDER BY place) AS jobs,
      CAST(sum(duties) AS BIGINT) AS duties FROM o GROUP BY id)
SELECT id, number NOT IN (5, 11) AND {_U("email")} < 0.70 AS has_email, {_PHONE} AS phone, CASE WHEN number IN (8, 9, 10, 11) THEN 8 + {_D("n skills")} % 7
  ELSE 4 + {_D("n skills")} % 9 END AS n_skills, jobs,
  CASE WHEN number % 4 <> 2 THEN duties END AS n_duties, true AS proven FROM z JOIN a USING (id)""")
def g8_read_back(spark: SparkSession, d: str) -> DataFrame:
    """What the texts state, read from them by template, beside what the draws say; proven: all that was read is the record's."""
    rows = corpus.proofs(corpus.examples(_named(spark, d)))
    span = F.transform("jobs", lambda x: F.concat(x["from"], F.lit(".."), x["to"]))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return rows.select("id", F.col("email").isNotNull().alias("has_email"), "phone", size("skills").alias("n_skills"), F.array_join(span, ",").alias("jobs"), size("duties").alias("n_duties"), "proven")


@query("g9_dates", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%B %Y') WHEN 1 THEN strftime(o_orderdate, '%b %Y') WHEN 2 THEN strftime(o_orderdate, '%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS spelled FROM orders""")
def g9_dates(spark: SparkSession, d: str) -> DataFrame:
    policy = F.element_at(F.array(*map(F.lit, ("full", "abbr", "slash", "iso", "year"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = read(spark, d, "orders")
    return rows.select("o_orderkey", corpus.spell_date(F.date_format("o_orderdate", "yyyy-MM"), policy, F.col("o_orderkey")).alias("spelled"))


_DIFFICULTY = f"""{_NAMED}, {_STUDY}, {_JOBS}, o AS (SELECT id, count(*) AS jobs, sum(1 + {fixtures._H("key || '|duties|' || i")} % 4) AS duties FROM v GROUP BY id),
 c AS (SELECT id, split, number, jobs, duties, CAST(number % 4 IN (2, 3) AS INT) + CAST(number BETWEEN 8 AND 11 AS INT) + CAST(number % 5 = 2 AS INT) AS hard,
   CASE WHEN number BETWEEN 8 AND 11 THEN 8 + {_D("n skills")} % 7 ELSE 4 + {_D("n skills")} % 9 END AS skills,
   CAST(number IN (5, 11) OR {_U("email")} >= 0.70 AS INT) + CAST(number IN (5, 11) OR {_U("phone")} >= 0.65 AS INT) + CAST({_U("summary")} >= 0.75 AS INT)
     + CAST(number IN (3, 10) OR {_U("projects")} < 0.45 AS INT) + CAST({_U("certs")} < 0.40 AS INT) AS absent FROM z JOIN o USING (id)),
 h AS (SELECT *, least(2, hard) AS base, CAST(hard > 0 AS INT) + CAST(number % 5 = 4 AS INT) + CAST(absent >= 3 AS INT) + CAST(skills >= 10 AS INT) + CAST(duties >= 6 AS INT) + CAST(jobs >= 3 AS INT) AS n FROM c),
 y2 AS (SELECT *, 'template_' || lpad(CAST(number AS VARCHAR), 2, '0') AS template_id,
   CASE base WHEN 0 THEN CASE WHEN n >= 3 THEN 'hard' WHEN n = 2 THEN 'medium' ELSE 'easy' END WHEN 1 THEN CASE WHEN n >= 2 THEN 'hard' ELSE 'medium' END
     ELSE 'hard' END AS difficulty FROM h)"""


@query("g7_corpus", f"WITH {_DIFFICULTY} SELECT id, CAST(n AS INT) AS hardships, difficulty FROM y2")
def g7_corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpus.records(_named(spark, d)).select("id", "hardships", "difficulty")


@query("g11_manifest", f"WITH {_DIFFICULTY} SELECT split, template_id, difficulty, count(*) AS n FROM y2 GROUP BY GROUPING SETS ((split, template_id), (split, difficulty), (split))")
def g11_manifest(spark: SparkSession, d: str) -> DataFrame:
    return corpus.manifest(corpus.examples(_named(spark, d)))


@query("g11_whole_manifest", f"""WITH {_DIFFICULTY}, t AS (SELECT 'template_' || lpad(CAST(n AS VARCHAR), 2, '0') AS name, CASE WHEN n <= 8 THEN 'train' WHEN n <= 10 THEN 'validation' ELSE 'test' END AS split FROM range(1, 13) r(n))
SELECT 'count' AS kind, split AS name, CAST(count(*) AS VARCHAR) AS value FROM y2 GROUP BY split UNION ALL SELECT 'template', split || '/' || template_id,
  CAST(count(*) AS VARCHAR) FROM y2 GROUP BY ALL
UNION ALL SELECT 'difficulty', split || '/' || difficulty, CAST(count(*) AS VARCHAR) FROM y2 GROUP BY ALL UNION ALL SELECT 'template_split', name, split FROM t UNION ALL
  SELECT DISTINCT 'sha256', split, 'true' FROM y2""")
def g11_whole_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Counts, the split of each template, and for each split whether its files have the digests that the manifest names, by a second way of reading them."""
    path, rows = files.scratch(spark), files.written(corpus.examples(_named(spark, d)))
    files.write_splits(rows.withColumn("split", F.col("metadata.split")), path)
    stated = corpus.whole_manifest(rows, files.manifest(spark, path, "*.json"))
    split = F.regexp_extract("name", "^split=([^/]+)/", 1)
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    whole = whole.select(F.regexp_extract("_metadata.file_path", "split=[^/]+/[^/]+$", 0).alias("name"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))
    digests = stated.where("kind = 'sha256'").join(whole, "name", "left")
    digests = digests.groupBy(split.alias("name")).agg(F.bool_and(F.coalesce(F.col("value") == F.col("sha256"), F.lit(False))).cast("string").alias("value"))
    return stated.where("kind <> 'sha256'").unionByName(digests.select(F.lit("sha256").alias("kind"), "name", "value"))


# --- files ------------------------------------------------------------------------------------------------------------------------

@query("s1_s2_json_round_trip", f"WITH {_NAMED} SELECT id, split, true AS same FROM z")
def s1_s2_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """same: whether text, record and metadata come back as they were."""
    path, rows = files.scratch(spark), files.written(corpus.examples(_named(spark, d)))  # made once, not for the ranges, the files and the comparison
    files.write_splits(rows.withColumn("split", F.col("metadata.split")), path)
    whole = lambda df: df.select("id", F.col("metadata.split").alias("split"), F.to_json(F.struct("text", "target", "metadata"), {"ignoreNullFields": "false"}).alias("all"))
    back = whole(files.read_jsonl(spark, path, EXAMPLE_DDL))
    return back.join(whole(rows).select("id", F.col("all").alias("was")), "id", "left").select("id", "split", F.col("all").eqNullSafe(F.col("was")).alias("same"))


@query("s4_s5_csv_round_trip", f"WITH {PRED_SQL} SELECT model, count(*) AS n FROM p GROUP BY model")
def s4_s5_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.write_report_csv(_predictions(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n")), path)
    return files.read_report_csv(spark, path, "model string, n long")


@query("s6_s7_manifest", """WITH f AS (SELECT c_nationkey AS k, string_agg(c_custkey || '|' || c_name || chr(10), '' ORDER BY c_custkey) AS content FROM customer GROUP BY ALL)
SELECT 'c_nationkey=' || k AS folder, octet_length(encode(content)) AS bytes, sha256(content) AS sha256, CASE k % 4 WHEN 1 THEN 'size' WHEN 2 THEN 'content'
  ELSE 'ok' END AS problem FROM f
UNION ALL SELECT 'gone', 7, '0', 'missing'""")
def s6_s7_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A folder of text files, one a nation, and its check against a manifest in which some entries are wrong and one is too many."""
    path = files.scratch(spark)
    lines = read(spark, d, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    lines.select("c_nationkey", F.concat_ws("|", "c_custkey", "c_name").alias("value")).write.partitionBy("c_nationkey").text(path)
    listing = files.manifest(spark, path, "*.txt")
    turn = F.regexp_extract("path", "=([0-9]+)/", 1).cast("int") % 4
    expected = listing.select("path", (F.col("bytes") + F.when(turn == 1, 1).otherwise(0)).alias("bytes"), F.when(turn == 2, "0").otherwise(F.col("sha256")).alias("sha256"))
    expected = expected.unionByName(spark.range(1).select(F.lit("gone").alias("path"), F.lit(7).cast("long").alias("bytes"), F.lit("0").alias("sha256")))
    rows = expected.select("path", F.lit("0").alias("asked")).join(listing, "path", "left").join(files.verify_manifest(expected, listing), "path", "left")
    return rows.select(F.substring_index("path", "/", 1).alias("folder"), F.coalesce("bytes", F.lit(7)).alias("bytes"), F.coalesce("sha256", "asked").alias("sha256"), F.coalesce("problem", F.lit("ok")).alias("problem"))
