"""Metrics of predictions that keep coming: sums are stored, and only what is new is parsed.

Every rate of the headline is a ratio of sums over examples, so sums of parts add up. An update takes the chunks that ``inference`` has committed since the last
one, parses and matches their rows, and
stores sums by model, slices and field under the fingerprint of the predictions. Where a new prediction takes the place of an earlier one of the same id, the
sums of the earlier one are stored with a minus.
As with predictions, sums are written first and count when a row among the updates names them, so an update that is lost has changed nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import RESUME, RecordSpec
from . import inference
from .evaluate import evaluate_examples, precision_recall_f1, ratio

UPDATE_DDL = "update string, fingerprint string, attempts array<string>, parsed long"
EXAMPLE_SUMS = ["n", "exact_match", "json_valid", "schema_valid", "unsupported_units", "predicted_units", "missing_fields", "gold_nonempty_fields", "output_chars"]
UNIT_SUMS = ["tp", "fp", "fn"]


def sums(examples: DataFrame, slices: list[str], sign: Column) -> DataFrame:
    """model, slices, field (null for all), and sums of units; sums over examples stand in the row of all fields. ``sign``: 1, or -1 for an example that goes."""
    whole = F.struct(F.lit(None).cast("string").alias("field"), *(F.col(c).alias(c) for c in UNIT_SUMS))
    counts = {c: F.when(F.col("x.field").isNull(), sign * (F.lit(1) if c == "n" else F.col(c).cast("long"))).otherwise(0) for c in EXAMPLE_SUMS}
    units = {c: sign * F.col(f"x.{c}") for c in UNIT_SUMS}
    rows = examples.withColumn("x", F.explode(F.concat(F.array(whole), "stats")))
    return rows.groupBy("model", *slices, F.col("x.field").alias("field")).agg(*(F.sum(c).cast("long").alias(name) for name, c in (counts | units).items()))


def updates(spark: SparkSession, path: str) -> DataFrame:
    return inference._table(spark, f"{path}/updates", UPDATE_DDL)


def update(predictions: str, path: str, gold: DataFrame, model: str, slices: list[str], spec: RecordSpec = RESUME) -> int:
    """Bring the sums under ``path`` up to the predictions stored under ``predictions``; returns how many outputs were parsed. ``gold``: as for
    ``evaluate_examples``, with the slices.
    """
    spark = gold.sparkSession
    done = updates(spark, path)
    commits = inference.commits(spark, predictions)
    marks = commits.select("fingerprint").distinct().collect()  # one, as inference refuses a second
    if done.where(~F.col("fingerprint").isin([r.fingerprint for r in marks])).limit(1).count():
        raise inference.StaleCache("stored sums are of predictions with another fingerprint")
    known = done.select(F.explode("attempts").alias("attempt"))
    new = [r.attempt for r in commits.join(known, "attempt", "left_anti").select("attempt").distinct().collect()]  # one for each job that stored chunks
    if not new:
        return 0
    # of each id that new chunks have: its last row among them, and its last row of before, which goes
    rows = inference.stored(spark, predictions).withColumn("fresh", F.col("attempt").isin(new))
    touched = rows.where("fresh").select("id").distinct()
    last = F.row_number().over(Window.partitionBy("id", "fresh").orderBy(F.desc("at")))
    rows = rows.join(touched, "id", "left_semi").withColumn("last", last).where("last = 1")
    # the last character of the model's name tells what is added from what goes, so both are parsed in one pass
    outputs = rows.select(F.concat(F.lit(model), F.when(F.col("fresh"), "+").otherwise("-")).alias("model"), "id", "raw_output", "latency_ms")
    examples = evaluate_examples(outputs, gold.join(touched, "id", "left_semi"), spec, keep=slices)  # no other gold record is needed
    examples = examples.withColumns({"sign": F.when(F.col("model").endswith("+"), 1).otherwise(-1), "model": F.lit(model)})
    name = uuid.uuid4().hex
    sums(examples, slices, F.col("sign")).write.parquet(f"{path}/sums/update={name}")
    parsed = rows.count()
    spark.createDataFrame([(name, marks[0].fingerprint, new, parsed)], UPDATE_DDL).coalesce(1).write.mode("append").parquet(f"{path}/updates")
    return parsed


def merged(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Sums by model, ``by`` and field over all updates that count."""
    rows = spark.read.parquet(f"{path}/sums").join(updates(spark, path).select("update"), "update", "left_semi")
    return rows.groupBy("model", *by, "field").agg(*(F.sum(c).alias(c) for c in [*EXAMPLE_SUMS, *UNIT_SUMS])).where(F.col("field").isNotNull() | (F.col("n") > 0))


def field_totals(spark: SparkSession, path: str) -> DataFrame:
    """As ``evaluate.field_totals`` by model."""
    rows = merged(spark, path, []).select("model", "field", *UNIT_SUMS)
    return rows.withColumns(precision_recall_f1(*map(F.col, UNIT_SUMS)))


def rates(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """model, ``by``, n and the rates of ``evaluate.headline`` but for latencies."""
    rows = merged(spark, path, by).where("field is null")
    share = lambda c: ratio(F.col(c), F.col("n"))
    out = {
        **precision_recall_f1(*map(F.col, UNIT_SUMS)), "exact_match": share("exact_match"), "json_validity": share("json_valid"), "schema_validity": share("schema_valid"),
        "unsupported_rate": ratio(F.col("unsupported_units"), F.col("predicted_units")), "missing_rate": ratio(F.col("missing_fields"), F.col("gold_nonempty_fields")), "output_chars_mean": share("output_chars"),
    }
    return rows.select("model", *by, "n", *(c.alias(k) for k, c in out.items()))
