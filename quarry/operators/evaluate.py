"""Compare predictions with gold records: matches by field, totals, rates, latency, tables.

Everything up to the per-example table is one join on id and native expressions over each row; lists are matched inside the
row, as multisets, so no unit is shuffled. Aggregates then shuffle a few numbers for each group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch
from ..spec import RESUME, RecordSpec
from .normalize import forms, records_equal
from .parse import check_schema, parse_outputs

RATES = ["precision", "recall", "f1", "exact_match", "json_validity", "schema_validity", "unsupported_rate", "missing_rate"]
HEADLINE = [*RATES, "latency_mean", "latency_p50", "latency_p95", "output_chars_mean"]


def gold_variants(gold: DataFrame, target_col: str = "target") -> DataFrame:
    """id, gold (VARIANT) and its other columns, from typed records."""
    return gold.withColumn("gold", F.parse_json(F.to_json(F.col(target_col), {"ignoreNullFields": "false"}))).drop(target_col)


def _multiset_matches(pred: Column, gold: Column) -> Column:
    """The sum of the lesser counts of two lists' items, null if one is null: both lists in one sorted list, run after run, so the work is that of sorting."""
    side = lambda items, p, g: F.transform(items, lambda x: F.struct(x.alias("x"), F.lit(p).alias("p"), F.lit(g).alias("g")))
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("p"), F.lit(0).alias("g"), F.lit(0).alias("n"))

    def take(run: Column, item: Column) -> Column:
        same = run["x"].eqNullSafe(item["x"])
        done = run["n"] + F.when(same, 0).otherwise(F.least(run["p"], run["g"]))
        p, g = (F.when(same, run[k]).otherwise(0) + item[k] for k in "pg")
        return F.struct(item["x"].alias("x"), p.alias("p"), g.alias("g"), done.alias("n"))

    merged = F.array_sort(F.concat(side(pred, 1, 0), side(gold, 0, 1)))
    return F.when(pred == gold, F.size(gold)).otherwise(F.aggregate(merged, start, take, lambda run: run["n"] + F.least(run["p"], run["g"])))


def field_stats(name: str, pred: Column, gold: Column, pred_type_failed: Column, is_list: bool) -> Column:
    """struct<field, tp, fp, fn> of one field from normal forms; a wrong type is one wrong unit."""
    if not is_list:
        tp = F.coalesce((pred == gold).cast("int"), F.lit(0))
        return F.struct(F.lit(name).alias("field"), tp.alias("tp"), (pred.isNotNull().cast("int") - tp).alias("fp"), (gold.isNotNull().cast("int") - tp).alias("fn"))
    tp = F.coalesce(_multiset_matches(pred, gold), F.lit(0))
    size = F.coalesce(F.size(gold), F.lit(0))
    fp = F.when(pred_type_failed, 1).otherwise(F.size(pred) - tp)
    fn = F.when(pred_type_failed, (size > 0).cast("int")).otherwise(size - tp)
    return F.struct(F.lit(name).alias("field"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by id to a fixed number of tasks: they are small and much work, so their bytes say little about how many tasks they need.

    The join on id follows this partitioning, so it takes no further exchange.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "id")


def normalize_predictions(predictions: DataFrame, spec: RecordSpec = RESUME) -> DataFrame:
    """Parsed and checked outputs, with their normal record (of an empty object where there is none) and empty fields."""
    parsed = check_schema(parse_outputs(dealt(predictions)), spec)
    content = F.coalesce(F.when(F.col("is_object"), F.col("parsed")), F.parse_json(F.lit("{}")))
    rows = parsed.withColumn("_forms", forms(content, spec))
    return rows.withColumns({"pred_norm": F.col("_forms.norm"), "pred_empty": F.col("_forms.empty")}).drop("_forms")


def normalize_gold(gold: DataFrame, spec: RecordSpec = RESUME) -> DataFrame:
    rows = dealt(gold).withColumn("_forms", forms(F.col("gold"), spec))
    return rows.withColumns({"gold_norm": F.col("_forms.norm"), "gold_empty": F.col("_forms.empty")}).drop("_forms")


def evaluate_examples(predictions: DataFrame, gold: DataFrame, spec: RecordSpec = RESUME, keep: list[str] | None = None) -> DataFrame:
    """One row for each prediction with a gold record, duplicates included: flags, stats by field, totals.

    predictions: model, id, raw_output, latency_ms; gold: id, gold (VARIANT), and the columns ``keep``.
    """
    joined = normalize_predictions(predictions, spec).join(normalize_gold(gold, spec), "id")
    stats = []
    for f in spec.fields:
        is_list = f not in spec.scalars
        p, g = F.col(f"pred_norm.{f}"), F.col(f"gold_norm.{f}")
        stats.append(field_stats(f, p, g, p.isNull() if is_list else F.lit(False), is_list))
    rows = joined.withColumn("stats", F.array(*stats))
    total = lambda k: F.aggregate("stats", F.lit(0), lambda n, x: n + x[k])
    rows = rows.withColumns({k: total(k) for k in ("tp", "fp", "fn")})
    denominator = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    nonempty = F.array_except(F.array(*map(F.lit, spec.fields)), "gold_empty")
    return rows.select(
        "model", "id", *(keep or []), "json_valid", "schema_valid", "matched_via", "is_object", "stats", "tp", "fp", "fn",
        F.when(denominator == 0, 1.0).otherwise(2 * F.col("tp") / denominator).alias("field_f1"),
        (F.col("tp") + F.col("fp")).alias("predicted_units"), F.col("fp").alias("unsupported_units"),
        F.size(F.array_intersect(nonempty, "pred_empty")).alias("missing_fields"), F.size(nonempty).alias("gold_nonempty_fields"),
        (F.col("is_object") & records_equal(F.col("pred_norm"), F.col("gold_norm"))).alias("exact_match"),
        "latency_ms", F.char_length(F.coalesce("raw_output", F.lit(""))).alias("output_chars"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or nothing was counted."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def field_totals(examples: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn and precision, recall, f1 for each field and, with field null, pooled; one pass by rollup."""
    units = examples.select(*by, F.inline("stats"))
    grouped = units.groupingSets([[*by, "field"], by], *by, "field").agg(*(F.sum(k).cast("long").alias(k) for k in ("tp", "fp", "fn")))
    return grouped.withColumns(precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def _measures() -> list[Column]:
    tp, fp, fn = (F.sum(k) for k in ("tp", "fp", "fn"))
    rate = lambda flag: F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0))
    out = {
        **precision_recall_f1(tp, fp, fn), "exact_match": rate("exact_match"), "json_validity": rate("json_valid"), "schema_validity": rate("schema_valid"),
        "unsupported_rate": ratio(F.sum("unsupported_units"), F.sum("predicted_units")), "missing_rate": ratio(F.sum("missing_fields"), F.sum("gold_nonempty_fields")),
        "latency_mean": F.avg("latency_ms"), "output_chars_mean": F.coalesce(F.avg("output_chars"), F.lit(0.0)),
    }
    return [F.count(F.lit(1)).alias("n"), *(c.cast("double").alias(k) for k, c in out.items())]


def headline(examples: DataFrame, by: list[str]) -> DataFrame:
    """Rates over matched rows for each group."""
    return examples.groupBy(*by).agg(*_measures())


def sliced(examples: DataFrame, slices: list[str]) -> DataFrame:
    """The same measures for each model, and for each model and value of each slice column."""
    sets = [["model"], *(["model", s] for s in slices)]
    return examples.groupingSets(sets, "model", *slices).agg(*_measures())


DIGIT = 16  # bits of a value that one round looks at
BROADCAST_TARGETS = 100_000


def _ordered_bits(values: DataFrame, col: str) -> Column:
    """A long in the order of a number's values, NaN last."""
    if dict(values.dtypes)[col] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(col).cast("long")
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(col).cast("double") + 0.0).cast("long")  # + 0.0: one zero
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def nearest_rank(values: DataFrame, by: list[str], value_col: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: rank round-half-even(p * n + 0.5), within 1 and n.

    Exact selection by digits. A value's bits, in an order that agrees with the values', are looked at ``DIGIT`` at a time from the front: counts by group and
    digit, at most 2 ** ``DIGIT``
    of a group and combined before any shuffle, tell in which digit a rank lies, and the next round counts only values that begin like it. A rank is settled
    when the values left to it are all the same, after four rounds at most. No group is sorted, so one of all rows and a million small ones are the same work. What
    is looked for is a row for each group
    and share; it goes to the values up to ``BROADCAST_TARGETS`` rows, and beyond that both are shuffled by group. A null in ``by`` is a group.
    """
    spark, original = values.sparkSession, dict(values.dtypes)[value_col]
    path = scratch(spark)
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("all"))
    rows = values.where(F.col(value_col).isNotNull()).select(group.alias("g"), F.col(value_col).alias("v"), _ordered_bits(values, value_col).alias("bits"))
    rows.write.parquet(f"{path}/values")  # two numbers a row: what follows reads them again, and nothing of the plan before
    # flipping the first bit makes the order that of unsigned numbers
    rows = spark.read.schema(rows.schema).parquet(f"{path}/values").withColumn("bits", F.col("bits").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    wanted, settled = None, []
    for turn in range(64 // DIGIT):
        digit = F.shiftrightunsigned("bits", 64 - DIGIT * (turn + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))
        left = rows.withColumn("head", F.shiftrightunsigned("bits", 64 - DIGIT * turn) if turn else F.lit(0).cast("long"))
        if turn:
            begins = wanted.select("g", "head").distinct()
            left = left.join(F.broadcast(begins) if wanted.count() <= BROADCAST_TARGETS else begins, ["g", "head"], "left_semi")
        counts = left.groupBy("g", "head", digit.alias("digit")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy("g", "head").orderBy("digit"))
        counts = counts.withColumn("upto", upto)
        if not turn:
            ranks = [F.bround(F.lit(p) * F.col("n") + 0.5, 0).cast("long") for p in shares.values()]
            ask = [F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.least(F.col("n"), rank)).alias("rank")) for name, rank in zip(shares, ranks)]
            wanted = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("g", "n", F.lit(0).cast("long").alias("head"), F.inline(F.array(*ask)))
        found = wanted.join(counts, ["g", "head"]).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        found = found.select("g", "n", "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.shiftleft("head", DIGIT).bitwiseOR(F.col("digit")).alias("head"), "least", "most")
        found.write.parquet(f"{path}/turn{turn}")
        found = spark.read.schema(found.schema).parquet(f"{path}/turn{turn}")
        same = F.col("least").eqNullSafe(F.col("most"))
        settled.append(found.where(same))
        wanted = found.where(~same).drop("least", "most")
        if not wanted.limit(1).count():
            break
    answers = reduce(DataFrame.unionByName, settled)
    out = answers.groupBy("g").agg(F.max("n").alias("samples"), *(F.max(F.when(F.col("name") == name, F.col("least"))).cast(original).alias(name) for name in shares))
    return out.select(*(F.col(f"g.{b}").alias(b) for b in by), "samples", *shares)


def output_length(outputs: DataFrame, by: list[str], raw_col: str = "raw_output") -> DataFrame:
    """Mean characters of the raw outputs, 0 for an absent one."""
    return outputs.groupBy(*by).agg(F.avg(F.char_length(F.coalesce(F.col(raw_col), F.lit("")))).alias("mean_chars"))


def latency(examples: DataFrame, by: list[str]) -> DataFrame:
    """latency p50, p95 and the number of samples."""
    return nearest_rank(examples, by, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95})


def headline_table(examples: DataFrame, base: str = "base", tuned: str = "finetuned") -> DataFrame:
    """metric, base, finetuned, delta, partial for every rate and for mean, median and 95th percentile of the latency."""
    rows = headline(examples, ["model"]).join(latency(examples, ["model"]).drop("samples"), "model", "left")
    return compare_metrics(rows, HEADLINE, base, tuned)


def metric_rows(table: DataFrame, metrics: list[str]) -> DataFrame:
    """model, metric, value."""
    return table.unpivot(["model"], metrics, "metric", "value")


def compare_metrics(table: DataFrame, metrics: list[str] = RATES, base: str = "base", tuned: str = "finetuned") -> DataFrame:
    """metric, base, finetuned, delta and whether a model is missing (then its value and the delta are null)."""
    rows = metric_rows(table, metrics).groupBy("metric").pivot("model", [base, tuned]).agg(F.first("value"))
    return rows.select("metric", F.col(base).alias("base"), F.col(tuned).alias("finetuned"), (F.col(tuned) - F.col(base)).alias("delta"), (F.col(base).isNull() | F.col(tuned).isNull()).alias("partial"))


def per_field_table(examples: DataFrame, spec: RecordSpec = RESUME, base: str = "base", tuned: str = "finetuned") -> DataFrame:
    """position, field, precision, recall and f1 of both models and the difference of f1, in the spec's order."""
    totals = field_totals(examples, ["model"]).where("field is not null")
    wide = totals.groupBy("field").pivot("model", [base, tuned]).agg(*(F.first(k).alias(k) for k in ("precision", "recall", "f1")))
    position = F.array_position(F.array(*map(F.lit, spec.fields)), F.col("field"))
    return wide.select(position.alias("position"), "field", *(F.col(f"{m}_{k}") for m in (base, tuned) for k in ("precision", "recall", "f1")), (F.col(f"{tuned}_f1") - F.col(f"{base}_f1")).alias("delta_f1"))


def multiset_join(pred: DataFrame, gold: DataFrame, by: list[str], key: str) -> DataFrame:
    """tp, fp, fn for each group from long tables of units: the sum of the lesser counts matches.

    For lists too long to match within a row: units of both sides are counted in one aggregate, so repeated ones do not multiply and no side is sorted to meet the other.
    As in a join, a null matches nothing.
    """
    side = lambda rows, p, g: rows.select(*by, key, F.lit(p).alias("p"), F.lit(g).alias("g"))
    both = side(pred, 1, 0).unionByName(side(gold, 0, 1)).groupBy(*by, key).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*by, key)])
    least = F.when(known, F.least("p", "g")).otherwise(0)
    return both.groupBy(*by).agg(F.sum(least).alias("tp"), F.sum(F.col("p") - least).alias("fp"), F.sum(F.col("g") - least).alias("fn"))
