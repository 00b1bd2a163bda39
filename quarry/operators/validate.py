"""Dataset quality: row rules, duplicates within and across splits, template leakage, distributions, report.

Examples: id, split, file_split, text, template_id, difficulty, schema_version, record_key (canonical JSON), schema_valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SPLITS = ("train", "validation", "test")
DIFFICULTIES = ("easy", "medium", "hard")
KEY_CHARS = 120

#: templates 1 to 8 train, 9 and 10 validation, 11 and 12 test
def template_splits(spark: SparkSession) -> DataFrame:
    n = F.col("id") + 1
    split = F.when(n <= 8, "train").when(n <= 10, "validation").otherwise("test")
    return spark.range(12).select(F.format_string("template_%02d", n).alias("template_id"), split.alias("expected_split"))


def assign_split(examples: DataFrame) -> DataFrame:
    """Adds expected_split by template; null for an unknown one."""
    return examples.join(F.broadcast(template_splits(examples.sparkSession)), "template_id", "left")


def _rule(bad: Column, rule: str, severity: str = "error") -> Column:
    found = F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))
    return F.when(F.coalesce(bad, F.lit(True)), F.array(found)).otherwise(F.array().cast("array<struct<severity:string,rule:string>>"))


def row_rules(examples: DataFrame, schema_version: str) -> Column:
    """array<struct<severity, rule>>: the row rules that a row of ``assign_split`` breaks; a row without id is reported for that alone."""
    rules = F.concat(
        *(_rule(F.col(c).isNull(), f"missing_{c}") for c in ("text", "record_key", "template_id", "difficulty", "split", "seed") if c in examples.columns),
        _rule(T.strip(F.col("text")) == "", "blank_text"), _rule(~F.col("schema_valid"), "target_schema"), _rule(F.col("split") != F.col("file_split"), "split_differs_from_file"),
        _rule(~F.col("difficulty").isin(*DIFFICULTIES), "unknown_difficulty"), _rule(F.col("schema_version") != schema_version, "schema_version"),
        # an unknown template is left to the leakage rule
        _rule(F.coalesce(F.col("expected_split") != F.col("file_split"), F.lit(False)), "template_of_other_split"),
    )
    return F.when(F.col("id").isNull(), _rule(F.lit(True), "missing_id")).otherwise(rules)


def row_violations(examples: DataFrame, schema_version: str = "1.0") -> DataFrame:
    """severity, rule, split, id of every broken row rule."""
    rows = assign_split(examples)
    return rows.select(F.col("file_split").alias("split"), "id", F.inline(row_rules(rows, schema_version))).select("severity", "rule", "split", "id")


def duplicate_ids(examples: DataFrame) -> DataFrame:
    """id, copies, splits of every id that occurs more than once."""
    return examples.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_set("split")).alias("splits")).where("copies > 1")


def duplicates(examples: DataFrame, key: Column) -> DataFrame:
    """key_hash, key (cut for display), copies, splits of keys that occur more than once; grouped by hash, so long texts are not shuffled."""
    rows = examples.select(F.sha2(key, 256).alias("key_hash"), F.substring(key, 1, KEY_CHARS).alias("key"), "split")
    return rows.groupBy("key_hash").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_set("split")).alias("splits")).where("copies > 1")


def text_duplicates(examples: DataFrame) -> DataFrame:
    return duplicates(examples, T.dedup_key(F.col("text")))


def record_duplicates(examples: DataFrame) -> DataFrame:
    return duplicates(examples, F.col("record_key"))


def across_splits(found: DataFrame) -> DataFrame:
    return found.where(F.size("splits") > 1)


def within_splits(examples: DataFrame, key: Column) -> DataFrame:
    """split and the number of keys that occur more than once in it."""
    return examples.groupBy("split", F.sha2(key, 256).alias("k")).agg(F.count(F.lit(1)).alias("c")).groupBy("split").agg(F.count_if(F.col("c") > 1).alias("repeated_keys"))


def template_leakage(examples: DataFrame) -> DataFrame:
    """template_id, splits, expected_split, problem: used outside its split, or unknown."""
    used = examples.groupBy("template_id").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    rows = assign_split(used)
    problem = F.when(F.col("expected_split").isNull(), "unknown_template").when(F.size(F.array_except("splits", F.array("expected_split"))) > 0, "outside_split")
    return rows.withColumn("problem", problem).where("problem is not null")


def distribution(examples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts of a value; missing is None."""
    return examples.groupBy(*by, F.coalesce(F.col(value).cast("string"), F.lit("None")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def expected_counts(examples: DataFrame, expected: dict[str, int]) -> DataFrame:
    """severity, rule, split, n, expected: splits with another number of rows (warning) and an empty dataset (error)."""
    spark = examples.sparkSession
    table = spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for kv in expected.items() for x in kv))).alias("split", "expected"))
    counts = examples.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    rows = table.join(counts, "split", "full").fillna(0, ["n", "expected"]).where("n <> expected").select(F.lit("warning").alias("severity"), F.lit("expected_count").alias("rule"), "split", "n", F.col("expected").cast("long").alias("expected"))
    empty = examples.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("error").alias("severity"), F.lit("empty_dataset").alias("rule"), F.lit(None).cast("string").alias("split"), "n", F.lit(None).cast("long").alias("expected"))
    return rows.unionByName(empty)


def facts(examples: DataFrame, schema_version: str = "1.0") -> DataFrame:
    """kind, key, rule, at, and over all rows of the key: copies, the number in each of ``SPLITS``, least and greatest other split.

    What every rule needs leaves a row of the examples together, as a few short keys in place of texts and records, and is added up by key in one shuffle, within
    each task before it. Kinds: row (a broken row
    rule of the id), id, text and record (digests), template, and elsewhere (a text of a split that is none of ``SPLITS``).
    """
    rows = assign_split(examples)
    text = F.sha2(T.dedup_key(F.col("text")), 256)
    fact = lambda kind, key, rule=None, at=None: F.struct(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), (F.lit(None).cast("string") if rule is None else rule).alias("rule"), (F.lit(None).cast("string") if at is None else at).alias("at"))
    broken = F.transform(row_rules(rows, schema_version), lambda r: fact("row", F.col("id"), F.concat_ws("/", r["severity"], r["rule"]), F.col("file_split")))
    known = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    shared = [fact("text", text), fact("record", F.sha2("record_key", 256)), fact("template", F.col("template_id"))]
    some = [F.when(F.col("id").isNotNull(), fact("id", F.col("id"))), F.when(~known, fact("elsewhere", text, at=F.col("split")))]
    each = rows.select("split", known.alias("known"), F.inline(F.concat(broken, F.array(*shared), F.array_compact(F.array(*some)))))
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    other = F.when(~F.col("known"), F.coalesce("split", F.lit("")))
    return each.groupBy("kind", "key", "rule", "at").agg(F.count(F.lit(1)).alias("copies"), *counts, F.min(other).alias("least"), F.max(other).alias("most"))


def findings(examples: DataFrame, schema_version: str = "1.0") -> DataFrame:
    """severity, rule, split, id or key, n: all findings from one pass over the examples; n: how often a row rule is broken so, else 1. A text that repeats
    in a split is a row of that split.
    """
    found = facts(examples, schema_version).join(F.broadcast(template_splits(examples.sparkSession)).withColumnRenamed("template_id", "key"), "key", "left")
    used = sum(((F.col(s) > 0).cast("int") for s in SPLITS[1:]), (F.col(SPLITS[0]) > 0).cast("int")) + F.when(F.col("least").isNull(), 0).when(F.col("least") == F.col("most"), 1).otherwise(2)
    outside = F.col("least").isNotNull()
    for s in SPLITS:
        outside = outside | ((F.col(s) > 0) & (F.col("expected_split") != s))
    finding = lambda severity, rule, split=None, n=None: F.struct(
        F.lit(severity).alias("severity"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), (F.lit(None) if split is None else split).cast("string").alias("split"), (F.lit(1) if n is None else n).cast("long").alias("n"))
    kind = lambda k, bad: (F.col("kind") == k) & bad
    row = F.split("rule", "/")
    out = [
        F.when(F.col("kind") == "row", F.struct(row[0].alias("severity"), row[1].alias("rule"), F.col("at").alias("split"), F.col("copies").alias("n"))),
        F.when(kind("id", F.col("copies") > 1), finding("error", F.when(used > 1, "id_in_several_splits").otherwise("duplicate_id"))),
        F.when(kind("text", used > 1), finding("error", "text_in_several_splits")), F.when(kind("record", used > 1), finding("error", "record_in_several_splits")),
        F.when(kind("template", F.col("expected_split").isNull()), finding("error", "template_unknown_template")),
        F.when(kind("template", F.col("expected_split").isNotNull() & outside), finding("error", "template_outside_split")),
        *(F.when(kind("text", F.col(s) > 1), finding("warning", "repeated_text", F.lit(s))) for s in SPLITS), F.when(kind("elsewhere", F.col("copies") > 1), finding("warning", "repeated_text", F.col("at"))),
    ]
    rows = found.select(F.col("key").alias("id"), F.inline(F.array_compact(F.array(*out))))
    return rows.select("severity", "rule", "split", "id", "n")


def violations(examples: DataFrame, schema_version: str = "1.0") -> DataFrame:
    """severity, rule, split, id or key of all findings, one table; of texts that repeat within a split, their number is a row."""
    found = findings(examples, schema_version)
    each = found.where("rule <> 'repeated_text'").select("severity", "rule", "split", "id", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")
    repeats = found.where("rule = 'repeated_text'").groupBy("severity", "rule", "split").agg(F.count(F.lit(1)).cast("string").alias("id"))
    return each.unionByName(repeats)


def report(found: DataFrame) -> DataFrame:
    """severity, rule, n, and ok: whether there is no error at all; one row of nulls and 0 where nothing was found. Takes ``findings``, or ``violations``; of
    repeated texts the splits that have some count.
    """
    n = F.sum("n") if "n" in found.columns else F.count(F.lit(1))
    rows = found.groupBy("severity", "rule", "split").agg(n.alias("n")).groupBy("severity", "rule")  # as many rows as there are rules and splits
    rows = rows.agg(F.when(F.col("rule") == "repeated_text", F.count(F.lit(1))).otherwise(F.sum("n")).alias("n"))
    whole = rows.agg(F.collect_list(F.struct("severity", "rule", "n")).alias("rows"), F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("bad"))
    return whole.select((~F.col("bad")).alias("ok"), F.inline_outer("rows")).select("severity", "rule", F.coalesce("n", F.lit(0)).alias("n"), "ok")
