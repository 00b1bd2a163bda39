"""Model against model: last prediction for each id, rows of comparison, agreement of fields without gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import RESUME, RecordSpec
from .evaluate import normalize_predictions


def keep_last(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The row with the greatest ``order`` for each key; an aggregate, so rows are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*key, "_last.*")


def keep_first(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*key, "_first.*")


def comparison(examples: DataFrame, gold: DataFrame, keep: list[str], base: str = "base", tuned: str = "finetuned") -> DataFrame:
    """One row for each gold record: flags and F1 of both models, the change of F1 (missing counts as 0), and which are there."""
    cols = ["json_valid", "schema_valid", "exact_match", "field_f1"]
    side = lambda m: examples.where(F.col("model") == m).select("id", *(F.col(c).alias(f"{m}_{c}") for c in cols))
    rows = gold.select("id", *keep).join(side(base), "id", "left").join(side(tuned), "id", "left")
    f1 = lambda m: F.coalesce(F.col(f"{m}_field_f1"), F.lit(0.0))
    return rows.withColumns({"f1_delta": f1(tuned) - f1(base), "partial": F.col(f"{base}_field_f1").isNull() | F.col(f"{tuned}_field_f1").isNull()})


def field_relations(predictions: DataFrame, spec: RecordSpec = RESUME, base: str = "base", tuned: str = "finetuned") -> DataFrame:
    """id, field, relation of two outputs without gold: both_empty, only_base, only_finetuned, match or differs.

    An output counts only if its JSON and its schema are valid; values are compared in normal form.
    """
    rows = normalize_predictions(predictions, spec)
    usable = F.col("json_valid") & F.col("schema_valid")
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.when(usable & ~F.array_contains("pred_empty", f), F.to_json(F.struct(F.col(f"pred_norm.{f}").alias("v")))).alias("v")) for f in spec.fields))
    long = rows.select("id", "model", F.inline(values))
    wide = long.groupBy("id", "field").pivot("model", [base, tuned]).agg(F.first("v"))
    b, t = F.col(base), F.col(tuned)
    relation = F.when(b.isNull() & t.isNull(), "both_empty").when(t.isNull(), "only_base").when(b.isNull(), "only_finetuned").when(b == t, "match").otherwise("differs")
    return wide.select("id", "field", relation.alias("relation"))


def agreement(relations: DataFrame) -> DataFrame:
    return relations.groupBy("field", "relation").agg(F.count(F.lit(1)).alias("n"))
