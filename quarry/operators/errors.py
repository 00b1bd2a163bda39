"""Error categories of model outputs against gold records.

Unlike the evaluator, texts are compared with their case here. Input is what ``check_schema`` gives, joined to gold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variant as V
from ..functions.keyed import keyed_hash
from ..spec import RESUME, RecordSpec
from .evaluate import dealt
from .parse import check_schema, parse_outputs

#: fixed values, in order of priority
CATEGORIES = [
    "malformed_json", "schema_violation", "list_item_error", "date_normalization_error", "section_association_error", "wrong_value", "unsupported_value",
    "over_extraction", "missing_field", "under_extraction",
]
MAX_DETAILS = 10


def _none() -> Column:
    return F.array().cast("array<struct<category:string,detail:string>>")


def _note(when: Column, category: str, detail: Column | str) -> Column:
    found = F.struct(F.lit(category).alias("category"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    return F.when(when, F.array(found)).otherwise(_none())


def _maybe(when: Column, category: str, detail: Column | str) -> Column:
    """One note, or null."""
    return F.when(when, F.struct(F.lit(category).alias("category"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))


def _bare_items(v: Column) -> Column:
    """The items of a list without their members: objects, and null for anything else; null for no list."""
    return F.try_variant_get(v, "$", "array<struct<`_`:boolean>>")


def _raw_empty(v: Column) -> Column:
    judge = lambda x: F.when(V.absent(x["v"]), True).when(x["n"].isNotNull(), x["n"] == 0).otherwise(F.coalesce(V.as_string(x["v"]) == "", F.lit(False)))
    return T.let(F.struct(v.alias("v"), F.array_size(_bare_items(v)).alias("n")), judge)


def _items(v: Column) -> Column:
    return F.coalesce(F.filter(V.as_array(v), V.is_object), F.array().cast("array<variant>"))


def _texts(v: Column) -> Column:
    """Normal texts of a list's items."""
    general = F.transform(F.coalesce(V.as_array(v), F.array().cast("array<variant>")), lambda x: V.normal(x, "text"))
    return F.when(V.kind(v) == "ARRAY<STRING>", F.transform(F.try_variant_get(v, "$", "array<string>"), lambda s: T.text(s))).otherwise(general)


def association_notes(pred: Column, gold: Column, spec: RecordSpec) -> Column:
    """pred, gold: the lists of the spec's association. Wrong or unnormalised dates of items that match the first gold item with the same two keys; else a wrong association."""
    name, first, second, dates = spec.association
    flag = spec.open_ended[name][0] if name in spec.open_ended else None
    named = lambda items: F.transform(items, lambda v: F.struct(v.alias("v"), *(V.normal(V.at(v, k), "text").alias(c) for c, k in (("a", first), ("b", second)))))

    def dated(p: Column, g: Column, key: str) -> Column:
        a, b = V.at(p, key), V.at(g, key)
        def judge(x: Column) -> Column:
            differ = x["a"].isNotNull() & x["b"].isNotNull() & (T.strip(x["a"]) != T.strip(x["b"]))
            same = x["na"].eqNullSafe(x["nb"])
            open_end = x["b"].isNull() & (x["na"] == T.PRESENT) & (V.normal(V.at(g, flag), "flag") if flag else F.lit(False))
            wrong = ~same & x["a"].isNotNull() & ~F.coalesce(open_end, F.lit(False))
            return F.concat(
                _note(F.coalesce(same & differ, F.lit(False)), "date_normalization_error", F.concat(F.lit(f"{name} {key}: "), x["a"], F.lit(" not normalised"))),
                _note(wrong, "date_normalization_error", F.concat(F.lit(f"{name} {key}: wrong date "), x["a"])),
            )
        return T.let(F.struct(V.only_string(a).alias("a"), V.only_string(b).alias("b"), V.normal(a, "date").alias("na"), V.normal(b, "date").alias("nb")), judge)

    def item(p: Column, all_gold: Column) -> Column:
        match = F.get(F.filter(all_gold, lambda g: p["a"].eqNullSafe(g["a"]) & p["b"].eqNullSafe(g["b"])), F.lit(0))
        strayed = _note(F.exists(all_gold, lambda g: p["a"].eqNullSafe(g["a"])), "section_association_error", f"{name} content stands with the wrong {second}")
        return T.let(match, lambda g: F.when(g.isNotNull(), F.concat(*(dated(p["v"], g["v"], key) for key in dates))).otherwise(strayed))

    return T.let(named(_items(gold)), lambda all_gold: F.flatten(F.transform(named(_items(pred)), lambda p: item(p, all_gold))))


def notes(pred: Column, gold: Column, spec: RecordSpec = RESUME) -> Column:
    """array<struct<category, detail>> of what differs between two objects that satisfy the schema."""
    def fields(x: Column) -> Column:
        one, several = [], []
        for f in spec.fields:
            p, g = x["pe"][f], x["ge"][f]
            one += [_maybe(~g & p, "missing_field", f"missing field: {f}"), _maybe(g & ~p, "over_extraction", f"field is empty in gold: {f}")]
        several.append(F.array_compact(F.array(*one)))
        for f, how in spec.scalars.items():
            how = "text" if how == "folded" else how
            several.append(T.let(F.struct(V.normal(x["p"][f], how).alias("p"), V.normal(x["g"][f], how).alias("g")), _scalar_judge(f)))
        for f in spec.lists:
            several.append(T.let(F.struct(_texts(x["p"][f]).alias("p"), _texts(x["g"][f]).alias("g")), _list_judge(f)))
        objects = lambda v: F.coalesce(F.size(F.array_compact(_bare_items(v))), F.lit(0))
        for f in spec.records:
            several.append(T.let(F.struct(objects(x["p"][f]).alias("p"), objects(x["g"][f]).alias("g")), _size_judge(f)))
        if spec.association:
            several.append(association_notes(x["p"][spec.association[0]], x["g"][spec.association[0]], spec))
        return F.flatten(F.array(*several))

    # members are taken once, and what is empty is found by one expression for all fields
    sides = F.struct(V.members(pred, spec.fields).alias("p"), V.members(gold, spec.fields).alias("g"))
    empty = lambda v: T.each({f: v[f] for f in spec.fields}, _raw_empty)
    return T.let(sides, lambda s: T.let(F.struct(s["p"].alias("p"), s["g"].alias("g"), empty(s["p"]).alias("pe"), empty(s["g"]).alias("ge")), fields))


def _scalar_judge(f: str):
    return lambda x: F.array_compact(F.array(
        _maybe(F.coalesce(x["p"] != x["g"], F.lit(False)), "wrong_value", F.concat(F.lit(f"{f}: "), x["p"], F.lit(" is not "), x["g"])),
        _maybe(x["g"].isNull() & x["p"].isNotNull(), "unsupported_value", F.concat(F.lit(f"{f}: unsupported "), x["p"])),
    ))


def _list_judge(f: str):
    first = lambda a: F.array_join(F.slice(a, 1, 3), ", ")
    judge = lambda more, less: F.array_compact(F.array(
        _maybe(F.size(more) > 0, "unsupported_value", F.concat(F.lit(f"unsupported {f}: "), first(more))),
        _maybe(F.size(less) > 0, "under_extraction", F.concat(F.lit(f"missing {f}: "), first(less))),
    ))
    apart = lambda x: T.let(F.struct(F.array_except(x["p"], x["g"]).alias("more"), F.array_except(x["g"], x["p"]).alias("less")), lambda d: judge(d["more"], d["less"]))
    return lambda x: F.when(x["p"] == x["g"], _none()).otherwise(apart(x))


def _size_judge(f: str):
    return lambda x: F.array_compact(F.array(
        _maybe(x["p"] > x["g"], "unsupported_value", F.concat(F.lit(f"{f}: extra items: "), (x["p"] - x["g"]).cast("string"))), _maybe(x["p"] > x["g"], "list_item_error", f"{f}: too many items"),
        _maybe(x["p"] < x["g"], "under_extraction", F.concat(F.lit(f"{f}: items missing: "), (x["g"] - x["p"]).cast("string"))), _maybe(x["p"] < x["g"], "list_item_error", f"{f}: too few items"),
    ))


MAX_MODELS = 1000


def for_each_model(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """``rows`` once for each model of ``predictions``, of which there are ``MAX_MODELS`` at most."""
    names = [r.model for r in predictions.select("model").distinct().limit(MAX_MODELS + 1).collect()]
    if len(names) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    return rows.withColumn("model", F.explode(F.array(*map(F.lit, sorted(names))) if names else F.array().cast("array<string>")))


def categorize(predictions: DataFrame, gold: DataFrame, spec: RecordSpec = RESUME, keep: list[str] | None = None) -> DataFrame:
    """One row for each model and gold record; a missing prediction counts as an empty output.

    predictions: model, id, raw_output, one row for each; gold: id, gold (VARIANT) and the columns ``keep``. Columns: model, id, keep, json_valid,
    schema_valid, categories (in order of priority), primary_category, details.
    """
    outputs = predictions.select("model", "id", "raw_output")
    rows = dealt(for_each_model(gold, predictions).join(outputs, ["model", "id"], "left")).withColumn("raw_output", F.coalesce("raw_output", F.lit("")))
    checked = check_schema(parse_outputs(rows), spec)
    found = (
        F.when(~F.col("json_valid"), _note(F.lit(True), "malformed_json", F.col("error"))).when(~F.col("is_object"), _note(F.lit(True), "malformed_json", "valid JSON but not an object"))
        .when(~F.col("schema_valid"), _note(F.lit(True), "schema_violation", F.col("schema_error"))).otherwise(notes(F.col("parsed"), F.col("gold"), spec))
    )
    categories = F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.array_contains("_categories", c))
    return (
        checked.withColumn("_notes", found).withColumn("_categories", F.transform("_notes", lambda n: n["category"])).withColumn("categories", categories)
        .select(
            "model", "id", *(keep or []), "json_valid", "schema_valid", "categories", F.coalesce(F.get("categories", F.lit(0)), F.lit("none")).alias("primary_category"),
            F.slice(F.transform("_notes", lambda n: n["detail"]), 1, MAX_DETAILS).alias("details"),
        )
    )


def summary(categorized: DataFrame) -> DataFrame:
    """position, category, model, n and share of examples, for every category also where none occurs."""
    spark = categorized.sparkSession
    names = spark.range(1).select(F.posexplode(F.array(*map(F.lit, [*CATEGORIES, "none"]))).alias("position", "category"))
    totals = categorized.groupBy("model").agg(F.count(F.lit(1)).alias("total"))
    counts = categorized.select("model", F.explode("categories").alias("category")).groupBy("model", "category").agg(F.count(F.lit(1)).alias("n"))
    grid = F.broadcast(names).crossJoin(totals)
    return grid.join(counts, ["model", "category"], "left").select("position", "category", "model", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def totals(categorized: DataFrame) -> DataFrame:
    """Examples and failures (primary category other than none) for each model."""
    return categorized.groupBy("model").agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("primary_category") != "none").alias("failures"))


def paired(categorized: DataFrame, keep: list[str] | None = None, base: str = "base", tuned: str = "finetuned") -> DataFrame:
    """id, keep, and a struct for each model; null where a model is absent."""
    state = F.struct("json_valid", "schema_valid", "categories", "primary_category", "details")
    return categorized.groupBy("id", *(keep or [])).pivot("model", [base, tuned]).agg(F.first(state))


def with_category(pairs: DataFrame, category: str | None = None, difficulty: str | None = None, model: str = "both") -> DataFrame:
    """Filter of error records: by difficulty, and by category in one model or, for ``both``, in either."""
    sides = ["base", "finetuned"] if model == "both" else [model]
    hit = F.lit(category is None)
    for side in sides if category is not None else []:
        hit = hit | F.coalesce(F.array_contains(F.col(side)["categories"], category), F.lit(False))
    return pairs.where(hit if difficulty is None else hit & (F.col("difficulty") == difficulty))


def representatives(pairs: DataFrame, scores: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """selection_reason and id: the worst and best change of F1, one schema failure won and one lost, and a random sample.

    scores: id, base_f1, finetuned_f1; a missing score counts as 0. Ties go by id. All parts come from one pass: a row stands under each reason that it may be
    chosen for, and as ranks are
    bounded, each task keeps the first few of a reason before anything is shuffled.
    """
    delta = F.coalesce("finetuned_f1", F.lit(0.0)) - F.coalesce("base_f1", F.lit(0.0))
    ok = lambda side: F.coalesce(F.col(side)["schema_valid"], F.lit(False))
    none, draw = F.lit(0).cast("long"), keyed_hash(str(seed), F.col("id"))
    reasons = [
        ("worst_delta", F.lit(True), F.col("delta"), none, 1), ("best_delta", F.lit(True), -F.col("delta"), none, 1), ("schema_fixed", ~ok("base") & ok("finetuned"), F.lit(0.0), none, 1),
        ("schema_broken", ok("base") & ~ok("finetuned"), F.lit(0.0), none, 1), ("random", F.lit(True), F.lit(0.0), draw, k),
    ]
    places = F.array(*(F.when(may, F.struct(F.lit(name).alias("selection_reason"), score.alias("score"), tie.alias("tie"), F.lit(n).alias("most"))) for name, may, score, tie, n in reasons))
    rows = pairs.join(scores, "id", "left").select("id", delta.alias("delta"), F.struct(ok("base").alias("schema_valid")).alias("base"), F.struct(ok("finetuned").alias("schema_valid")).alias("finetuned"))
    rows = rows.select("id", "delta", F.inline(F.array_compact(places)))
    order = Window.partitionBy("selection_reason").orderBy("score", "tie", "id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 1))
    return ranked.where(F.col("rank") <= F.col("most")).select("selection_reason", "id", "delta")
