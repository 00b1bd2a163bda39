"""Parse raw model outputs and check them against the record schema, strictly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variant as V
from ..spec import RESUME, RecordSpec

MAX_MESSAGES = 5


def parse_outputs(outputs: DataFrame, raw_col: str = "raw_output") -> DataFrame:
    """Adds parsed (VARIANT), json_valid, matched_via (direct, code_fence, brace_slice), is_object and error.

    Each candidate text is parsed whole or not at all; the first that parses counts. Nothing is repaired.
    """
    raw = F.coalesce(F.col(raw_col), F.lit(""))

    def found(via: str, value: Column) -> Column:
        """What is kept of a value, null without one; the lambda binds it, so that the text is parsed once."""
        return T.let(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(via).alias("matched_via"), v.alias("parsed"), V.is_object(v).alias("is_object"))))

    whole = lambda read: T.let(T.strip(raw), lambda t: V.strict_json(read(t)))
    fenced = F.get(F.filter(F.transform(V.fences(raw), V.strict_json), lambda v: v.isNotNull()), F.lit(0))
    # later candidates are looked for only where those before them are none
    won = F.coalesce(found("direct", whole(lambda t: t)), F.when(F.contains(raw, F.lit(V.FENCE)), found("code_fence", fenced)), F.when(F.contains(raw, F.lit("{")), found("brace_slice", whole(V.brace_slice))))
    out = outputs.withColumn("_won", won).withColumns({"parsed": F.col("_won.parsed"), "matched_via": F.col("_won.matched_via"), "is_object": F.coalesce("_won.is_object", F.lit(False))}).drop("_won")
    valid = F.col("matched_via").isNotNull()
    return out.withColumns({
        "json_valid": valid, "error": F.when(~valid, F.when(T.strip(raw) == "", "empty output").otherwise("unparseable output")),
    })


def parse_outcomes(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Counts by outcome: how JSON was found, or why not."""
    return parsed.groupBy(*by, F.coalesce("matched_via", "error").alias("outcome"), "is_object").agg(F.count(F.lit(1)).alias("n"))


def _message(path: Column, bad: Column, text: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(bad, F.array(F.concat(path, F.lit(f": {text}")))).otherwise(none)


CHECKED = ("texts", "year", "flag")  # any other kind is a text
WORDS = ["1", "y", "yes", "t", "true", "on", "0", "n", "no", "f", "false", "off"]


def _check(v: Column, path: Column, how: str) -> Column:
    """Messages against one value; an absent key is fine, its default is used."""
    none = F.array().cast("array<string>")
    if how == "texts":
        fine = T.let(V.as_array(v), lambda items: items.isNotNull() & ~F.exists(items, lambda x: ~F.coalesce(V.kind(x) == "STRING", F.lit(False))))
        return F.when(v.isNull(), none).otherwise(_message(path, ~fine, "not a list of strings"))

    def judge(x: Column) -> Column:
        k, s, number = x["k"], x["s"], V.is_number_kind(x["k"])
        if how == "year":
            fine = (k == "STRING") & s.rlike(r"^\s*[+-]?\d+(_\d+)*(\.0+)?\s*$") | (k == "BOOLEAN") | (k == "VOID") | number & (x["d"] == F.floor(x["d"]))
            text = "not an integer"
        elif how == "flag":
            fine, text = (k == "BOOLEAN") | (k == "STRING") & F.lower(s).isin(WORDS) | number & x["d"].isin(0.0, 1.0), "not a boolean"
        else:
            fine, text = (k == "STRING") | (k == "VOID"), "not a string"
        return _message(path, ~F.coalesce(fine, F.lit(False)), text)

    parts = F.struct(V.kind(v).alias("k"), V.as_string(v).alias("s"), F.try_variant_get(v, "$", "double").alias("d"))
    return F.when(v.isNull(), none).otherwise(T.let(parts, judge))


def _checks(x: Column, prefix: Column, kinds: dict[str, str]) -> Column:
    """Messages against the members of an object, in the order of ``kinds``."""
    def one(v: Column, how: str) -> Column:
        return _check(v["v"], v["path"], how)

    values = {k: F.struct(x[k].alias("v"), F.concat(prefix, F.lit(k)).alias("path")) for k in kinds}
    return T.let(T.by_kind(values, kinds, one), lambda found: F.concat(*(found[k] for k in kinds)))


def _unknown(v: Column, path: Column, known: list[str]) -> Column:
    extra = F.array_except(F.map_keys(V.as_map(v)), F.array(*map(F.lit, known)))
    return F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda key: F.concat(path, key, F.lit(": unknown key")))


def _null_inside(x: Column, keys: dict[str, str]) -> Column:
    """Whether a typed item is null, or a member or text of it that must not be; an absent member counts as null here."""
    null = lambda k, how: x[k].isNull() | F.exists(x[k], lambda s: s.isNull()) if how == "texts" else x[k].isNull()
    return reduce(Column.__or__, [null(k, how) for k, how in keys.items() if how in ("texts", "flag")], x.isNull())


def surely_valid(v: Column, spec: RecordSpec = RESUME) -> Column:
    """Whether the type of an object and the nulls in it show that nothing is wrong with it. False says nothing."""
    texts, string_list = V.PLAIN["texts"]
    shapes = dict.fromkeys(spec.scalars, f"({V.TEXT[0]}|VOID)") | dict.fromkeys(spec.lists, texts)
    types = dict.fromkeys(spec.lists, string_list)
    for f, keys in spec.records.items():
        shapes[f], types[f] = V.plain_list(keys)
    typed = F.try_variant_get(v, "$", f"struct<{','.join(f'`{f}`:{t}' for f, t in types.items())}>")

    def whole(x: Column) -> Column:
        within = lambda keys: lambda i: _null_inside(i, keys)
        nulls = [F.exists(x[f], lambda s: s.isNull()) for f in spec.lists] + [F.exists(x[f], within(keys)) for f, keys in spec.records.items()]
        return ~reduce(Column.__or__, [F.coalesce(n, F.lit(False)) for n in nulls], F.lit(False))

    return F.coalesce(V.kind(v).rlike(f"^{V.plain_object(shapes)}\\z") & T.let(typed, whole), F.lit(False))


def schema_messages(v: Column, spec: RecordSpec = RESUME) -> Column:
    """What is wrong with an object by the record schema; unknown keys are forbidden at every level."""
    none = F.array().cast("array<string>")

    def item(keys: dict[str, str], x: Column, path: Column) -> Column:
        inner = lambda own: F.concat(_unknown(x, path, list(keys)), _checks(own, path, {k: how if how in CHECKED else "text" for k, how in keys.items()}))
        return T.let(V.members(x, list(keys)), lambda own: F.when(own.isNotNull(), inner(own)).otherwise(F.array(F.concat(path, F.lit(" not an object")))))

    def items(f: str, keys: dict[str, str], v: Column) -> Column:
        each = lambda a: F.flatten(F.transform(a, lambda x, i: item(keys, x, F.concat(F.lit(f"{f}."), i.cast("string"), F.lit(".")))))
        return F.when(v.isNull() | plain(keys, v), none).otherwise(T.let(V.as_array(v), lambda a: F.coalesce(each(a), F.array(F.lit(f"{f}: not a list")))))

    def plain(keys: dict[str, str], v: Column) -> Column:
        """A list that nothing is wrong with, told by its type and by what must not be null; where that does not tell, its items are looked at one by one."""
        fits, typed = V.plain_items(v, keys)
        return fits & ~F.exists(typed, lambda x: _null_inside(x, keys))

    def fields(x: Column) -> Column:
        own = dict.fromkeys(spec.scalars, "text") | dict.fromkeys(spec.lists, "texts")
        return F.concat(_checks(x, F.lit(""), own), *(items(f, keys, x[f]) for f, keys in spec.records.items()))

    return F.concat(_unknown(v, F.lit(""), spec.fields), T.let(V.members(v, spec.fields), fields))


def check_schema(parsed: DataFrame, spec: RecordSpec = RESUME) -> DataFrame:
    """Adds schema_valid and schema_error (the first five messages) to parsed outputs."""
    v = F.col("parsed")
    found = F.when(~F.col("is_object"), F.array(F.lit("not an object"))).when(surely_valid(v, spec), F.array().cast("array<string>")).otherwise(schema_messages(v, spec))
    out = parsed.withColumn("_messages", found)
    more = F.size("_messages") - MAX_MESSAGES
    return out.withColumns({
        "schema_valid": F.size("_messages") == 0,
        "schema_error": F.when(F.size("_messages") > 0, F.concat(F.array_join(F.slice("_messages", 1, MAX_MESSAGES), "; "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))),
    }).drop("_messages")
