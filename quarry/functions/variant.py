"""Strict JSON and typed access to values of unknown type; all native expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

NUMBERS = "^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"
FENCE = "```"


def strict_json(c: Column) -> Column:
    """The value of a JSON text, null when anything else stands in it; a lone JSON null is null as well.

    The parser stops after the first value, so the text is set into an array before its own digest: only if nothing follows the
    value is the digest the second and last element.
    """
    def judge(x: Column) -> Column:
        array, mark = x["array"], x["mark"]
        whole = (F.try_variant_get(array, "$[1]", "string") == mark) & F.try_variant_get(array, "$[2]", "variant").isNull()
        return T.let(F.when(whole, F.try_variant_get(array, "$[0]", "variant")), lambda v: F.when(~F.is_variant_null(v), v))

    mark = F.md5(c)
    return T.let(F.struct(mark.alias("mark"), F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), mark, F.lit('"]'))).alias("array")), judge)


def fences(raw: Column) -> Column:
    """array<string>: what stands in each code fence."""
    # what stands between fences: every second piece, unless no fence closes it; a language mark is no part of it
    def bodies(pieces: Column) -> Column:
        inner = F.filter(pieces, lambda _, i: (i % 2 == 1) & (i < F.size(pieces) - 1))
        body = lambda t: F.when(F.substring(t, 1, 4).isin("json", "JSON"), F.substring(t, F.lit(5), F.char_length(t))).otherwise(t)
        return F.transform(inner, lambda t: T.let(body(t), T.strip))

    return T.let(F.split(raw, FENCE, -1), bodies)


def brace_slice(text: Column) -> Column:
    """From the first to the last brace, empty without both."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def members(v: Column, keys: list[str]) -> Column:
    """struct of the values of ``keys``, taken in one go; null where v is no object. Bind it with ``let``: each use of an unbound one takes all again."""
    return F.try_variant_get(v, "$", f"struct<{','.join(f'`{k}`:variant' for k in keys)}>")


def kind(v: Column) -> Column:
    """Type of a value that is no object or array; null for an absent one."""
    return F.schema_of_variant(v)


def absent(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<`_`:boolean>").isNotNull()  # no member is taken


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def only_string(v: Column) -> Column:
    """The text of a string value, null for any other type."""
    return F.when(kind(v) == "STRING", as_string(v))


def is_number(v: Column) -> Column:
    return F.coalesce(kind(v).rlike(NUMBERS), F.lit(False))


def is_number_kind(k: Column) -> Column:
    return F.coalesce(k.rlike(NUMBERS), F.lit(False))


#: type of a value of each kind that needs no conversion (any other kind: a text), as ``schema_of_variant`` writes it, and as a column
PLAIN = {"year": ("BIGINT", "int"), "flag": ("BOOLEAN", "boolean"), "texts": ("ARRAY<(STRING|VOID)>", "array<string>")}
TEXT = ("STRING", "string")


def plain_items(v: Column, keys: dict[str, str]) -> tuple[Column, Column]:
    """Whether v is a list of objects (or nulls) with no other keys than ``keys``, each absent, null or of the plain type of its kind; and v as such a typed list."""
    shape, typed = plain_list(keys)
    return F.coalesce(kind(v).rlike(f"^{shape}\\z"), F.lit(False)), F.try_variant_get(v, "$", typed)


def plain_list(keys: dict[str, str]) -> tuple[str, str]:
    """Pattern and column type of ``plain_items``."""
    typed = ",".join(f"`{k}`:{PLAIN.get(how, TEXT)[1]}" for k, how in keys.items())
    return f"ARRAY<(VOID|{plain_object({k: f'({PLAIN.get(how, TEXT)[0]}|VOID)' for k, how in keys.items()})})>", f"array<struct<{typed}>>"


def plain_object(shapes: dict[str, str]) -> str:
    """Pattern of an object's type that has no other keys."""
    return f"OBJECT<(({'|'.join(f'{k}: {shape}' for k, shape in shapes.items())})(, |(?=>)))*+>"


def normal(v: Column, how: str) -> Column:
    """Normal form of a scalar value: numbers and booleans as texts where a text is wanted, other wrong types null."""
    return T.let(F.struct(kind(v).alias("k"), as_string(v).alias("s")), lambda x: _normal(v, x["k"], x["s"], how))


def _normal(v: Column, k: Column, s: Column, how: str) -> Column:
    if how == "year":
        return F.when(k == "BIGINT", F.try_variant_get(v, "$", "int")).when(k == "STRING", T.year(s))
    if how == "flag":
        return F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(k == "STRING", T.flag(s))
    other = F.when(k == "BOOLEAN", F.initcap(s)).when(k.rlike(NUMBERS), s)
    if how == "date":
        return F.when(k == "STRING", T.date(s)).otherwise(other)
    loose = F.when(k == "STRING", T.text(s, how == "folded")).otherwise(other)
    if how == "phone":
        return F.regexp_replace(loose, r"(?U)[\s\-.()]", "")
    if how == "grade":
        return F.when(k == "STRING", T.grade(s)).otherwise(other)
    return loose


def folded(strings: Column) -> Column:
    """Sorted array of folded texts, without those that stand for nothing."""
    return F.sort_array(F.filter(F.transform(strings, lambda s: T.text(s, fold=True)), lambda s: s.isNotNull()))


def texts(v: Column) -> Column:
    """Sorted array of folded texts; null marks a wrong type; an absent list is empty."""
    none = F.array().cast("array<string>")

    def item(x: Column) -> Column:
        """struct<bad, s>: a wrong type, and the normal form of any other."""
        def judge(i: Column) -> Column:
            fine = i["k"].isin("STRING", "BOOLEAN", "VOID") | i["k"].rlike(NUMBERS)
            return F.struct((~fine).alias("bad"), _normal(i["v"], i["k"], i["s"], "folded").alias("s"))

        return T.let(F.struct(x.alias("v"), kind(x).alias("k"), as_string(x).alias("s")), judge)

    def judged(found: Column) -> Column:
        return F.when(~F.exists(found, lambda i: i["bad"]), F.sort_array(F.filter(F.transform(found, lambda i: i["s"]), lambda x: x.isNotNull())))

    strings = F.try_variant_get(v, "$", "array<string>")
    return (
        F.when(absent(v), none).when(kind(v) == "ARRAY<STRING>", folded(strings))
        .otherwise(T.let(F.transform(as_array(v), item), judged))
    )
