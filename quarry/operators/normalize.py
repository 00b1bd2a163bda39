"""Normal forms of whole records, given as VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variant as V
from ..spec import RESUME, RecordSpec


def item_key(v: Column, spec: RecordSpec, name: str) -> Column:
    """Canonical JSON of one item of a record list, nulls kept, keys in alphabetical order; null marks a wrong type."""
    keys = spec.records[name]

    def values(x: Column) -> Column:
        def one(v: Column, how: str) -> Column:
            return V.texts(v) if how == "texts" else F.coalesce(V.normal(v, how), F.lit(False)) if how == "flag" else V.normal(v, how)

        return T.by_kind({k: x[k] for k in keys}, keys, one)

    return T.let(V.members(v, list(keys)), lambda x: F.when(x.isNotNull(), T.let(values(x), lambda own: _key(own, spec, name))))


def plain_item_key(x: Column, spec: RecordSpec, name: str) -> Column:
    """``item_key`` of an item of plain types (``variant.plain_items``)."""
    keys = spec.records[name]
    forms = {
        "text": T.text, "folded": T.email, "phone": T.phone, "grade": T.grade, "date": T.date, "year": lambda c: c, "flag": lambda c: F.coalesce(c, F.lit(False)),
        "texts": lambda c: F.coalesce(V.folded(c), F.array().cast("array<string>")),
    }
    own = F.struct(*(forms[how](x[k]).alias(k) for k, how in keys.items()))
    return F.when(x.isNotNull(), T.let(own, lambda o: _key(o, spec, name)))


def _key(x: Column, spec: RecordSpec, name: str) -> Column:
    keys = spec.records[name]
    own = {k: x[k] for k in keys}
    if name in spec.open_ended:
        flag, end = spec.open_ended[name]
        own[end] = F.when(~(x[flag] & F.coalesce(x[end] == T.PRESENT, F.lit(False))), x[end])
    whole = F.to_json(F.struct(*(own[k].alias(k) for k in sorted(own))), {"ignoreNullFields": "false"})
    wrong = [x[k].isNull() for k, how in keys.items() if how == "texts"]
    return F.when(~reduce(Column.__or__, wrong, F.lit(False)), whole)


def record_list(v: Column, spec: RecordSpec, name: str) -> Column:
    """Sorted array of item keys; null marks a wrong type anywhere; an absent list is empty."""
    fits, typed = V.plain_items(v, spec.records[name])
    keys = F.when(fits, F.transform(typed, lambda x: plain_item_key(x, spec, name))).otherwise(F.transform(V.as_array(v), lambda x: item_key(x, spec, name)))
    return F.when(V.absent(v), F.array().cast("array<string>")).otherwise(T.let(keys, lambda a: F.when(~F.exists(a, lambda k: k.isNull()), F.sort_array(a))))


def _own(v: Column, spec: RecordSpec) -> Column:
    """The fields of an object; what is no object has none."""
    return F.coalesce(V.members(v, spec.fields), V.members(F.parse_json(F.lit("{}")), spec.fields))


def _normal_fields(x: Column, spec: RecordSpec) -> Column:
    scalars = T.by_kind({f: x[f] for f in spec.scalars}, spec.scalars, V.normal)
    lists = [V.texts(x[f]).alias(f) for f in spec.lists] + [record_list(x[f], spec, f).alias(f) for f in spec.records]
    return T.let(scalars, lambda own: F.struct(*(own[f].alias(f) for f in spec.scalars), *lists))


def normal_record(v: Column, spec: RecordSpec = RESUME) -> Column:
    """struct: every field in normal form. Unknown keys are dropped; a list of null marks a type failure."""
    return T.let(_own(v, spec), lambda x: _normal_fields(x, spec))


def is_empty(v: Column) -> Column:
    """Null, an empty list or object, or a string that stands for nothing; numbers and booleans never."""
    # a list that has a first item is not empty, whatever follows; an empty one has the type of a list of nulls
    told = lambda x, k: k.isin("OBJECT<>", "ARRAY<VOID>") | (k == "STRING") & T.text(V.as_string(x)).isNull()
    bare = lambda x: T.let(V.kind(x), lambda k: F.coalesce(told(x, k), F.lit(False)))
    return T.let(v, lambda x: F.when(V.absent(x), True).when(F.try_variant_get(x, "$[0]", "variant").isNotNull(), False).otherwise(bare(x)))


def _empty_names(x: Column, spec: RecordSpec) -> Column:
    flags = T.each({f: x[f] for f in spec.fields}, is_empty)
    return T.let(flags, lambda e: F.array_compact(F.array(*(F.when(e[f], F.lit(f)) for f in spec.fields))))


def empty_fields(v: Column, spec: RecordSpec = RESUME) -> Column:
    """array<string>: names of the fields that are empty."""
    return T.let(_own(v, spec), lambda x: _empty_names(x, spec))


def forms(v: Column, spec: RecordSpec = RESUME) -> Column:
    """struct<norm, empty>: ``normal_record`` and ``empty_fields``; the fields are taken once for both."""
    return T.let(_own(v, spec), lambda x: F.struct(_normal_fields(x, spec).alias("norm"), _empty_names(x, spec).alias("empty")))


def records_equal(a: Column, b: Column) -> Column:
    """Equality of two normal records, type failures included."""
    return a.eqNullSafe(b)
