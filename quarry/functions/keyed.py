"""Draws that depend on a key only, not on order or partitioning; a database with md5 gives the same numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(*key: Column | str) -> Column:
    """32 bits of the md5 of the key's parts, joined by ``|``; a string is a literal."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def mixed_numbers(first: np.ndarray, second: np.ndarray, number: int) -> np.ndarray:
    """62 bits for the number ``number`` of each stream, whose key are two numbers of 32 bits; products stay below 2 ** 63."""
    low, half = 0xFFFFFFFF, 0x7FFFFFFF

    def mixed(x: np.ndarray) -> np.ndarray:
        for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
            x = ((x ^ x >> shift) * factor) & low
        return x ^ x >> 15

    a = mixed(first ^ number & low)
    b = mixed((a + second + (number >> 32)) & low)
    return (a & half) * (1 << 31) + (b & half)


def draw(*key: Column | str) -> Column:
    """Uniform in [0, 1)."""
    return keyed_hash(*key) / F.lit(2.0**32)


def draw_int(low: Column | int, high: Column | int, *key: Column | str) -> Column:
    """Uniform integer from low to high, both included."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (low + F.pmod(keyed_hash(*key), high - low + 1)).cast("int")


def choose(values: Column, *key: Column | str) -> Column:
    """One element of an array."""
    return F.element_at(values, (F.pmod(keyed_hash(*key), F.size(values)) + 1).cast("int"))


def sample(values: Column, k: Column | int, *key: Column | str) -> Column:
    """k elements without replacement: the first in the order of their own draws."""
    ranked = F.array_sort(F.transform(values, lambda v, i: F.struct(keyed_hash(*key, i).alias("r"), i.alias("i"), v.alias("v"))))
    return F.transform(F.slice(ranked, 1, F.lit(k) if isinstance(k, int) else k), lambda s: s["v"])
