"""Bootstrap confidence intervals by counts: how often a resample draws each distinct row, not each of its draws.

Rows with equal measures are one tuple with a count, and a resample of n rows draws tuples by a multinomial distribution. It is taken apart into binomial draws: tuples fall into
``BUCKETS`` buckets by a hash of their measures, the n draws are split over the buckets one after another, those of a bucket over its tuples, each time by the share of
what is left. A binomial draw is the quantile of a uniform number, which depends on (seed, resample, bucket or tuple) only, so a result does not depend on how rows are partitioned.

The work is resamples times distinct tuples, whatever the number of rows: a rate over a billion flags takes two tuples. One task splits a group over its
buckets, at most ``BUCKETS`` rows;
the buckets of all groups are then tasks of their own, which send a row of sums a resample.

Quantiles add up probabilities on both sides of the mean, as far as eight standard deviations. Beyond a variance of ``WIDE`` they are read off their expansion
in the normal quantile, whose error is a thousandth of a unit, before rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keyed import keyed_hash, mixed_numbers
from ..sources.files import scratch

BUCKETS = 1024
HASH_BITS = 52
WIDE = 1e6
CELLS = 1 << 20  # of a table of probabilities that is held at once

#: a statistic, from the sums of measures and the number of rows (``n``)
Statistic = Callable[[dict[str, Column]], Column]


def binomial_quantile(draws: np.ndarray, share: float, uniform: np.ndarray) -> np.ndarray:
    """The least k at which a binomial variable of ``draws`` and ``share`` has probability ``uniform`` or more not to exceed it."""
    out = np.zeros(len(draws), np.int64)
    if share >= 1:
        return draws.astype(np.int64)
    mean = draws * share
    deviation = np.sqrt(draws * share * (1 - share))
    wide = deviation * deviation > WIDE
    if wide.any():
        out[wide] = _expanded(draws[wide], share, uniform[wide])
    odds = share / (1 - share)
    low = np.maximum(np.floor(mean - 8 * deviation - 10), 0)
    high = np.minimum(np.ceil(mean + 8 * deviation + 10), draws)
    narrow = np.flatnonzero(~wide)
    order = narrow[np.argsort(high[narrow] - low[narrow], kind="stable")]
    while len(order):  # rows of like width together, as many as fit a table
        most = int(high[order[-1]] - low[order[-1]]) + 1
        some = order[-max(1, CELLS // most) :]
        order = order[: len(order) - len(some)]
        k = low[some, None] + np.arange(most - 1)
        ratio = np.where(k < high[some, None], (draws[some, None] - k) / (k + 1) * odds, 0.0)
        weight = np.cumprod(np.concatenate([np.ones((len(some), 1)), ratio], axis=1), axis=1)
        upto = np.cumsum(weight, axis=1)
        out[some] = low[some] + np.minimum((upto < (uniform[some] * upto[:, -1])[:, None]).sum(1), high[some] - low[some])
    return out


def _expanded(draws: np.ndarray, share: float, uniform: np.ndarray) -> np.ndarray:
    z = np.array([NormalDist().inv_cdf(u) for u in uniform])
    deviation, skew = np.sqrt(draws * share * (1 - share)), 1 - 2 * share
    third = z * (z * z - 3) * (1 / (draws * share * (1 - share)) - 6 / draws) / 24 - z * (2 * z * z - 5) * (skew / deviation) ** 2 / 36
    k = draws * share + deviation * (z + skew / deviation * (z * z - 1) / 6 + third) - 0.5
    return np.clip(np.ceil(k), 0, draws).astype(np.int64)


class Resamples:
    """The keys of all resamples, which give each of them a uniform number for every numbered part."""

    def __init__(self, first: list[int], second: list[int]):
        self.first, self.second = np.array(first, np.int64), np.array(second, np.int64)

    def uniform(self, number: int) -> np.ndarray:
        return (mixed_numbers(self.first, self.second, number) + 0.5) / 2.0**62

    def parts(self, draws: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> Iterator[np.ndarray]:
        """For each part, how many of ``draws``, one number a resample, fall to it."""
        left, rest = draws.copy(), counts[::-1].cumsum()[::-1]
        for count, upto, number in zip(counts.tolist(), rest.tolist(), numbers.tolist(), strict=True):
            own = left.copy() if count == upto else binomial_quantile(left, count / upto, self.uniform(number))
            left -= own
            yield own


def resampled(values: DataFrame, by: list[str], measures: list[str], n_boot: int, seed: int, weight: str | None = None) -> DataFrame:
    """by, resample, n, and the sum of each measure over what the resample drew; a null measure adds nothing. ``weight``: a column that says how many rows a row stands for."""
    spark = values.sparkSession
    keys = spark.range(n_boot).select("id", keyed_hash(str(seed), F.col("id")).alias("a"), keyed_hash(str(seed), F.col("id"), "second").alias("b")).orderBy("id").collect()
    resamples = Resamples([r.a for r in keys], [r.b for r in keys])
    text = F.concat_ws("|", *(F.coalesce(F.col(m).cast("string"), F.lit("")) for m in measures))
    tuples = values.groupBy(*by, *measures).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("c"))
    tuples = tuples.withColumn("hash", F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long"))
    tuples = tuples.withColumn("bucket", F.shiftright("hash", HASH_BITS - 10).cast("int"))
    buckets = tuples.groupBy(*by, "bucket").agg(F.sum("c").alias("c"))
    kinds = [f for f in tuples.select(*by).schema.fields]

    def over_buckets(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket", ignore_index=True)
        counts = rows["c"].to_numpy()
        parts = resamples.parts(np.full(n_boot, counts.sum()), counts, rows["bucket"].to_numpy())
        return rows[[*by, "bucket"]].assign(draws=list(parts))

    dealt = buckets.groupBy(*by).applyInPandas(over_buckets, T.StructType([*kinds, T.StructField("bucket", T.IntegerType()), T.StructField("draws", T.ArrayType(T.LongType()))]))

    def over_tuples(rows: pd.DataFrame, of_bucket: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hash", *measures], ignore_index=True)
        draws = np.asarray(of_bucket["draws"].iloc[0], np.int64)
        sums = {m: np.zeros(n_boot) for m in measures}
        weights = rows[measures].fillna(0).to_numpy(np.float64)
        for own, weight in zip(resamples.parts(draws, rows["c"].to_numpy(), rows["hash"].to_numpy() + BUCKETS), weights, strict=True):
            for m, w in zip(measures, weight, strict=True):
                sums[m] += own * w
        return pd.DataFrame({**{b: [rows[b].iloc[0]] * n_boot for b in by}, "resample": np.arange(n_boot), "n": draws, **sums})

    out = T.StructType([*kinds, T.StructField("resample", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(m, T.DoubleType()) for m in measures)])
    sums = tuples.groupBy(*by, "bucket").cogroup(dealt.groupBy(*by, "bucket")).applyInPandas(over_tuples, out)
    return sums.groupBy(*by, "resample").agg(*(F.sum(c).alias(c) for c in ("n", *measures)))


def interval(resamples: DataFrame, by: list[str], n_boot: int, alpha: float = 0.05) -> DataFrame:
    """low and high: the values of rank floor(alpha/2 * B) and min(B - 1, floor((1 - alpha/2) * B)) among the sorted resamples."""
    low, high = int(alpha / 2 * n_boot), min(n_boot - 1, int((1 - alpha / 2) * n_boot))
    ranked = resamples.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("value")) - 1)
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("rank") == low, F.col("value"))).alias("low"), F.max(F.when(F.col("rank") == high, F.col("value"))).alias("high"))


def confidence(
    values: DataFrame, by: list[str], measures: list[str], statistic: Statistic, n_boot: int = 1000, seed: int = 42, alpha: float = 0.05, weight: str | None = None
) -> DataFrame:
    """by, point, low, high of a statistic; groups without rows do not appear. ``by`` must not be null. ``weight``: as in ``resampled``."""
    times = F.col(weight) if weight else F.lit(1)
    sums = values.groupBy(*by).agg(F.sum(times).alias("n"), *(F.coalesce(F.sum(F.col(m) * times), F.lit(0)).cast("double").alias(m) for m in measures))
    value = F.coalesce(statistic({c: F.col(c) for c in ("n", *measures)}), F.lit(0.0)).cast("double")
    drawn = resampled(values, by, measures, n_boot, seed, weight).select(*by, "resample", value.alias("value"))
    return sums.select(*by, value.alias("point")).join(interval(drawn, by, n_boot, alpha), by)


def mean_of(measure: str) -> Statistic:
    return lambda s: F.try_divide(s[measure], s["n"])


def ratio_of_sums(numerator: str, denominator: str) -> Statistic:
    return lambda s: F.try_divide(s[numerator], s[denominator])


def pooled_f1(s: dict[str, Column]) -> Column:
    return F.try_divide(2 * s["tp"], 2 * s["tp"] + s["fp"] + s["fn"])


def headline_intervals(examples: DataFrame, n_boot: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """model, metric, point, low, high for schema validity, exact match, pooled F1 and the unsupported rate, each with a seed of its own."""
    names = ["schema_valid", "exact_match", "tp", "fp", "fn", "predicted_units"]
    counted = examples.groupBy("model", *(F.col(c).cast("int").alias(c) for c in names)).agg(F.count(F.lit(1)).alias("rows"))
    # distinct rows with their number, written once: each metric reads them several times, and outputs are parsed for the first
    path = scratch(examples.sparkSession)
    counted.write.parquet(path)
    rows = examples.sparkSession.read.schema(counted.schema).parquet(path)
    parts = [
        ("schema_validity", ["schema_valid"], mean_of("schema_valid"), 1), ("exact_match", ["exact_match"], mean_of("exact_match"), 2),
        ("field_f1", ["tp", "fp", "fn"], pooled_f1, 0), ("unsupported_rate", ["fp", "predicted_units"], ratio_of_sums("fp", "predicted_units"), 3),
    ]
    out = None
    for metric, measures, statistic, add in parts:
        part = confidence(rows, ["model"], measures, statistic, n_boot, seed + add, alpha, "rows").select("model", F.lit(metric).alias("metric"), "point", "low", "high")
        out = part if out is None else out.unionByName(part)
    return out
