"""Resampling by counts against a multinomial that is drawn plainly, with the same keys."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.keyed import mixed_numbers
from quarry.operators import bootstrap as B


def key(*parts, digits=8):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:digits], 16)


def uniform(seed, resample, number):
    def mixed(x):
        for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
            x = (x ^ x >> shift) * factor % 2**32
        return x ^ x >> 15

    first = mixed(number % 2**32 ^ key(seed, resample))
    second = mixed((first + key(seed, resample, "second") + (number >> 32)) % 2**32)
    return (first % 2**31 * 2**31 + second % 2**31 + 0.5) / 2**62


def quantile(draws, share, u):
    """By the distribution function, added up from 0."""
    upto = 0.0
    for k in range(draws + 1):
        upto += math.exp(math.lgamma(draws + 1) - math.lgamma(k + 1) - math.lgamma(draws - k + 1) + k * math.log(share) + (draws - k) * math.log1p(-share))
        if upto >= u:
            return k
    return draws


def plain_counts(rows, seed, resample):
    """How often a resample draws each tuple: over buckets, then over the tuples of each."""
    counts = {t: rows.count(t) for t in set(rows)}
    hashed = {t: key("|".join("" if x is None else str(x) for x in t), digits=13) for t in counts}

    def over(parts, draws):
        rest = sum(n for _, n, _ in parts)
        for name, n, number in parts:
            own = draws if n == rest else quantile(draws, n / rest, uniform(seed, resample, number))
            yield name, own
            draws, rest = draws - own, rest - n

    buckets = sorted({h >> 42 for h in hashed.values()})
    out = {}
    for bucket, draws in over([(b, sum(n for t, n in counts.items() if hashed[t] >> 42 == b), b) for b in buckets], len(rows)):
        inside = sorted((hashed[t], t) for t in counts if hashed[t] >> 42 == bucket)
        out.update(over([(t, counts[t], h + 1024) for h, t in inside], draws))
    assert sum(out.values()) == len(rows)
    return out


def test_equal_to_a_plain_multinomial(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = {m: [(int(a), int(b)) for a, b in zip(rng.integers(0, 40, n), rng.integers(0, 40, n))] for m, n in (("x", 300), ("y", 2500), ("z", 1))}
    table = spark.createDataFrame([(m, *t) for m, own in rows.items() for t in own], "model string, a int, b int").repartition(5)
    got = {(r.model, r.resample): (r.n, r.a, r.b) for r in B.resampled(table, ["model"], ["a", "b"], 8, 9).collect()}
    for m, own in rows.items():
        for r in range(8):
            drawn = plain_counts(own, 9, r)
            assert got[m, r] == (len(own), sum(t[0] * n for t, n in drawn.items()), sum(t[1] * n for t, n in drawn.items()))
    r = {x.model: x for x in B.confidence(table, ["model"], ["a", "b"], B.ratio_of_sums("a", "b"), n_boot=8, seed=9).collect()}
    values = sorted(sum(t[0] * n for t, n in d.items()) / sum(t[1] * n for t, n in d.items()) for d in (plain_counts(rows["x"], 9, k) for k in range(8)))
    assert (r["x"].low, r["x"].high) == (values[0], values[7]) and r["x"].point == sum(t[0] for t in rows["x"]) / sum(t[1] for t in rows["x"])
    # tables of any size, and rows that stand for several, give the same
    monkeypatch.setattr(B, "CELLS", 50)
    counted = table.groupBy("model", "a", "b").agg(F.count(F.lit(1)).alias("w"))
    assert {x.model: x for x in B.confidence(counted, ["model"], ["a", "b"], B.ratio_of_sums("a", "b"), n_boot=8, seed=9, weight="w").collect()} == r


def test_buckets_of_many_tuples(spark):
    rows = [(k,) for k in range(3000)] + [(5,)] * 100
    got = {r.resample: r.v for r in B.resampled(spark.createDataFrame(rows, "v int").withColumn("g", F.lit(1)), ["g"], ["v"], 2, 4).collect()}
    assert got == {r: sum(t[0] * n for t, n in plain_counts(rows, 4, r).items()) for r in range(2)}


def test_quantiles():
    rng = np.random.default_rng(1)
    for share in (1e-9, 0.003, 0.2, 0.5, 0.97, 1 - 1e-9):
        draws = rng.integers(0, 700, 200)
        u = np.concatenate([rng.random(196), [1e-8, 1e-6, 1 - 1e-6, 1 - 1e-8]])
        assert B.binomial_quantile(draws, share, u).tolist() == [quantile(int(d), share, x) for d, x in zip(draws, u)]
    assert B.binomial_quantile(np.array([5, 0]), 1.0, np.array([0.3, 0.3])).tolist() == [5, 0]


def test_the_expansion_meets_the_sums():
    u = np.random.default_rng(3).random(300)
    for draws, share in ((3_900_000, 0.5), (90_000_000, 0.01), (9_000_000, 0.9)):
        d = np.full(len(u), draws)
        exact, near = B.binomial_quantile(d, share, u), B._expanded(d, share, u)
        assert np.abs(exact - near).max() <= 1 and (exact != near).mean() < 0.02
    far = B.binomial_quantile(np.full(3, 10**12), 0.5, np.array([0.025, 0.5, 0.975]))
    assert far.tolist() == pytest.approx([5e11 - 979_982, 5e11, 5e11 + 979_982], abs=2)


def test_work_does_not_grow_with_rows(spark):
    rows = spark.createDataFrame([("m", 0, 4 * 10**11), ("m", 1, 6 * 10**11)], "model string, ok int, w long")
    r = B.confidence(rows, ["model"], ["ok"], B.mean_of("ok"), n_boot=1000, seed=1, weight="w").first()
    error = 1.96 * math.sqrt(0.24 / 10**12)
    assert r.point == 0.6 and r.low == pytest.approx(0.6 - error, abs=error / 5) and r.high == pytest.approx(0.6 + error, abs=error / 5)


def test_small_groups(spark):
    rows = spark.createDataFrame([("m", 1), ("m", 0), ("n", None)], "model string, ok int")
    r = {x.model: x for x in B.confidence(rows, ["model"], ["ok"], B.mean_of("ok"), n_boot=50, seed=1).collect()}
    assert r["m"].point == 0.5 and 0 <= r["m"].low <= 0.5 <= r["m"].high <= 1 and (r["n"].point, r["n"].low, r["n"].high) == (0, 0, 0)
    assert B.confidence(rows.limit(0), ["model"], ["ok"], B.mean_of("ok"), n_boot=5).count() == 0


def test_registered_intervals_are_of_1000_resamples(spark, tmp_path, monkeypatch):
    from quarry.plans import queries

    def brute(values, seed):
        means = sorted(plain_counts([(v,) for v in values], seed, r).get((1,), 0) / len(values) for r in range(1000))
        return sum(values) / len(values), means[25], means[975]

    quality = [int(k % 7 > 1) for k in range(40)]
    spark.createDataFrame([(q,) for q in quality], "quality int").write.parquet(str(tmp_path / "labels.parquet"))
    r = queries.QUERIES["b1_bootstrap"](spark, str(tmp_path)).first()
    assert (r.point, r.low, r.high) == pytest.approx(brute(quality, 43))
    valid, exact = [int(k % 5 > 0) for k in range(40)], [int(k % 3 > 0) for k in range(40)]
    rows = [("base", bool(v), bool(x), 3, 1, 1, 4) for v, x in zip(valid, exact, strict=True)]
    table = spark.createDataFrame(rows, "model string, schema_valid boolean, exact_match boolean, tp int, fp int, fn int, predicted_units int")
    monkeypatch.setattr(queries, "_examples", lambda spark, d: table)
    got = {r.metric: (r.point, r.low, r.high) for r in queries.QUERIES["b3_headline_intervals"](spark, "").collect()}
    assert got["schema_validity"] == pytest.approx(brute(valid, 43)) and got["exact_match"] == pytest.approx(brute(exact, 44))
    assert got["field_f1"] == pytest.approx((0.75, 0.75, 0.75)) and got["unsupported_rate"] == pytest.approx((0.25, 0.25, 0.25))


def test_mixed_numbers_are_uniform_beyond_32_bits():
    got = np.array([int(mixed_numbers(np.array([2**32 - 1]), np.array([5]), i + 2**33)[0]) for i in range(20_000)])
    assert len(set(got.tolist())) == 20_000 and got.min() >= 0 and got.max() < 2**62
    for modulus in (2, 10, 64):
        counts = np.bincount(got % modulus, minlength=modulus)
        assert ((counts - 20_000 / modulus) ** 2).sum() / (20_000 / modulus) < modulus + 6 * (2 * modulus) ** 0.5
