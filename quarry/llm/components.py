"""Connected components by alternating large-star and small-star steps.

Every step is a group-wise minimum with map-side combine and an equi-join back that is salted: a minimum goes to ``SALTS`` tasks, the
neighbours of a node are dealt to them, so a hub with very many neighbours does not gather in one task. Each round is written to the shared folder, which cuts the lineage; links stay in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the columns of ``least`` (u and others)."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["u", "salt"]).drop("salt")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    across = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``edges`` (u, v longs), labels included."""
    edges = materialise(edges.where("u <> v").select("u", "v").distinct())
    state = _state(edges)
    for _ in range(max_rounds if state[0] else 0):
        edges = materialise(_small_star(_large_star(edges)))
        if (now := _state(edges)) == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
