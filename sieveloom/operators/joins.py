"""Joins with defaults, fallbacks and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key, the one with the highest order: a build side in which the last row wins."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def fallback_join(left: DataFrame, right: DataFrame, chain: Sequence[Sequence[str]], value: str, order: str) -> DataFrame:
    """left with the value of right under the first key set of the chain that matches; null keys never match."""
    out, found = left, []
    for i, keys in enumerate(chain):
        r = right.dropna(subset=list(keys)).where(" and ".join(f"cast({k} as string) <> ''" for k in keys))
        r = last_by(r.select(*keys, value, order), keys, order).select(*[F.col(k).alias(f"_k{i}_{k}") for k in keys], F.struct(F.col(value)).alias(f"_v{i}"))
        out = out.join(r, [F.col(k) == F.col(f"_k{i}_{k}") for k in keys], "left").drop(*[f"_k{i}_{k}" for k in keys])
        found.append(f"_v{i}")
    hit = F.coalesce(*found)
    return out.withColumn(value, hit[value]).withColumn("matched", hit.isNotNull()).drop(*found)


def semi_or_all(left: DataFrame, right: DataFrame, key: str, on: str) -> DataFrame:
    """Rows of left whose (key, on) occurs in right; keys for which none occurs keep all their rows."""
    r = right.select(key, on).distinct().withColumn("_hit", F.lit(1))
    j = left.join(r, [key, on], "left")
    any_ = j.groupBy(key).agg(F.count("_hit").alias("_n"))
    return j.join(any_, key).where(F.col("_hit").isNotNull() | (F.col("_n") == 0)).drop("_hit", "_n")


def first_hit(df: DataFrame, keys: Sequence[str], priority: Column, value: str) -> DataFrame:
    """Per key the value of the lowest priority number."""
    return df.groupBy(*keys).agg(F.min_by(value, priority).alias(value))


def argmax(df: DataFrame, keys: Sequence[str], score: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; the rank filter also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*score)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
