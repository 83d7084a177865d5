"""Top lists, samples and quotas. Every order ends with a row id, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions.scores import unit_hash
from sieveloom.operators.ordered import group_ranks, row_numbers, running


def hashed(c: str, seed: int) -> Column:
    """A reproducible uniform number of a row id."""
    return unit_hash(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group; a constant k is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def top_fraction(df: DataFrame, order: Sequence[Column], ratio: float) -> DataFrame:
    """The first max(1, floor(n * ratio)) rows, by range-wise ranks."""
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(ratio))).alias("_k"))
    return row_numbers(df, order, "_r").join(F.broadcast(n), F.col("_r") <= F.col("_k")).drop("_r", "_k")


def top_balanced(df: DataFrame, kind: str, order: Sequence[Column], target: int) -> DataFrame:
    """max(1, target // number of kinds) rows of each kind."""
    k = df.agg(F.greatest(F.lit(1), F.floor(F.lit(target) / F.count_distinct(kind))).alias("_k"))
    return group_ranks(df, [kind], order, "_r").join(F.broadcast(k), F.col("_r") <= F.col("_k")).drop("_r", "_k")


def sample(df: DataFrame, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement."""
    return df.orderBy(hashed(row_id, seed), row_id).limit(k)


def sample_weighted(df: DataFrame, row_id: str, weight: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement, in proportion to weight (exponential keys); weightless rows come last, by id."""
    u = hashed(row_id, seed) + F.lit(2.0**-50)
    key = F.when(F.col(weight) > 0, F.round(-F.ln(u) / F.col(weight), 9))
    return df.orderBy(key.asc_nulls_last(), row_id).limit(k)


def equalize(df: DataFrame, arm: str, row_id: str, seed: int = 42) -> DataFrame:
    """Each arm cut down to the size of the smallest by a hashed order."""
    n = df.groupBy(arm).agg(F.count("*").alias("n")).agg(F.min("n").alias("_k"))
    r = group_ranks(df.withColumn("_u", hashed(row_id, seed)), [arm], [F.col("_u"), F.col(row_id)], "_r")
    return r.join(F.broadcast(n), F.col("_r") <= F.col("_k")).drop("_r", "_k", "_u")


def preferred_first(df: DataFrame, preferred: Column, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """k rows, preferred ones before the others, each in hashed order."""
    return df.orderBy(F.when(preferred, 0).otherwise(1), hashed(row_id, seed), row_id).limit(k)


def split(df: DataFrame, row_id: str, ratio: float, seed: int = 42) -> DataFrame:
    """df with ``train``: true for the first max(1, floor(n * ratio)) rows in hashed order."""
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(ratio))).alias("_k"))
    r = row_numbers(df.withColumn("_u", hashed(row_id, seed)), [F.col("_u"), F.col(row_id)], "_r")
    return r.crossJoin(F.broadcast(n)).withColumn("train", F.col("_r") <= F.col("_k")).drop("_r", "_k", "_u")


def group_split(df: DataFrame, group: str, ratio: float, seed: int = 42) -> DataFrame:
    """(group, train): whole groups to the training side in hashed order until it holds the ratio of the rows."""
    n = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_u", hashed(group, seed))
    cum = running(n, [F.col("_u"), F.col(group)], {"upto": F.col("n")})
    total = n.agg(F.sum("n").alias("_t"))
    before = F.col("upto") - F.col("n")
    return cum.crossJoin(F.broadcast(total)).select(group, "n", (before < F.col("_t") * F.lit(ratio)).alias("train"))


def round_robin(df: DataFrame, kind: str, row_id: str, k: int) -> DataFrame:
    """The first row of every kind, then the second, ..., k in all; kinds in the order of their first row."""
    r = top_per_group(df, [kind], [F.col(row_id)], k)  # no kind gives more than k
    r = group_ranks(r, [kind], [F.col(row_id)], "_r")
    first = df.groupBy(kind).agg(F.min(row_id).alias("_f")).withColumnRenamed(kind, "_kind")
    return r.join(first, F.col(kind).eqNullSafe(F.col("_kind"))).orderBy("_r", "_f").limit(k).drop("_r", "_f", "_kind")


def hamilton(df: DataFrame, key: str, weight: str, seats: int) -> DataFrame:
    """(key, seats): seats in proportion to weight by largest remainder, the key deciding ties. The table is
    one row a key; no positive weight at all shares them out evenly."""
    t = df.agg(F.sum(F.greatest(F.col(weight), F.lit(0.0))).alias("_t"), F.count("*").alias("_k"))
    x = df.crossJoin(F.broadcast(t))
    ideal = F.when(F.col("_t") > 0, F.greatest(F.col(weight), F.lit(0.0)) / F.col("_t")).otherwise(F.lit(1.0) / F.col("_k")) * seats
    x = x.withColumn("_q", F.round(ideal, 9)).withColumn("_f", F.floor("_q"))
    short = x.agg((F.lit(seats) - F.sum("_f")).alias("_short"))
    r = row_numbers(x.withColumn("_rest", F.round(F.col("_q") - F.col("_f"), 9)), [F.col("_rest").desc(), F.col(key)], "_r")
    return r.crossJoin(F.broadcast(short)).select(key, (F.col("_f") + F.when(F.col("_r") <= F.col("_short"), 1).otherwise(0)).cast("long").alias("seats"))
