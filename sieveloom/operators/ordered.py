"""Global order without a single task: ranks, running sums and exact percentiles over sorted ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.runtime import broadcast_if_small, materialize


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """df with, per name of ``sums``, the sum of its expression over all rows up to and including this one.

    Rows are range-partitioned and each range is summed by its own task; what precedes a range is the
    sum of a table with one row a range. ``order`` must be a total order (end it with an id) for a
    defined result. An empty table stays empty; null summands count as nothing.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = list(order)
    ranges = materialize(df.withColumns({f"_s_{k}": v for k, v in sums.items()}).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    heads = ranges.groupBy("_part").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    heads = heads.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.join(F.broadcast(heads), "_part")
    out = out.withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_s_{k}").over(inside), F.lit(0)) for k in sums})
    return out.drop("_part", *[f"_s_{k}" for k in sums], *[f"_b_{k}" for k in sums])


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """A number from 1 on in the global order, counted range by range."""
    return running(df, order, {name: F.lit(1).cast("long")})


def group_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """A number from 1 on within each group, counted over sorted ranges, so that a group of any size is spread
    over many tasks. Null keys are a group; ``order`` must be total within a group."""
    r = materialize(row_numbers(df, [*map(F.col, keys), *order], "_n"))
    first = r.groupBy(*keys).agg(F.min("_n").alias("_f")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    out = r.join(broadcast_if_small(first), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return out.withColumn(name, F.col("_n") - F.col("_f") + 1).drop("_n", "_f", *[f"_k_{k}" for k in keys])


def percentiles(df: DataFrame, column: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated percentiles of a column, one row a group with p0, p1, ...

    Distinct values are counted first, so what the final aggregate of a group holds is its distinct
    values; nulls are left out, NaN sorts last, a group without values has none.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    agg = F.percentile(column, F.array(*[F.lit(float(p)) for p in ps]), F.col("_n"))
    return counts.groupBy(*by).agg(agg.alias("_p")).select(*by, *[F.element_at("_p", i + 1).alias(f"p{i}") for i in range(len(ps))])


def percentiles_ranged(df: DataFrame, column: str, ps: Sequence[float]) -> DataFrame:
    """The same for one ungrouped column of any number of distinct values: only the rows at the two ranks
    around each percentile leave their ranges."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    cum = running(counts, [F.col("v")], {"upto": F.col("n")})
    total = cum.agg(F.max("upto").alias("N"))
    want = None
    for i, p in enumerate(ps):
        one = total.select(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("N") - 1)).alias("at"))
        want = one if want is None else want.unionByName(one)
    want = F.broadcast(want)  # one row a percentile
    low = cum.join(want, (F.col("upto") > F.floor("at")) & (F.col("upto") - F.col("n") <= F.floor("at"))).select("i", "at", F.col("v").alias("lo"))
    high = cum.join(want, (F.col("upto") > F.ceil("at")) & (F.col("upto") - F.col("n") <= F.ceil("at"))).select("i", F.col("v").alias("hi"))
    return low.join(high, "i").select(F.col("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("value"))
