"""The valid records of the redelivered tables, read once for several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions.parse import canonical_class, canonical_id
from sieveloom.runtime import read


def latest(df: DataFrame, key: str, columns: list[str], stamp: str = "loaded_at") -> DataFrame:
    """One row a key: the delivery with the latest stamp; equal stamps are told apart by the columns.

    Rows without a key have no identity and are left out; a null stamp counts as the earliest.
    """
    body = F.struct(*[F.col(c) for c in columns])
    last = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(F.struct(F.col(stamp).alias("_t"), body.alias("_b"))).alias("_m"))
    return last.select(F.col(key), *[F.col(f"_m._b.{c}").alias(c) for c in columns])


def roi_records(spark: SparkSession, sf_dir: str, columns: dict) -> DataFrame:
    """Valid rows of roi_candidates with the given expressions, computed before the shuffle."""
    df = read(spark, sf_dir, "roi_candidates").select("row_id", "loaded_at", *[e.alias(c) for c, e in columns.items()])
    return latest(df, "row_id", list(columns))


def quality(c: str = "quality_score"):
    """Null counts as 1, NaN as 0."""
    q = F.col(c)
    return F.when(q.isNull(), 1.0).when(F.isnan(q), 0.0).otherwise(q)


__all__ = ["canonical_class", "canonical_id", "latest", "quality", "roi_records"]
