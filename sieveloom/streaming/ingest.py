"""Incremental ingestion: an extension, the batch operators have no streams of their own.

Files that arrive in a folder are taken in once each (``availableNow``) and merged by key into a table
kept as versioned snapshots, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.sources.writers import upsert


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def snapshot(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest complete snapshot of a table, none before the first."""
    fs, p = _fs(spark, table)
    if not fs.exists(p):
        return None
    done = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("v="))
    done = [d for d in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d + "/_SUCCESS"))]
    return spark.read.parquet(done[-1]) if done else None


def merge_into(spark: SparkSession, table: str, new: DataFrame, keys: Sequence[str], version: int) -> None:
    """Write the next snapshot; of several new rows of a key the one loaded last counts."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("loaded_at")).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    old = snapshot(spark, table)
    out = one if old is None else upsert(old, one, keys)
    out.write.mode("overwrite").parquet(f"{table}/v={version:012d}")


def ingest(spark: SparkSession, source: str, schema, table: str, keys: Sequence[str], checkpoint: str, max_files: int = 1000) -> None:
    """Take in all new Parquet files of ``source`` and stop; exactly once by the checkpoint and the version."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    q = stream.writeStream.foreachBatch(lambda df, n: merge_into(spark, table, df, keys, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(stream: DataFrame, stamp: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts a window and kind of a stream or a table; rows later than the watermark are left out of a stream."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
