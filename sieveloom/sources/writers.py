"""Sinks: files with stated columns, keyed upserts, manifests and reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    """The named columns in their order; unknown ones are dropped, absent and null cells are empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cells).write.mode(mode).option("emptyValue", "").csv(path, header=True)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new rows; null keys equal each other."""
    k = new.select(*[F.col(c).alias(f"_n_{c}") for c in keys]).distinct()
    kept = old.join(k, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def without_key(df: DataFrame, column: str, value) -> DataFrame:
    """Rows but those of one key; null keys stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str], parameters: dict) -> DataFrame:
    """Work whose key is not finished under the same parameters, with their fingerprint."""
    mark = fingerprint(parameters)
    return work.join(done.where(F.col("fingerprint") == mark).select(*keys), list(keys), "left_anti").withColumn("fingerprint", F.lit(mark))


def fingerprint(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def labels(df: DataFrame, image: str, order: str, line: Column) -> DataFrame:
    """(image, labels): the label lines of an image as one text, in order; images without lines have an empty one."""
    g = df.groupBy(image).agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(order).alias("o"), line.alias("l"))))).alias("x"))
    return g.select(image, F.concat_ws("\n", F.transform("x", lambda r: r["l"])).alias("labels"))


def manifest(df: DataFrame, path: str, by: Sequence[str] = ("group", "split", "label")) -> None:
    """A file list in place of a copied tree, partitioned by the tree's levels."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of at most ``most`` rows of a report."""
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def cached(df: DataFrame, folder: str, made_of: dict) -> DataFrame:
    """df as a table in the folder, named by a fingerprint of what it is made of; computed only if it isn't there yet.

    A table is only used when it was written to its end; one left unfinished is written again."""
    from sieveloom.sources.readers import exists

    path = f"{folder}/{fingerprint(made_of)[:24]}"
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
