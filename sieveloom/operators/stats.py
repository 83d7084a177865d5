"""Distributions over clusters, cells and images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions.scores import cell_key


def share(df: DataFrame, by: Sequence[str], within: Sequence[str] = (), name: str = "p") -> DataFrame:
    """Rows of each ``by`` as a share of those of ``within``; the window runs over the counts only."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    if within:
        return n.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*within)))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).withColumn(name, F.col("n") / F.col("_t")).drop("_t")


def bin_edges(df: DataFrame, features: Sequence[str], ps=(0.3333, 0.6667), digits: int = 9, least: int = 3) -> DataFrame:
    """One row: e_<feature>_0 and _1, the tertile edges; fewer than ``least`` values give 0 and 1."""
    agg = []
    for f in features:
        q = F.percentile(f, F.array(*[F.lit(p) for p in ps]))
        for i in range(2):
            agg.append(F.when(F.count(f) < least, F.lit(float(i))).otherwise(F.round(F.element_at(q, i + 1), digits)).alias(f"e_{f}_{i}"))
    return df.agg(*agg)


def image_means(df: DataFrame, features: Sequence[str], complete: bool = True, digits: int = 9) -> DataFrame:
    """Mean of each feature per image; complete: only images with a value of every feature."""
    m = df.groupBy("image_id").agg(*[F.round(F.avg(f), digits).alias(f) for f in features])
    return m.dropna(subset=list(features)) if complete else m


def with_cells(df: DataFrame, edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with the cell key of its features; edges is a single row."""
    key = cell_key([F.col(f) for f in features], [(F.col(f"e_{f}_0"), F.col(f"e_{f}_1")) for f in features])
    return df.crossJoin(F.broadcast(edges)).withColumn("cell_key", key).drop(*edges.columns)


def deficits(pairs: DataFrame, cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """max(0, p of the cell overall minus p within the cluster) for every cluster and cell that occurs at
    all; target: the deficit as a share of the cluster's, uniform where there is none. The frame is
    clusters by cells, both small dimensions of the grid."""
    frame = clusters.select("cluster_id").distinct().crossJoin(F.broadcast(cells.select("cell_key", F.col("p").alias("pg"))))
    d = frame.join(pairs.select("cluster_id", "cell_key", "p"), ["cluster_id", "cell_key"], "left")
    d = d.withColumn("deficit", F.greatest(F.lit(0.0), F.col("pg") - F.coalesce("p", F.lit(0.0))))
    w = Window.partitionBy("cluster_id")
    total = F.sum("deficit").over(w)
    return d.withColumn("target", F.when(total > 0, F.col("deficit") / total).otherwise(F.lit(1.0) / F.count("*").over(w)))


def symmetric(defect: DataFrame, clean: DataFrame, eps: float = 1e-3) -> DataFrame:
    """sqrt((p of the cell within the cluster + eps)(p of the cell on clean patches + eps)), as a share of
    the cluster's largest, over the cells of the cluster."""
    j = defect.join(clean.select("cell_key", F.col("p").alias("pc")), "cell_key", "left")
    j = j.withColumn("raw", F.sqrt((F.col("p") + eps) * (F.coalesce("pc", F.lit(0.0)) + eps)))
    return j.withColumn("sym", F.col("raw") / F.max("raw").over(Window.partitionBy("cluster_id")))


def entropy(df: DataFrame, by: Sequence[str], base: Column | None = None, eps: float = 1e-12) -> DataFrame:
    """One row: minus the sum of p times the logarithm of p + eps over the groups; bits without a base."""
    p = share(df, by)
    log = F.log2(F.col("p") + eps) if base is None else F.ln(F.col("p"))
    return p.agg((-F.sum(F.col("p") * log)).alias("entropy"), F.count("*").alias("k"))
