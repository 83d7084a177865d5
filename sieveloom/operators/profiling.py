"""Shapes of distributions, cluster policies and complexity indices."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions.scores import clamp01, lit
from sieveloom.operators.similarity import grid
from sieveloom.runtime import materialize

MAX_BINS = 50


def histogram(df: DataFrame, column: str, bins: int) -> list[int]:
    """Counts of equal-width bins between minimum and maximum: one aggregate, at most ``bins`` rows."""
    r = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if r["a"] is None:
        return [0] * bins
    a, b = (r["a"], r["b"]) if r["b"] > r["a"] else (r["a"] - 0.5, r["b"] + 0.5)
    at = F.least(F.floor((F.col(column) - lit(a)) / lit((b - a) / bins)), F.lit(bins - 1))
    got = {x["i"]: x["n"] for x in df.where(F.col(column).isNotNull()).groupBy(at.alias("i")).agg(F.count("*").alias("n")).collect()}
    return [got.get(i, 0) for i in range(bins)]


def peaks(x: Sequence[float], prominence: float) -> list[int]:
    """Local maxima (the middle of flat ones) that stand out by the prominence."""
    x, out, i = list(x), [], 1
    while i < len(x) - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                p = (i + j) // 2
                low = []
                for side in (range(p - 1, -1, -1), range(p + 1, len(x))):
                    m = x[p]
                    for k in side:
                        if x[k] > x[p]:
                            break
                        m = min(m, x[k])
                    low.append(m)
                if x[p] - max(low) >= prominence:
                    out.append(p)
            i = j
        i += 1
    return out


def valleys(df: DataFrame, column: str, bounded: bool) -> tuple[int, list[float]]:
    """Number and places of the valleys of a distribution.

    Right-skewed columns are looked at through log1p; a bounded column gets Sturges bins, others up to
    50; a valley must stand out by twice the counting noise and a tenth of the highest bin, three tenths
    where a bounded column is flat. Fewer than three values have none.
    """
    df = df.select(F.col(column).alias("v")).where("v is not null")
    r = df.agg(F.count("*").alias("n"), F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).first()
    n = r["n"]
    if n < 3:
        return 0, []
    p10, p50, p90 = r["p"]
    skewed = (p90 - p50) / (p50 - p10 + 1e-9) > 2 and p10 > 1e-9
    bins = min(max(math.ceil(math.log2(n)) + 1, 5), min(MAX_BINS, n - 1)) if bounded else min(MAX_BINS, n - 1)
    work = df.select(F.log1p("v").alias("v")) if skewed else df
    counts = np.array(histogram(work, "v", bins), dtype=float)
    raw = np.array(histogram(df, "v", bins), dtype=float)
    flat = bounded and raw.std() / (raw.mean() + 1e-9) < 0.5
    found = peaks(counts.max() - counts, max(2 * math.sqrt(n / bins), counts.max() * (0.3 if flat else 0.1)))
    ends = work.agg(F.min("v"), F.max("v")).first()
    step = (ends[1] - ends[0]) / bins
    places = [ends[0] + (i + 0.5) * step for i in found]
    return len(found), [math.expm1(x) for x in places] if skewed else places


def policy(n_valleys: Column) -> Column:
    return F.when(n_valleys >= 2, "gmm").when(n_valleys == 1, "otsu").otherwise("percentile")


def otsu_threshold(df: DataFrame, column: str) -> DataFrame:
    """One row: the cut of a 256-bin histogram that separates two classes best, by running sums of the bins."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    level = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col(column) - F.col("a")) / (F.col("b") - F.col("a")) * 255), F.lit(255))).otherwise(F.lit(0))
    h = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(level.alias("g"), "a", "b").agg(F.count("*").alias("n"))
    w = Window.orderBy("g")  # at most 256 rows
    h = h.withColumns({"w0": F.sum("n").over(w), "m0": F.sum(F.col("n") * F.col("g")).over(w)}).withColumns({"w": F.sum("n").over(Window.partitionBy()), "m": F.sum(F.col("n") * F.col("g")).over(Window.partitionBy())})
    d = F.col("m0") / F.col("w0") - F.try_divide(F.col("m") - F.col("m0"), F.col("w") - F.col("w0"))
    h = h.withColumn("between", F.coalesce(F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * d * d, F.lit(-1.0)))
    best = h.agg(F.max_by(F.struct("g", "a", "b"), F.struct(F.round("between", 6), -F.col("g"))).alias("m"))
    return best.select((F.col("m.a") + F.col("m.g") / 255 * (F.col("m.b") - F.col("m.a"))).alias("threshold"))


def percentile_cluster(df: DataFrame, column: str, ps: Sequence[float] = (0.3333, 0.6667)) -> DataFrame:
    """df with ``cluster``: its equal-frequency bin; equal edges give one cluster, missing values none."""
    q = df.agg(*[F.round(F.percentile(column, F.lit(p)), 9).alias(f"_q{i}") for i, p in enumerate(ps)])
    n = sum(((F.col(column) >= F.col(f"_q{i}")).cast("int") for i in range(len(ps))), F.lit(0))
    flat = F.col("_q0") >= F.col(f"_q{len(ps) - 1}")
    return df.crossJoin(F.broadcast(q)).withColumn("cluster", F.when(flat & F.col(column).isNotNull(), 0).otherwise(n)).drop(*[f"_q{i}" for i in range(len(ps))])


def median_cluster(df: DataFrame, column: str) -> DataFrame:
    """The two-class policy is in fact a split at the median."""
    q = df.agg(F.round(F.percentile(column, F.lit(0.5)), 9).alias("_q"))
    return df.crossJoin(F.broadcast(q)).withColumn("cluster", (F.col(column) >= F.col("_q")).cast("int")).drop("_q")


def candidates(total_valleys: int, mci: float, valley_threshold: int = 1, high: float = 0.6, low: float = 0.3, most: int = 3) -> list[str]:
    """Cluster policies worth trying."""
    out = ["percentile"] if total_valleys == 0 else ["otsu", "percentile"] if total_valleys <= valley_threshold else ["gmm", "otsu"]
    if mci >= high:
        out.append("hierarchical")
    if mci < low:
        out = [p for p in out if p != "hierarchical"]
    return list(dict.fromkeys(out or ["percentile"]))[:most]


def silhouette(df: DataFrame, features: Sequence[str], label: str, limit: int | None = None, seed: int = 42, block: int = 32_768) -> DataFrame:
    """One row: the mean silhouette by Euclidean distance over all rows. Fewer than two labels give 0, singletons count 0.

    Pieces of about ``block`` rows are paired; each pair gives a row's summed distance to each label, and the
    sums are merged, so no pair of rows is materialised. With ``limit`` only so many rows in hashed order count.
    """
    import pandas as pd

    rows = df.select("id", F.col(label).cast("long").alias("label"), F.array(*[F.col(f).cast("double") for f in features]).alias("vec"), *features).dropna().select("id", "label", "vec")
    if limit is not None:
        rows = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(limit)
    rows = materialize(rows)
    a, b = grid(rows, rows.select("label", "vec", "id"), block)

    def run(_, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        cols = ["id", "own", "label", "s"]
        if x.empty or y.empty:
            return pd.DataFrame([], columns=cols)
        kinds, at = np.unique(y["rlabel"].to_numpy(), return_inverse=True)
        onehot = np.eye(len(kinds))[at]
        left, right = np.stack(x["vec"].to_numpy()), np.stack(y["rvec"].to_numpy())
        left = np.c_[left, (left**2).sum(1), np.ones(len(left))]
        right = np.c_[-2 * right, np.ones(len(right)), (right**2).sum(1)].T.copy()
        s = np.zeros((len(left), len(kinds)))
        for i in range(0, len(left), 256):  # tiles that stay in the cache
            for j in range(0, right.shape[1], 1024):
                d = left[i : i + 256] @ right[:, j : j + 1024]
                s[i : i + 256] += np.sqrt(np.maximum(d, 0, out=d), out=d) @ onehot[j : j + 1024]
        return pd.DataFrame({"id": np.repeat(x["id"].to_numpy(), len(kinds)), "own": np.repeat(x["label"].to_numpy(), len(kinds)), "label": np.tile(kinds, len(x)), "s": s.ravel()})

    got = a.groupBy("part", "block").cogroup(b.groupBy("rpart", "rblock")).applyInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, own long, label long, s double")
    sums = got.groupBy("id", "own", "label").agg(F.sum("s").alias("s"))
    sums = sums.join(rows.groupBy("label").agg(F.count("*").alias("n")), "label")
    mine = F.col("label") == F.col("own")
    one = sums.groupBy("id").agg(
        F.max(F.when(mine, F.col("n"))).alias("n"),
        F.max(F.when(mine, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"),
    )
    value = F.when((F.col("n") > 1) & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12))).otherwise(F.lit(0.0))
    return one.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def gmm_bic(df: DataFrame, features: Sequence[str], max_k: int = 4, seed: int = 42):
    """(model, k, rows): the Gaussian mixture of least BIC, none for a single component, and the rows assembled for it."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=list(features), outputCol="features").transform(df.dropna(subset=list(features)))
    n, d = x.count(), len(features)
    bic = lambda ll, k: -2 * ll + (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(max(n, 2))
    cov = df.dropna(subset=list(features)).agg(*[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features)]).first()
    det = np.linalg.det(np.array(list(cov), dtype=float).reshape(d, d) + 1e-9 * np.eye(d))
    best = bic(-n / 2 * (d * math.log(2 * math.pi) + math.log(max(det, 1e-300)) + d), 1), 1, None  # one component in closed form
    for k in range(2, max_k + 1):
        m = GaussianMixture(k=k, seed=seed, maxIter=30).fit(x)
        score = bic(m.summary.logLikelihood, k)
        if score < best[0]:
            best = score, k, m
    return best[2], best[1], x


def mci(entropy: Column, valley_count: Column, neff: Column, silhouette_: Column, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25), ranges: Sequence[tuple[float, float]] = ((0.0, 3.0), (0.0, 12.0)), n_max: float = 8.0) -> Column:
    """Weighted mean of the normalised entropy, valley count, effective classes and inverse silhouette."""
    parts = [clamp01((entropy - ranges[0][0]) / (ranges[0][1] - ranges[0][0])), clamp01((valley_count - ranges[1][0]) / (ranges[1][1] - ranges[1][0])), clamp01(F.ln(F.greatest(neff, F.lit(1.0))) / math.log(n_max)), clamp01(lit(1) - silhouette_)]
    return sum((lit(w) * p for w, p in zip(weights, parts)), lit(0))
