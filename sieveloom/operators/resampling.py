"""Resampling tests: a bootstrap over clusters and a permutation of two pooled sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.operators.ordered import row_numbers
from sieveloom.operators.similarity import nearest
from sieveloom.runtime import materialize

#: Replicates by default, as in the original.
BOOTSTRAP, PERMUTATIONS = 2_000, 1_000


def cluster_bootstrap(df: DataFrame, value: str, cluster: str, reps: int = BOOTSTRAP) -> DataFrame:
    """One row (delta, ci_low, ci_high, p): mean of a column, its 95 % interval and (#(mean <= 0) + 1) / (reps + 1).

    Whole clusters are drawn with replacement, as many as there are, by hashed draws; a replicate is the mean
    over the rows of the clusters drawn. Only sums and counts of clusters take part. No rows give nulls and p 1.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("m"))
    g = materialize(row_numbers(sums, [F.col(cluster)]).select("s", "m", (F.col("rn") - 1).alias("k")))
    n = g.count()
    draws = df.sparkSession.range(reps * n).select(F.floor(F.col("id") / max(n, 1)).alias("r"), (F.col("id") % max(n, 1)).alias("j"))
    k = F.conv(F.substring(F.md5(F.concat_ws(":", "r", "j")), 1, 12), 16, 10).cast("long") % max(n, 1)
    b = draws.select("r", k.alias("k")).join(g, "k").groupBy("r").agg((F.sum("s") / F.sum("m")).alias("b"))
    q = F.percentile("b", F.array(F.lit(0.025), F.lit(0.975)))
    out = b.agg(q.alias("q"), ((F.count_if(F.col("b") <= 0) + 1) / F.lit(reps + 1.0)).alias("p"))
    return g.agg((F.sum("s") / F.sum("m")).alias("delta")).crossJoin(out).select("delta", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "p")


def nearest_permutation(real: DataFrame, pool: DataFrame, reps: int = PERMUTATIONS, seed: int = 42, k: int = 32) -> DataFrame:
    """One row (delta, p): mean distance of the real rows (id, vec) to the nearest row of the second set less that
    to the first, and its one-sided p = (#(delta of a relabelling >= delta) + 1) / (reps + 1).

    Both sets are in ``pool`` (id, vec, second: boolean). Each replicate relabels all of the pool, keeping the sizes
    of the sets. Distances don't change with labels, so a real row's nearest in either set is read off its list of
    pooled neighbours; should k of them all lie in one set in some replicate, lists four times as long are made,
    at last of the whole pool. Fewer than one row in a set or no real row give nulls.
    """
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0)
    pool = materialize(row_numbers(pool.where(ok), [F.col("id")]).select("id", "vec", "second", (F.col("rn") - 1).alias("k")))
    sizes = pool.agg(F.count("*").alias("n"), F.count_if("second").alias("n2")).first()
    n, n2 = sizes["n"], sizes["n2"]
    if not 0 < n2 < n:
        return real.sparkSession.range(1).select(F.lit(None).cast("double").alias("delta"), F.lit(None).cast("double").alias("p"))
    one = lambda second: nearest(real, pool.where("second" if second else "not second")).agg(F.avg(F.round("distance", 9)).alias(f"d{int(second)}"))
    observed = one(True).crossJoin(one(False)).select((F.col("d1") - F.col("d0")).alias("delta"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            at, d = np.stack(b["at"].to_numpy()), np.stack(b["d"].to_numpy())
            row, out = np.arange(len(at)), []
            for r in range(reps):
                label = np.zeros(n, bool)
                label[np.random.default_rng([seed, r]).permutation(n)[:n2]] = True
                second = label[at]
                i, j = second.argmax(1), (~second).argmax(1)
                whole = second[row, i] & ~second[row, j]
                out.append((r, float((d[row, i] - d[row, j]).sum()), len(at), int((~whole).sum())))
            yield pd.DataFrame(out, columns=["r", "s", "m", "short"])

    while True:
        near = nearest(real, pool, k=k).join(pool.select(F.col("id").alias("neighbour"), "k"), "neighbour")
        lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "k", F.round("distance", 9).alias("d")))).alias("l"))
        lists = lists.select(F.col("l.k").alias("at"), F.col("l.d").alias("d"))
        t = materialize(lists.mapInPandas(run, "r int, s double, m long, short long").groupBy("r").agg((F.sum("s") / F.sum("m")).alias("t"), F.sum("short").alias("short")))
        if k >= n or not t.agg(F.sum("short")).first()[0]:
            break
        k *= 4
    hits = t.crossJoin(F.broadcast(observed)).agg(F.count_if(F.round("t", 9) >= F.round("delta", 9)).alias("hits"))
    return observed.crossJoin(hits).select("delta", ((F.col("hits") + 1) / F.lit(reps + 1.0)).alias("p"))
