import numpy as np
from pyspark.sql import functions as F

from sieveloom.operators import profiling as P
from sieveloom.operators import similarity as V


def test_silhouette_counts_every_row(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, (3000, 2)), rng.normal(2, 1, (3000, 2)), [[9.0, 9.0]]]
    y = np.r_[np.zeros(3000, int), np.ones(3000, int), 2]
    df = spark.createDataFrame([(i, *map(float, r), int(y[i])) for i, r in enumerate(x)], "id int, a double, b double, label int")
    d = V.euclid(x, x)
    sums, n = np.stack([d[:, y == k].sum(1) for k in range(3)], 1), np.bincount(y)
    a = sums[np.arange(len(x)), y] / np.maximum(n[y] - 1, 1)
    b = np.where(y[:, None] == np.arange(3), np.inf, sums / n).min(1)
    want = np.where(n[y] > 1, (b - a) / np.maximum(a, b), 0).mean()
    assert abs(P.silhouette(df, ["a", "b"], "label").first()[0] - want) < 1e-7
    assert abs(P.silhouette(df, ["a", "b"], "label", block=1000).first()[0] - want) < 1e-7
    assert P.silhouette(df.where(F.col("id") < 0), ["a", "b"], "label").first()[0] == 0
