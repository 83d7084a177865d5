import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveloom.operators import resampling as R
from sieveloom.operators import similarity as V


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")


def test_permutation_relabels_the_pool(spark):
    rng = np.random.default_rng(1)
    real, near, far = rng.normal(3, 1, (25, 4)), rng.normal(3, 1, (30, 4)), rng.normal(-3, 1, (30, 4))
    p = {}
    for name, a, b in (("apart", near, far), ("reversed", far, near)):
        pool = table(spark, a, 100).withColumn("second", F.lit(False)).unionByName(table(spark, b, 200).withColumn("second", F.lit(True)))
        got = R.nearest_permutation(table(spark, real), pool, reps=200, k=2).first()
        both = np.r_[a, b]
        d = np.round(V.cosine(real, both), 9)
        assert got["delta"] == pytest.approx((d[:, 30:].min(1) - d[:, :30].min(1)).mean(), abs=1e-9)
        hits = 0
        for r in range(200):
            second = np.zeros(60, bool)
            second[np.random.default_rng([42, r]).permutation(60)[:30]] = True
            hits += round((d[:, second].min(1) - d[:, ~second].min(1)).mean(), 9) >= round(got["delta"], 9)
        assert got["p"] == pytest.approx((hits + 1) / 201)
        p[name] = got["p"]
    assert p["apart"] == pytest.approx(1 / 201) and p["reversed"] > 0.9
    assert R.nearest_permutation(table(spark, real), pool.where("second"), reps=5).first()["p"] is None


def test_bootstrap_draws_clusters(spark):
    """Two clusters of opposite values: one draw in four has only the lower, whatever the number of rows."""
    df = spark.createDataFrame([(1.0 if i % 2 else -0.5, i % 2) for i in range(400)], "x double, label int")
    got = R.cluster_bootstrap(df, "x", "label").first()
    assert got["delta"] == pytest.approx(0.25) and (got["ci_low"], got["ci_high"]) == (-0.5, 1.0)
    assert got["p"] == pytest.approx(0.25, abs=0.04)
    same = R.cluster_bootstrap(df.where("label = 1"), "x", "label").first()
    assert same["p"] == pytest.approx(1 / 2001) and same["ci_low"] == same["ci_high"] == 1.0
