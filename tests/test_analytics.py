import pytest

from sieveloom import plans


def context(spark, folder, rows):
    """rows: (image_id, patch_xy, local_variance, edge_density, texture_entropy)."""
    rows = [(i, xy, "good", str(v), str(e), str(t), "0.5", "0.5", 4096, 4096) for i, xy, v, e, t in rows]
    schema = "image_id string, patch_xy string, image_type string, local_variance string, edge_density string, texture_entropy string, frequency_energy string, orientation_consistency string, image_w int, image_h int"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/context_features.parquet")
    return str(folder)


def test_continuity_covers_the_whole_image(spark, tmp_path):
    d = context(spark, tmp_path, [("scan", f"{64 * x}_{64 * y}", 5, 100 if x >= 8 else 0, 1) for x in range(12) for y in range(2)])
    got = plans.QUERIES["img_continuity"](spark, d).collect()
    assert [tuple(r) for r in got] == [("scan", pytest.approx(0.6 + 0.4 * 4 / 12, abs=1e-6))]


def test_context_clusters_keep_the_tail(spark, tmp_path):
    rows = [("a", f"{64 * i}_0", 50 + i, 1, 1 + i % 7 / 10) for i in range(40)] + [("b", f"{64 * i}_0", 2e5 + 1e4 * i, 1, 2 + i % 3 / 10) for i in range(6)]
    d = context(spark, tmp_path, rows + [("c", "0_0", -1, 1, 1), ("c", "64_0", 9, 1, 3000)])
    assert sum(r["n"] for r in plans.QUERIES["ml_context_cluster"](spark, d).collect()) == 46
