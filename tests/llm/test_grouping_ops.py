"""Problems 5 and 6: clusters and splits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveloom.llm import clusters as C
from sieveloom.llm import splits as P
from sieveloom.llm.graph import components, consecutive

GRID = C.Grid([0.15, 0.15, 0.15, 0.4], shifts=5)
FEATURES = ["a", "b", "c", "d"]


def union(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(600, 640)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), *edges[:5]], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == union([e for e in edges if e[0] != e[1]])
    assert components(df.limit(0)).count() == 0


def test_consecutive_spreads_one_group_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [("hot", i) for i in rng.sample(range(10_000), 700)] + [("b", 5), ("b", 3), ("c", 1), (None, 4), ("b", None), ("b", 3)]
    df = spark.createDataFrame(rows, "g string, i long")
    want = set()
    for g in ("hot", "b", "c"):
        s = sorted({i for k, i in rows if k == g and i is not None})
        want |= set(zip(s, s[1:]))
    got = [tuple(r) for r in consecutive(df, "g", "i", partitions=9).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert consecutive(df.limit(0), "g", "i").count() == 0


def test_tokens_give_the_stated_similarity():
    x = np.array([[0, 0, 0, 0], [1, 0, 2, 0], [9, 0, 0, 0], [-3, 4, 0, 0]])
    t = [set(r) for r in C.tokens(x, 5).tolist()]
    j = lambda a, b: len(a & b) / len(a | b)
    assert j(t[0], t[1]) == pytest.approx((20 - 3) / (20 + 3))
    assert j(t[0], t[2]) == pytest.approx(15 / 25)
    assert j(t[0], t[3]) == pytest.approx((20 - 7) / (20 + 7))


def planted(seed=3):
    rng = np.random.default_rng(seed)
    centers = [[0.2, 0.2, 0.2, 1.0], [0.8, 0.2, 0.2, 1.0], [0.2, 0.8, 0.7, 3.0]]
    rows, truth = [], {}
    for k, c in enumerate(centers):
        for _ in range([400, 150, 40][k]):
            z = np.clip(rng.normal(size=4), -2, 2) * [0.02, 0.02, 0.015, 0.06]
            truth[len(rows)] = k
            rows.append((len(rows), *(np.array(c) + z).tolist()))
    for x in ([0.5, 0.5, 0.5, 2.0], [0.6, 0.9, 0.1, 0.2], [0.9, 0.9, 0.9, 3.5]):
        rows.append((len(rows), *x))
    rows += [(1000, None, 0.2, 0.2, 1.0), (1001, float("nan"), 0.2, 0.2, 1.0), (1002, float("inf"), 0.2, 0.2, 1.0), (None, 0.2, 0.2, 0.2, 1.0)]
    return rows, truth


def test_clusters_are_the_planted_groups(spark):
    rows, truth = planted()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, a double, b double, c double, d double, cluster string")
    m = C.cluster(df, "id", FEATURES, GRID)
    got = {r["id"]: r["cluster"] for r in m.collect()}
    assert set(got) == set(truth)
    assert len({(truth[i], c) for i, c in got.items()}) == 3 == len(set(got.values()))
    d = C.describe(m, 2).collect()
    assert sorted({r["size"] for r in d}) == [40, 150, 400] and len(d) == 6
    assert C.cluster(df.limit(0), "id", FEATURES, GRID).count() == 0
    with pytest.raises(ValueError):
        C.cluster(df, "id", FEATURES, GRID, similarity=0.6)


def test_equal_records_and_ties(spark):
    df = spark.createDataFrame([(i, 0.5, 0.5, 0.5, 1.0) for i in range(50)], "id long, a double, b double, c double, d double")
    m = C.cluster(df, "id", FEATURES, GRID)
    assert m.count() == 50 and [r["id"] for r in C.describe(m, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_loose_components_are_split_around_medoids(spark):
    rows = [(i, [i, 0], 10, 100 - abs(i - 5) if i < 12 else 50 - abs(i - 25), 0) for i in range(30)]
    df = spark.createDataFrame(rows, "class long, cells array<int>, n long, degree long, cluster long")
    out = C.split_loose(df, 5, 0.35, 0.05)
    got = {r["class"]: r["cluster"] for r in out.collect()}
    assert len(got) == 30 and len(set(got.values())) > 1


def test_a_chain_of_many_balls_is_split_to_its_end(spark):
    """More balls than any fixed number of turns: no component is loose afterwards."""
    df = spark.createDataFrame([(i, [4 * i, 0], 1, 1, 0) for i in range(70)], "class long, cells array<int>, n long, degree long, cluster long")
    groups = {}
    for r in C.split_loose(df, 5, 0.35, 0.05).collect():
        groups.setdefault(r["cluster"], []).append(r["cells"][0])
    assert sum(map(len, groups.values())) == 70 and len(groups) > 20
    for xs in groups.values():
        assert max(xs) - min(xs) <= 8


def test_buckets_in_pieces_give_the_same_clusters(spark):
    rows, _ = planted()
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    one, many = (C.cluster(df, "id", FEATURES, GRID, piece=k) for k in (2_000, 3))
    key = lambda x: sorted(tuple(r) for r in x.collect())
    assert key(one) == key(many)


def test_a_pair_without_a_common_minhash_band_is_a_link(spark):
    """Four steps apart are 16 of 24 tokens; MinHash had no band in common for these cells."""
    at = lambda c: [(x + 0.5) * w / 5 for x, w in zip(c, GRID.width)]
    rows = [(0, *at([24, 9, 3, 10])), (1, *at([24, 9, 3, 10])), (2, *at([25, 10, 4, 11])), (3, *at([25, 10, 4, 16]))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    assert {r["id"]: r["degree"] for r in C.cluster(df, "id", FEATURES, GRID).collect()} == {0: 3, 1: 3, 2: 3}


@pytest.mark.parametrize("features, similarity", [(4, 0.65), (4, 0.95), (2, 0.5), (3, 1.0)])
def test_links_match_brute_force_across_blocks(spark, features, similarity):
    rng = np.random.default_rng(6)
    cells = np.unique(rng.integers(-7, 12 if features < 4 else 4, (500, features)), axis=0).tolist()
    df = spark.createDataFrame([(i, c, 1 + i % 3) for i, c in enumerate(cells)], "class long, cells array<int>, n long")
    t, want = C.tokens(np.array(cells), 5), {}
    for i, x in enumerate(t):
        for k, y in enumerate(t[:i]):
            both = len(set(x) & set(y))
            if both / (2 * len(x) - both) >= similarity:
                want[k, i] = (1 + k % 3, 1 + i % 3, both / (2 * len(x) - both))
    for piece in (7, 2_000):
        got = C.links_within(df, features, 5, similarity, piece).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): (r["na"], r["nb"], r["j"]) for r in got} == want
    assert want or similarity > 0.9
    assert C.links_within(df.limit(0), features, 5, similarity).count() == 0


# ---- photographs and splits ---------------------------------------------------------------------

NAMES = {
    "/data/weave/mesh/test/stain/shot_380_flipside_copy.png": "shot_380_flipside",
    "D:\\shots\\weld\\seam\\test\\pore\\cam5_0003y_1024.tif": "cam5_0003y_1024",
    "/mnt/v//cast/tile/test/dent/tile_0003h__tile_2_11_flip.PNG": "tile_0003h",
    "./data/print/foil/test/fray/copy_of_pr0000018x__tile_16_5_flip.png": "pr0000018x",
    "/data/board/flip_side/extra/x/flip_side_0004x_rot270.png": "flip_side_0004x",
    "/data/cast/ring/train/crack/0000001 (1).bmp": "cast/ring/train/crack/0000001",
    "/scratch_disk/data/cast/ring/train/crack/0000001_aug03.png": "cast/ring/train/crack/0000001",
    "/data/cast/ring/test/crack/0000001.png": "cast/ring/test/crack/0000001",
    "shot_5_a_rot180_aug16_blur3.jpeg": "shot_5_a",
    "": None,
}


def test_photo_names(spark):
    df = spark.createDataFrame([(p, None, None) for p in NAMES], "p string, i string, t string")
    path, _ = P.photo_keys("i", "p", "t")
    assert [r[0] for r in df.select(path).collect()] == list(NAMES.values())
    ids = spark.createDataFrame([("edge_chip_gl0000042x_flipud", "edge_chip"), ("dent_0000001", "dent"), (None, "dent"), ("x_y", None)], "i string, t string").withColumn("p", F.lit(None).cast("string"))
    _, by_id = P.photo_keys("i", "p", "t")
    assert [r[0] for r in ids.select(by_id).collect()] == ["gl0000042x", None, None, "x_y"]


def test_related_chains_keys(spark):
    rows = [(1, "a", "b"), (2, "b", None), (3, "c", "c"), (4, None, None), (5, None, None), (None, "a", None), (6, "b", "d"), (7, "d", "d")]
    df = spark.createDataFrame(rows, "id int, k1 string, k2 string")
    got = {r["id"]: r["component"] for r in P.related(df, "id", [F.col("k1"), F.col("k2")]).collect()}
    assert got[1] == got[2] == got[6] == got[7] and len({got[1], got[3], got[4], got[5]}) == 4 and len(got) == 7
    assert P.related(df.limit(0), "id", [F.col("k1"), F.col("k2")]).count() == 0


@pytest.mark.parametrize("shard_rows", [300, 100_000])
def test_splits_keep_groups_and_shares(spark, shard_rows):
    rng = random.Random(4)
    rows = []
    for g in range(1200):
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            rows.append((f"g{g}", rng.choices(["x", "y", "rare", None], [60, 30, 3, 1])[0], "clash"))
    rows += [("giant", rng.choice("xy"), "clash")] * 300 + [(None, "x", "clash")]
    df = spark.createDataFrame(rows, "component string, label string, split string")
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    out = P.grouped_splits(df, "component", "label", shares, shard_rows=shard_rows, large=0.01)
    got = {r["component"]: r["split"] for r in out.collect()}
    assert len(got) == out.count() == 1201
    for label in ("x", "y", "rare"):
        mine = [got[c] for c, v, _ in rows if v == label and c is not None]
        for s, share in shares.items():
            assert abs(mine.count(s) / len(mine) - share) < (0.04 if label != "rare" else 0.06)
    assert P.grouped_splits(df.limit(0), "component", "label", shares).count() == 0


def test_rare_labels_are_shared_out_over_many_shards(spark):
    """A label with one or two records in each of many shards still follows the shares."""
    rows = [(f"g{i}", "rare" if i % 40 == 0 else "x") for i in range(8000)]
    df = spark.createDataFrame(rows, "component string, label string")
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = {r["component"]: r["split"] for r in P.grouped_splits(df, "component", "label", shares, shard_rows=60).collect()}
    assert len(got) == 8000
    for label, slack in (("rare", 2), ("x", 80)):
        mine = [got[c] for c, v in rows if v == label]
        for s, share in shares.items():
            assert abs(mine.count(s) - share * len(mine)) <= slack


def test_what_is_due_sums_to_the_shares():
    rng = np.random.default_rng(0)
    part = np.array([[0.7, 0.5], [0.2, 0.25], [0.1, 0.25]])
    before, given = np.zeros(2), np.zeros((3, 2))
    for _ in range(3000):
        own = rng.integers(0, 4, 2).astype(float)
        now = P.due(before, own, part)
        assert (now >= 0).all() and (now.sum(axis=0) == own).all()
        given, before = given + now, before + own
        assert np.abs(given - part * before).max() <= 3


def test_shares_of_splits(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.0), (None, 0.2)], "split_name string, share double")
    assert P.split_shares(df) == {"a": 0.5}
    with pytest.raises(ValueError):
        P.split_shares(spark.createDataFrame([(str(i), 0.1) for i in range(5)], "split_name string, share double"), most=4)
