import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveloom.operators import similarity as V
from sieveloom.operators import tiles as G


def sites(rows):
    tiles, best = {r[:3]: r[3:] for r in rows}, {}
    for image, x, y in tiles:
        foot = [tiles.get((image, x + a, y + b)) for a, b in G.FOOT]
        if any(t is None or t[1] for t in foot):
            continue
        ring = [t for a, b in G.RING if (t := tiles.get((image, x + a, y + b)))]
        if ring:
            score = sum(min(sum(t[0] == c for t in ring) / len(ring), p) for c, p in {t[0]: t[2] for t in ring}.items())
            best[image] = min(best.get(image, (9,)), (-round(score, 9), y, x))
    return best


def test_ring_sites_match_brute_force_across_blocks(spark):
    rng, p = random.Random(3), {"a": 0.5, "b": 0.3, "c": 0.0}
    rows = [("long", x, y, c, rng.random() < 0.15, p[c]) for x in range(70) for y in range(60, 70) if rng.random() < 0.9 for c in rng.choice("abc")]
    rows += [(f"i{k}", x, y, c, rng.random() < 0.2, p[c]) for k in range(20) for x in range(5) for y in range(4) for c in rng.choice("abc")] + [("alone", 3, 3, "a", False, 0.5)]
    df = spark.createDataFrame([*rows, ("i1", None, 2, "a", False, 0.1), (None, 1, 1, "a", False, 0.1)], "image_id string, gx int, gy int, cell_key string, void boolean, p double")
    got = {r["image_id"]: (-round(r["score"], 9), r["gy"], r["gx"]) for r in G.ring_sites(df).collect()}
    assert got == sites(rows) and "long" in got
    assert G.ring_sites(df.limit(0)).count() == 0


def test_histogram_fits_match_brute_force(spark):
    rng = random.Random(4)
    a, b = ({f"{n}{i}": {c: rng.random() for c in rng.sample("uvwxyz", 3)} for i in range(40)} for n in "lr")
    table = lambda h: spark.createDataFrame([(i, c, p) for i, x in h.items() for c, p in x.items()] + [(None, "u", 0.1), ("n", None, 0.1), ("n", "u", None)], "id string, cell_key string, p double")
    want = {(i, j): sum(min(x[c], y[c]) for c in set(x) & set(y)) for i, x in a.items() for j, y in b.items()}
    for block in (7, 1024):
        got = {(r["id"], r["rid"]): r["fit"] for r in V.histogram_fits(table(a), table(b), zeros=True, block=block).collect()}
        assert got == pytest.approx(want)
        some = {(r["id"], r["rid"]) for r in V.histogram_fits(table(a), table(b), block=block).collect()}
        assert some == {k for k, v in want.items() if v > 0}
        top = {(r["id"], r["rid"]) for r in V.histogram_fits(table(a), table(b), k=3, block=block).collect()}
        assert top == {(i, j) for i in a for j in sorted((j for j in b if want[i, j] > 0), key=lambda j: (-round(want[i, j], 9), j))[:3]}
    assert V.histogram_fits(table(a).limit(0), table(b)).count() == 0


def test_fits_are_rounded_as_in_sql():
    import duckdb

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.random(5000), np.arange(200) / 128, np.arange(2000) / 640, np.arange(1001) / 1000, [0.49999949999999996, 0.4999995, 4.9e-7, 5e-7]])
    want = [r[0] for r in duckdb.execute("SELECT round(v, 6) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [x.tolist()]).fetchall()]
    assert V.half_up(x, 6).tolist() == want and V.half_up(np.array([0.0078125, 0.49999999999999994]), 6)[0] == 0.007813 and V.half_up(np.array([0.49999999999999994]), 0)[0] == 0


def test_fits_that_round_to_nothing_are_still_fits(spark):
    table = lambda *rows: spark.createDataFrame(rows, "id string, cell_key string, p double")
    got = V.histogram_fits(table(("a", "u", 1e-9), ("a", "v", 0.0078125)), table(("x", "u", 0.5), ("y", "v", 0.5), ("z", "w", 1.0)), digits=6).collect()
    assert sorted(map(tuple, got)) == [("a", "x", 0.0), ("a", "y", 0.007813)]


@pytest.mark.parametrize("query", ["agg_hist_intersect", "jn_roi_x_background"])
def test_rows_of_all_fits_cost_no_round_and_one_exchange(spark, query):
    from sieveloom.plans import QUERIES

    df = QUERIES[query](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan and plan.count("Exchange ") == 1 and "FlatMapGroupsInArrow" in plan  # by batches, so no table of a block's rows
    assert all(r["fit"] == round(r["fit"], 6) for r in df.select("fit").distinct().collect())


def test_pairs_of_pieces_repeat_few_rows(spark, monkeypatch):
    made = []
    monkeypatch.setattr(V, "grid", lambda *a, f=V.grid: made.append(f(*a)) or made[-1])
    table = lambda n: spark.range(n).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("u").alias("cell_key"), F.lit(1.0).alias("p"))
    df = V.histogram_fits(table(3000), table(2000))
    (a, b), cores = made[0], spark.sparkContext.defaultParallelism
    assert a.count() + b.count() < 5 * 5000 and a.select("part", "block").distinct().count() >= 4 * cores  # all cores have tasks
    assert df.groupBy("fit").count().collect() == [(1.0, 6_000_000)]


def test_histograms_move_as_numbers_of_cells(spark, monkeypatch):
    made = []
    monkeypatch.setattr(V, "grid", lambda *a, f=V.grid: made.append(f(*a)) or made[-1])
    table = lambda *rows: spark.createDataFrame(rows, "id string, cell_key string, p double")
    got = V.histogram_fits(table(("a", "2_1", 0.5), ("b", "0_0", 1.0), ("c", "9_9", 1.0)), table(("x", "2_1", 0.25), ("y", "0_0", 1.0), ("z", "1_2", 1.0))).collect()
    a, b = made[0]
    assert a.schema["cells"].dataType.simpleString() == b.schema["rcells"].dataType.simpleString() == "array<int>"
    assert sorted(map(tuple, got)) == [("a", "x", 0.25), ("b", "y", 1.0)]


def test_every_background_comes_out_and_moves_as_numbers(spark, monkeypatch):
    from sieveloom.plans import QUERIES

    made = []
    monkeypatch.setattr(V, "grid", lambda *a, f=V.grid: made.append((a, f(*a))) or made[-1][1])
    got = QUERIES["jn_roi_x_background"](spark, "/root/testdata/sf0.001").count()
    (left, right, *_), (a, b) = made[0]
    assert got == left.count() * right.count() > 0
    assert a.schema["cells"].dataType.simpleString() == b.schema["rcells"].dataType.simpleString() == "array<int>"


def test_fit_percentiles_match_brute_force(spark):
    rng = random.Random(9)
    a, b = ({f"{n}{i}": {c: rng.randint(1, 4) / 8 for c in rng.sample("uvwxyz", 2)} for i in range(30)} for n in "lr")
    a |= {"far": {"q": 1.0}}
    table = lambda h: spark.createDataFrame([(i, c, p) for i, x in h.items() for c, p in x.items()] + [(None, "u", 0.1), ("n", None, 0.1), ("n", "u", None)], "id string, cell_key string, p double")
    fits = {i: {j: f for j, y in b.items() if (f := sum(min(x[c], y[c]) for c in set(x) & set(y))) > 0} for i, x in a.items()}
    for p in (0.5, 0.95, 1.0):
        cut = {i: np.quantile(list(f.values()), p) for i, f in fits.items() if f}
        for block in (4, 8192):
            got = V.fit_percentile(table(a), table(b), p, block=block).collect()
            assert {r["id"]: r["low"] * (1 - r["share"]) + r["high"] * r["share"] for r in got} == pytest.approx(cut) and "far" not in cut
            assert {r["id"]: r["most"] for r in got} == pytest.approx({i: max(f.values()) for i, f in fits.items() if f})
        got = V.fit_percentile(table(a), table(b), p, pairs=True).where("fit >= cut - 1e-9").collect()
        assert sorted((r["id"], r["rid"]) for r in got) == sorted((i, j) for i, f in fits.items() for j, v in f.items() if v >= cut[i] - 1e-9)
    assert V.fit_percentile(table(a).limit(0), table(b), 0.5).count() == V.fit_percentile(table(a), table(b).limit(0), 0.5, pairs=True).count() == 0


@pytest.mark.parametrize("query", ["win_pool_p95", "agg_lift_weights"])
def test_percentiles_of_fits_make_no_rows_of_all_pairs(spark, monkeypatch, query):
    from sieveloom.plans import QUERIES, relational

    made = []
    monkeypatch.setattr(relational.V, "grid", lambda *a, f=relational.V.grid: made.append(a) or f(*a))  # pairs of blocks, whose rows are pairs
    assert QUERIES[query](spark, "/root/testdata/sf0.001").count() and not made


def test_pairs_that_reach_a_percentile_leave_a_task_in_batches(spark):
    from sieveloom.plans import QUERIES

    plan = QUERIES["win_pool_p95"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "CoGroups" not in plan and "round(" not in plan  # a cogroup's rows are one table

    rng = random.Random(11)
    a, b = ({f"{n}{i}": {c: rng.randint(1, 3) / 6 for c in rng.sample("uvwxyz", 2)} for i in range(40)} for n in "lr")
    table = lambda h: spark.createDataFrame([(i, c, p) for i, x in h.items() for c, p in x.items()], "id string, cell_key string, p double")
    want = set()
    for i, x in a.items():
        fits = {j: f for j, y in b.items() if (f := sum(min(x[c], y[c]) for c in sorted(set(x) & set(y)))) > 0}
        want |= {(i, j) for j, f in fits.items() if round(f, 9) >= round(float(np.quantile(list(fits.values()), 0.9)), 9)}
    for block in (7, 65_536):
        assert {tuple(r) for r in V.fit_percentile(table(a), table(b), 0.9, pairs=True, digits=9, block=block).collect()} == want
    assert V.fit_percentile(table(a), table(b).limit(0), 0.9, pairs=True, digits=9).count() == 0


def test_histograms_come_apart_as_they_are_read():
    import pyarrow as pa

    rows = [(f"l{i}", None, [i % 3, 3], [0.5, 0.25]) if i % 4 == 0 else (None, f"r{i}", [3, i % 3, 3], [0.125, 0.5, 0.25]) for i in range(50)]
    batch = lambda some: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64())))], names=["id", "rid", "cells", "ps"])
    x, rid, y = V.blocks_apart(iter([batch(rows[i : i + 7]) for i in range(0, 50, 7)]), 4, chunk=10)
    assert x["id"].to_pylist() == [r[0] for r in rows if r[0]] and rid.to_pylist() == [r[1] for r in rows if r[1]] and len(y) > 2
    got = np.concatenate([f for _, f in V.fit_rows(x, y, held=100)])
    want = [[0.375 + 0.5 * (int(i[1:]) % 3 == int(j[1:]) % 3) for j in rid.to_pylist()] for i in x["id"].to_pylist()]  # a cell that is there twice counts twice
    assert np.array_equal(got, want)


def test_fits_hold_few_rows_at_once():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    side = lambda n: pa.table({"id": list(range(n)), "cells": [[str(c) for c in rng.permutation(6)[:3]] for _ in range(n)], "ps": rng.random((n, 3)).tolist()})
    x, y = side(11), side(29)
    whole = [f for _, f in V.fit_rows(x, y)]
    parts = list(V.fit_rows(x, y, chunk=7, held=60))
    assert len(whole) == 1 and [i for i, _ in parts] == [0, 2, 4, 6, 8, 10] and max(f.size for _, f in parts) <= 60
    assert np.array_equal(whole[0], np.concatenate([f for _, f in parts]))
    h = lambda t, i: dict(zip(t["cells"][i].as_py(), t["ps"][i].as_py()))
    assert whole[0] == pytest.approx(np.array([[sum(min(h(x, i)[c], h(y, j)[c]) for c in set(h(x, i)) & set(h(y, j))) for j in range(29)] for i in range(11)]))


def test_nearest_keeps_ties_by_id(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(i, [rng.choice([0.0, 1.0]), 1.0]) for i in range(9)], "id long, vec array<double>")
    right = spark.createDataFrame([(i, [rng.choice([0.0, 1.0]), 1.0]) for i in range(300)], "id long, vec array<double>")
    got = {}
    for r in V.nearest(left, right, k=4, metric="euclid", block=100).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    rows = right.orderBy("id").collect()
    for r in left.collect():
        assert got[r["id"]] == [x["id"] for x in rows if x["vec"] == r["vec"]][:4]
    assert V.nearest(left, right.where(F.lit(False))).count() == 0


def test_frechet_distance_matches_whole_matrices(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)), rng.normal(1, 2, (50, 5))
    table = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)] + [(-1, None), (-2, [])], "id long, vec array<double>").repartition(6)
    c, e = np.cov(x.T), np.cov(y.T)
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(c + e) - 2 * np.sqrt(np.maximum(np.linalg.eigvals(c @ e).real, 0)).sum()
    assert abs(V.frechet(table(x), table(y)) - want) < 1e-6 and abs(V.frechet(table(x), table(x))) < 1e-6
    assert V.frechet(table(x), table(x).limit(0)) is None


def test_ranks_within_groups_of_any_size(spark):
    from sieveloom.operators.ordered import group_ranks

    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), i, rng.random()) for i in range(300)]
    got = {(r["k"], r["i"]): r["rn"] for r in group_ranks(spark.createDataFrame(rows, "k string, i long, x double"), ["k"], [F.col("x"), F.col("i")]).collect()}
    for k in ("hot", "a", None):
        assert [got[(k, i)] for _, i in sorted((x, i) for g, i, x in rows if g == k)] == list(range(1, 1 + sum(r[0] == k for r in rows)))
