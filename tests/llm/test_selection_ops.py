"""Problems 1 to 4: samples, percentiles, caps and top lists."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveloom.llm import capping, quantiles, topn
from sieveloom.llm import records as R
from sieveloom.llm import sampling as S

NAN = float("nan")


# ---- 1: the cube method -------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.floats(0, 1)), max_size=60), st.integers(0, 99))
def test_flight_keeps_every_category_total(units, seed):
    cat = np.array([c for c, _ in units], dtype=int)
    p = np.array([x for _, x in units], dtype=float)
    q = S.pair_flight(cat, p, np.random.default_rng(seed))
    for c in set(cat.tolist()):
        assert abs(q[cat == c].sum() - S.snap(p)[cat == c].sum()) < 1e-6
        assert ((q[cat == c] > 0) & (q[cat == c] < 1)).sum() <= 1


def test_flight_keeps_inclusion_probabilities():
    p = np.array([0.2, 0.7, 0.5, 0.6, 0.9, 0.1])
    hits = sum(S.pair_flight(np.zeros(6, int), p, np.random.default_rng(i)) for i in range(4000)) / 4000
    assert np.abs(hits - p).max() < 0.04


def test_landing_decides_all_and_balances_the_total():
    rng = np.random.default_rng(1)
    p = rng.random(30) * 0.98 + 0.01
    m = [rng.integers(0, 4, 30), rng.integers(0, 3, 30)]
    q = S.landing(p.copy(), m, rng)
    assert set(q) <= {0.0, 1.0} and abs(q.sum() - p.sum()) < 1
    for x in m:
        for v in set(x.tolist()):
            assert abs(q[x == v].sum() - p[x == v].sum()) < 4


def sample_case(spark, rows, targets, **kw):
    df = spark.createDataFrame(rows, "row_id long, class_key string, cluster_id int, selected string")
    t = spark.createDataFrame(targets, "class_key string, cluster_id int, target_share double, min_rows int")
    return S.balanced_sample(df, t, ["class_key", "cluster_id"], "row_id", canonical={"class_key": R.canonical_class}, **kw)


def test_sample_follows_targets_and_reports_shortfalls(spark):
    rows = [(i, [" A", "a", "b", "B ", "c", None, "_"][i % 7], i % 2, "clash") for i in range(7000)] + [(None, "a", 0, "x"), (9001, "rare", 1, "x"), (9002, "rare", None, "x")]
    targets = [("a", 0, 0.5, 3), ("a", 1, 0.2, 3), ("b", 0, 0.1, 3), ("b", 1, 0.15, 3), ("c", 0, 0.9, 3), ("rare", 1, None, 5), ("rare", None, None, 1), ("gone", 0, 0.01, 0)]
    s = sample_case(spark, rows, targets, fan_in=2)
    rep = {(r["class_key"], r["cluster_id"]): r for r in s.report.collect()}
    total = sum(r["available"] for r in rep.values())
    assert rep[("rare", 1)]["selected"] == 1 and rep[("rare", 1)]["unmet_min"]
    assert not rep[("rare", None)]["unmet_min"] and rep[("rare", None)]["selected"] == 1
    assert rep[("gone", 0)]["unmet_share"] and not rep[("gone", 0)]["unmet_min"]
    assert rep[("c", 0)]["unmet_share"] == (rep[("c", 0)]["available"] < 0.9 * 0.2 * total)
    for r in rep.values():
        assert abs(r["residual"]) < 1
    assert max(abs(r["residual"]) for r in s.margins.collect()) < 2
    chosen = s.decided.where("selected")
    assert chosen.count() == sum(r["selected"] for r in rep.values()) == chosen.select("id").distinct().count()


def test_what_small_categories_leave_goes_to_the_others(spark):
    rows = [(i, "abc"[min(i % 10, 2)], 0, "") for i in range(5000)]
    s = sample_case(spark, rows, [("a", 0, 0.7, 0), ("b", 0, 0.1, 0), ("c", 0, 0.2, 0)])
    rep = {r["class_key"]: r for r in s.report.collect()}
    assert rep["a"]["selected"] == 500 == rep["a"]["available"] and rep["a"]["unmet_share"]
    assert sum(r["selected"] for r in rep.values()) == 1000
    assert abs(rep["c"]["selected"] / rep["b"]["selected"] - 2) < 0.02
    assert rep["c"]["sample_share"] == rep["c"]["selected"] / 1000 and abs(rep["c"]["share_gap"] - (rep["c"]["sample_share"] - 0.2)) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9), st.sampled_from([0.0, 0.1, 0.3, 0.7])), min_size=1, max_size=8), st.floats(0, 120))
def test_water_level(rows, size):
    n, least, share = (np.array(x, dtype=float) for x in zip(*rows))
    filled = lambda x: np.minimum(n, np.maximum(least, x * share)).sum()
    level = S.water_level(n, least, share, size)
    assert level >= 0 and (abs(filled(level) - size) < 1e-6 or filled(level) <= size and filled(1e12) <= size + 1e-6 or level == 0 and filled(0) > size)


def test_one_table_gives_one_sample_however_laid_out(spark):
    rows = [(i * 7919 % 100_003, "ab"[i % 2], i % 3, "") for i in range(6000)]
    targets = [(k, c, 0.16, 1) for k in "ab" for c in range(3)]
    s = "row_id long, class_key string, cluster_id int, x string"
    t = spark.createDataFrame(targets, "class_key string, cluster_id int, target_share double, min_rows int")
    got = []
    for df in (spark.createDataFrame(rows, s).repartition(7), spark.createDataFrame(rows[::-1], s).coalesce(1)):
        x = S.balanced_sample(df, t, ["class_key", "cluster_id"], "row_id", piece_rows=500, fan_in=3)
        got.append(sorted(r["id"] for r in x.decided.where("selected").collect()))
    assert got[0] == got[1] and abs(len(got[0]) - 0.96 * 1200) <= 240


def test_sample_of_nothing(spark):
    s = sample_case(spark, [], [("a", 0, 0.5, 0), ("b", 0, None, 2)])
    assert s.decided.count() == 0
    assert {r["class_key"]: (r["unmet_share"], r["unmet_min"]) for r in s.report.collect()} == {"a": (False, False), "b": (False, True)}
    with pytest.raises(ValueError):
        sample_case(spark, [], [("a", i, 0.5, 0) for i in range(5)], max_categories=4)


# ---- 2: percentiles -----------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["sorted", "random", "ties"])
def test_sketch_keeps_its_bound(kind):
    rng = np.random.default_rng(5)
    x = rng.lognormal(size=60_000)
    x = np.sort(x) if kind == "sorted" else np.round(x) if kind == "ties" else x
    whole, parts = quantiles.Sketch(256), []
    whole.update(x)
    for piece in np.array_split(x, 23):
        s = quantiles.Sketch(256, np.random.default_rng(len(parts)))
        s.update(piece)
        parts.append(s)
    merged = quantiles.Sketch(256)
    for s in parts:
        merged.merge(*s.row())
    ps = [0.001, 0.05, 0.25, 0.5, 0.9, 0.999]
    xs = np.sort(x)
    for s in (whole, merged):
        assert s.n == len(x) and 0 < s.error(1e-3) < 0.03 and sum(map(len, s.levels)) < 2000
        for p, v in zip(ps, s.quantiles(ps)):
            lo, hi = np.searchsorted(xs, v, "left") / len(xs), np.searchsorted(xs, v, "right") / len(xs)
            assert lo - s.error(1e-3) - 1e-4 <= p <= hi + s.error(1e-3) + 1e-4
        assert s.quantiles([0, 1]) == [xs[0], xs[-1]]


def test_percentiles_of_groups_days_and_nothing(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["g", None]), rng.randint(0, 3), rng.random(), "x") for _ in range(5000)] + [("g", 0, NAN, "x"), ("g", 0, None, "x"), ("only", 1, None, "x")]
    df = spark.createDataFrame(rows, "k string, day int, v double, n string")
    sk = quantiles.sketch(df, ["k", "day"], ["v"], k=128, max_items=1)
    days = quantiles.merge_tree(sk, ["k", "day", "metric"], k=128)
    got = {(r["k"], r["p"]): r for r in quantiles.percentiles(quantiles.merge(days, ["k", "metric"], k=128), ["k", "metric"], [0.0, 0.5, 1.0]).collect()}
    assert {k for k, _ in got} == {"g", None}
    for key in ("g", None):
        xs = np.sort([r[2] for r in rows if r[0] == key and r[2] is not None and r[2] == r[2]])
        assert got[(key, 0.5)]["n"] == len(xs)
        rank = np.searchsorted(xs, got[(key, 0.5)]["value"]) / len(xs)
        assert abs(rank - 0.5) <= got[(key, 0.5)]["rank_error"] + 1e-3
    assert quantiles.percentiles(quantiles.merge(quantiles.sketch(df.limit(0), ["k"], ["v"]), ["k", "metric"]), ["k", "metric"], [0.5]).count() == 0


def test_grouping_sets_and_a_tree_of_many_levels(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"i{i % 60}", i % 4, float(x)) for i, x in enumerate(rng.lognormal(size=9000))]
    df = spark.createDataFrame(rows, "image string, day int, v double").repartition(13)
    by = ["level", "day", "image", "metric"]
    sk = quantiles.sketch(df, ["day", "image"], ["v"], sets={"day": ["day"], "image": ["image"]}, k=64)
    got = quantiles.percentiles(quantiles.merge_tree(sk, by, fan_in=3, k=64), by, [0.0, 0.25, 0.5, 0.99, 1.0], k=64).collect()
    want = {("day", d, None): np.sort([x for _, e, x in rows if e == d]) for d in range(4)} | {("image", None, i): np.sort([x for j, _, x in rows if j == i]) for i in {r[0] for r in rows}}
    assert len(got) == 5 * len(want)
    for r in got:
        xs = want[(r["level"], r["day"], r["image"])]
        lo, hi = np.searchsorted(xs, r["value"], "left") / len(xs), np.searchsorted(xs, r["value"], "right") / len(xs)
        assert r["n"] == len(xs) and lo - r["rank_error"] - 1 / len(xs) <= r["p"] <= hi + r["rank_error"] + 1 / len(xs)
        assert (r["rank_error"] == 0) == (len(xs) <= 64)


def test_a_larger_k_compacts_nothing_when_read(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1500)], "v double").coalesce(1).selectExpr("'g' as g", "v")
    sk = quantiles.merge_tree(quantiles.sketch(df, ["g"], ["v"], k=2000), ["g", "metric"], k=2000)
    assert [r["value"] for r in quantiles.percentiles(sk, ["g"], [0.1, 0.5], k=2000).collect()] == [149.0, 749.0]


# ---- 3: caps ------------------------------------------------------------------------------------

CAPS = capping.Caps("image", ["c", "cell"], "row_id", "q", inner=2, outer=3)
SCHEMA = "row_id long, image string, c int, cell string, q double, batch int, _r string"


def cut_off(rows, inner, outer):
    groups, images = defaultdict(list), defaultdict(list)
    for r in rows:
        groups[r[1:4]].append(r)
    for g in groups.values():
        for r in sorted(g, key=lambda r: (-r[4], r[0]))[:inner]:
            images[r[1]].append(r)
    kept = {r[0] for g in images.values() for r in sorted(g, key=lambda r: (-r[4], r[0]))[:outer]}
    return kept, {r[0] for r in rows} - kept


@pytest.mark.parametrize("batches", [1, 4])
def test_caps_in_batches_equal_the_whole(spark, batches):
    rng = random.Random(batches)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([0, 1, None]), rng.choice(["x", "none", None]), rng.choice([0.1, 0.5, 0.5, 0.9, float("inf")]), rng.randrange(batches), "clash") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    state = capping.cap_in_batches(CAPS, [df.where(F.col("batch") == i) for i in range(batches)])
    kept, gone = cut_off([r[:5] for r in rows], 2, 3)
    assert {r["row_id"] for r in state.kept.collect()} == kept
    out = [r["row_id"] for r in state.log.collect()]
    assert len(out) == len(set(out)) and set(out) == gone


def test_redelivered_records_bring_displaced_ones_back(spark):
    rows = [(1, "a", 0, "x", 0.9), (2, "a", 0, "x", 0.8), (3, "a", 0, "x", 0.7), (4, "b", 0, "x", 0.5)]
    s = "row_id long, image string, c int, cell string, q double"
    first = capping.apply_batch(CAPS, None, spark.createDataFrame(rows, s))
    assert {r["row_id"] for r in first.log.collect()} == {3}
    state = capping.revise(CAPS, first, spark.createDataFrame([(1, "a", 0, "x", 0.1)], s))
    assert {r["row_id"] for r in state.kept.collect()} == {2, 3, 4}
    assert {(r["row_id"], r["q"]) for r in state.log.collect()} == {(1, 0.1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_redeliveries_in_any_batch_equal_the_whole(spark, seed):
    """Records come again better, worse, in another group or for another contributor."""
    rng = random.Random(seed)
    make = lambda i, b: (i, rng.choice(["hot"] * 4 + ["a", "b", None]), rng.choice([0, 1, None]), rng.choice(["x", None]), rng.choice([0.1, 0.3, 0.5, 0.5, 0.9]), b, "clash")
    batches = [[make(i, 0) for i in range(120)]]
    for b in (1, 2, 3):
        again = rng.sample(range(120 + 30 * (b - 1)), 25)
        batches.append([make(i, b) for i in again] + [make(i, b) for i in range(120 + 30 * (b - 1), 120 + 30 * b)])
    valid = {r[0]: r for rows in batches for r in rows}
    state = capping.cap_in_batches(CAPS, [spark.createDataFrame(rows, SCHEMA) for rows in batches])
    kept, gone = cut_off([r[:5] for r in valid.values()], 2, 3)
    assert {r["row_id"] for r in state.kept.collect()} == kept
    log = [tuple(r)[:5] for r in state.log.select(*CAPS.columns).collect()]
    assert len(log) == len(gone) and {r[0] for r in log} == gone and all(valid[r[0]][:5] == r for r in log)


def test_a_task_alone_displaces_only_what_the_whole_does(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.choice([0, 1, None]), rng.choice(["x", None]), rng.choice([0.1, 0.5, 0.5, 0.9]), 0, "") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept, gone = cut_off([r[:5] for r in rows], 2, 3)
    for max_rows in (1, 10_000):
        got = {r["row_id"]: r["_out"] for r in capping.outlasting(CAPS, df, max_rows).collect()}
        assert len(got) == 400 and not {i for i, out in got.items() if out} & kept
    assert sum(got.values()) > 300


def test_caps_of_nothing_and_empty_batches(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, None, None, None, 1.0, 0, "")], SCHEMA)
    state = capping.apply_batch(CAPS, capping.apply_batch(CAPS, None, none), one)
    assert state.kept.count() == 1 and state.log.count() == 0
    assert capping.revise(CAPS, state, none).kept.count() == 1


def test_quality_rule(spark):
    df = spark.createDataFrame([(None,), (NAN,), (0.3,)], "quality_score double")
    assert [r[0] for r in df.select(R.quality()).collect()] == [1.0, 0.0, 0.3]


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, None, "c"), (None, 9, "d"), (2, None, "e")], "k int, loaded_at int, v string")
    assert {tuple(r) for r in R.latest(df, "k", ["v"]).collect()} == {(1, "b"), (2, "e")}


# ---- 4: top lists -------------------------------------------------------------------------------


def best(rows, n):
    groups = defaultdict(dict)
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            groups[g][i] = max(s, groups[g].get(i, -float("inf")))
    return {(g, i, k + 1) for g, items in groups.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:n])}


@pytest.mark.parametrize("max_rows", [1, 10_000])
def test_top_n_matches_brute_force(spark, max_rows):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "B", "é", "z", "好", "😀", "a1", None, ""]), rng.choice([0.5, 0.5, 0.7, NAN, None, float("inf"), -1.0])) for _ in range(600)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "roi long, item string, score double, rank string").repartition(5)
    got = {(r["roi"], r["item"], r["rank"]) for r in topn.top_n(df, "roi", "item", "score", 3, max_rows=max_rows).collect()}
    assert got == best(rows, 3)
    assert topn.top_n(df.limit(0), "roi", "item", "score", 3).count() == 0


def test_best_of_array_keeps_repeated_items_apart(spark):
    cand = [("a", 0.9), ("a", 0.8), ("a", 0.7), ("b", 0.6), ("c", None), (None, 1.0), ("d", NAN), ("e", 0.6)]
    df = spark.createDataFrame([(1, cand), (2, []), (3, None)], "roi int, cand array<struct<i: string, s: double>>")
    x = df.select("roi", F.explode(topn.best_of_array("cand", "i", "s", 2)).alias("x")).select("roi", F.col("x.item").alias("i"), (-F.col("x.neg")).alias("s"))
    assert [(r["roi"], r["i"]) for r in topn.top_n(x, "roi", "i", "s", 2).orderBy("rank").collect()] == [(1, "a"), (1, "b")]
