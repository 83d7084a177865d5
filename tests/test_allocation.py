import random

import pytest

from sieveloom.operators import allocation as L


def test_without_a_cap_a_source_fills_any_number_of_seats(spark):
    rows = [(i, "c", 0, "0", "one" if i < 6 else f"s{i}", 1.0 - i / 100, 0.5) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, class_key string, cluster_id int, cell_key string, source string, score double, deficit double")
    got = L.allocate(df, 6, "stratified_floor", source_cap=None).collect()
    assert sorted(r["row_id"] for r in got) == [0, 1, 2, 3, 4, 5]
    capped = L.allocate(df, 6, "stratified_floor", source_cap=4).collect()
    assert sorted(r["row_id"] for r in capped) == [0, 1, 2, 3, 6, 7]


CASES = [("pair_aware", 2, 1), ("pair_aware", None, 2), ("stratified", 3, 1), ("stratified", None, None), ("stratified_floor", None, None), ("stratified_floor", 4, 1)]


@pytest.mark.parametrize("strategy,pair_cap,source_cap", CASES)
def test_the_extract_gives_the_seats_of_all_candidates(spark, strategy, pair_cap, source_cap):
    rng = random.Random(strategy)
    rows = [(i, rng.choice("aab") if i % 9 else None, rng.choice([0, 0, 0, 1, None]), rng.choice("012"), f"s{rng.randrange(60)}" if i % 3 else "hot", rng.choice([0.1, 0.5, 0.5, 0.9]) + i % 7 / 100, rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, class_key string, cluster_id int, cell_key string, source string, score double, deficit double")
    for top_k in (5, 40, 90):
        some, all_ = (sorted(tuple(r) for r in L.allocate(df, top_k, strategy, pair_cap, source_cap, times=t).collect()) for t in (1, 10**6))
        assert some == all_ and some
    n = {r["source"]: 0 for r in df.select("source").distinct().collect()}
    if source_cap:
        source = {r[0]: r[4] for r in rows}
        for i, _, _, mark in L.allocate(df, 40, strategy, pair_cap, source_cap).collect():
            n[source[i]] += 1
            assert n[source[i]] <= max(source_cap, mark)


def test_no_candidates_no_seats(spark):
    df = spark.createDataFrame([], "row_id long, class_key string, cluster_id int, cell_key string, source string, score double, deficit double")
    assert all(L.allocate(df, 5, k).count() == 0 for k in L.STRATEGIES)
