import pytest
from pyspark.sql import functions as F

from sieveloom.sources import readers as R
from sieveloom.sources import writers as W
from sieveloom.streaming.ingest import ingest, snapshot


def test_missing_csv_is_empty(spark, tmp_path):
    assert R.csv(spark, f"{tmp_path}/none.csv", ["a", "b"]).collect() == []


def test_csv_round_trip_drops_unknown_and_fills(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "x")], "a string, b string, extra string")
    W.csv(df, f"{tmp_path}/o", ["a", "b", "c"])
    assert spark.read.csv(f"{tmp_path}/o", header=True).columns == ["a", "b", "c"]
    assert [tuple(r) for r in R.csv(spark, f"{tmp_path}/o", ["A", "zz"]).collect()] == [("1", None)]


def test_lenient_items(spark):
    texts = ['[{"k": 1}, {"k": 2}]', '{"annotations": [{"k": 3}]}', '{"data": []}', "broken", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r[0] is None else [x["k"] for x in r[0]] for r in df.select(R.lenient_items(F.col("t"), "struct<k: int>")).collect()]
    assert got[:3] == [[1, 2], [3], []] and got[4] is None


def test_upsert_null_keys_and_idempotence(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([(None, 9), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in W.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 3), (None, 9), ("c", 4)}
    assert {tuple(r) for r in W.upsert(W.upsert(old, new, ["k"]), new, ["k"]).collect()} == {("a", 1), ("b", 3), (None, 9), ("c", 4)}
    assert {r["k"] for r in W.without_key(old, "k", "a").collect()} == {None, "b"}


def test_config():
    assert R.with_defaults({"a": {"x": 1}}, {"a": {"x": 0, "y": 2}, "b": 3}) == {"a": {"x": 1, "y": 2}, "b": 3}
    assert R.require({"domain": "d", "seed_dirs": ["s"]}, ["domain", "seed_dir", "image_dir"]) == ["image_dir"]


def test_ingest_twice_changes_nothing(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([(1, "old", 1), (2, "b", 1), (1, "new", 2)], "id int, v string, loaded_at int")
    df.write.parquet(f"{p}/in")
    for _ in range(2):
        ingest(spark, f"{p}/in", df.schema, f"{p}/t", ["id"], f"{p}/c")
    assert {(r["id"], r["v"]) for r in snapshot(spark, f"{p}/t").collect()} == {(1, "new"), (2, "b")}
    spark.createDataFrame([(2, "later", 5)], df.schema).write.mode("append").parquet(f"{p}/in")
    ingest(spark, f"{p}/in", df.schema, f"{p}/t", ["id"], f"{p}/c")
    assert {(r["id"], r["v"]) for r in snapshot(spark, f"{p}/t").collect()} == {(1, "new"), (2, "later")}


def test_yaml_settings():
    text = """
# head
policy:            # comment
  max_k: 8
  rate: 0.5
  name: "a: b # no comment"
  off: null
  flags: [yes_, 'two, three', true]
  deep: {x: 1, y: -2.5}
items:
- id: 1
  tags:
    - a
    - b
- id: 2
-
  id: 3
empty:
"""
    assert R.yaml(text) == {
        "policy": {"max_k": 8, "rate": 0.5, "name": "a: b # no comment", "off": None, "flags": ["yes_", "two, three", True], "deep": {"x": 1, "y": -2.5}},
        "items": [{"id": 1, "tags": ["a", "b"]}, {"id": 2}, {"id": 3}],
        "empty": None,
    }
    assert R.yaml("") == {} and R.yaml("- 1\n- x") == [1, "x"]
    for bad in ("a: &b 1", "just words", "a: 1\n   b: 2"):
        with pytest.raises(ValueError):
            R.yaml(bad)


def test_cache_computes_once(spark, tmp_path):
    one = W.cached(spark.range(3).toDF("x"), str(tmp_path), {"a": 1})
    assert one.count() == 3
    assert W.cached(spark.range(9).toDF("x"), str(tmp_path), {"a": 1}).count() == 3
    assert W.cached(spark.range(9).toDF("x"), str(tmp_path), {"a": 2}).count() == 9
    (unfinished,) = [p for p in tmp_path.iterdir() if spark.read.parquet(str(p)).count() == 9]
    (unfinished / "_SUCCESS").unlink()
    assert W.cached(spark.range(5).toDF("x"), str(tmp_path), {"a": 2}).count() == 5
