"""Connected components and ordered neighbours, without collecting a group anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.runtime import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the edges; nodes without an edge don't come out.

    Alternates the two star contractions: first every node hands its larger neighbours to the smallest
    of its neighbourhood, then its smaller ones. Rounds grow with the logarithm of the longest path,
    each is an aggregation and a join, and each is checkpointed. Edges with a null end and loops carry
    nothing; repeated edges count once; an empty table has no components.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: larger neighbours of a go to the smallest of a and its neighbours
        sym = both(now)
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours of a and a itself go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        now = materialize(small.distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def consecutive(df: DataFrame, group: str, item: str, partitions: int | None = None) -> DataFrame:
    """(a, b): each pair of neighbours of one group in the order of ``item``, a long.

    Ranges of (group, item) are sorted by task, so a group of any size is spread over many; the pair
    across two ranges is joined from their ends, one row a range. Null groups and items have no pairs,
    equal items of a group count once.
    """
    df = df.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i")).where("g is not null and i is not null").distinct()
    kind = df.schema["g"].dataType.simpleString()
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialize(df).repartitionByRange(n, "g", "i").sortWithinPartitions("g", "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, last = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not len(b):
                continue
            g, i = b["g"].to_numpy(), b["i"].to_numpy()
            same = g[1:] == g[:-1]
            out = pd.DataFrame({"a": i[:-1][same], "b": i[1:][same]})
            if last is None:
                first = (g[0], i[0])
            elif last[0] == g[0]:
                out.loc[len(out)] = [last[1], i[0]]
            last = (g[-1], i[-1])
            yield out.assign(part=-1, g0=None, g1=None)
        if first is not None:
            yield pd.DataFrame([(first[1], last[1], part, first[0], last[0])], columns=["a", "b", "part", "g0", "g1"])

    cols = ["a", "b", "part", "g0", "g1"]
    runs = materialize(ranges.mapInPandas(lambda it: (x[cols] for x in run(it)), f"a long, b long, part int, g0 {kind}, g1 {kind}"))
    ends = runs.where("part >= 0")
    w = Window.orderBy("part")  # one row a range
    seams = ends.select(F.lag("g1").over(w).alias("gp"), F.lag("b").over(w).alias("p"), "g0", F.col("a").alias("q")).where("gp = g0")
    return runs.where("part < 0").select("a", "b").unionByName(seams.select(F.col("p").alias("a"), F.col("q").alias("b")))
