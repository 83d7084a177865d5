"""Similarity clusters of numeric records.

A record becomes a set of tokens: per feature the cells of several grids shifted against each other.
Two sets share the more tokens the closer the records are, so their Jaccard similarity falls with the
sum of the scaled differences. Records with one token set form a class; a class is one lattice cell,
so there are no more classes than cells however many records there are. A similarity bounds the steps
between two classes, so all pairs that meet it are looked up in blocks of the lattice. Classes with too
few records around them drop out, connected components form groups, and a loose group is split around
its medoids of highest degree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.llm.graph import components
from sieveloom.runtime import materialize


@dataclass
class Grid:
    #: width of a token's interval for each feature
    width: Sequence[float]
    #: shifted grids a feature; the lattice step is width / shifts
    shifts: int = 5

    def cells(self, features: Sequence[str]) -> Column:
        return F.array(*[F.floor(F.col(f) / F.lit(w / self.shifts)).cast("int") for f, w in zip(features, self.width)])


def tokens(cells: np.ndarray, shifts: int) -> np.ndarray:
    """Token numbers, one row a record: feature, grid and interval in one integer."""
    s = np.arange(shifts)
    interval = (cells[:, :, None] + s[None, None, :]) // shifts
    feature = np.arange(cells.shape[1])[None, :, None]
    return ((interval + (1 << 20)) * 64 + feature * shifts + s[None, None, :]).reshape(len(cells), -1)


def ball(features: int, reach: int) -> np.ndarray:
    """All steps from a cell to others with a sum of up to ``reach``, one row each."""
    out, left = np.zeros((1, 0), dtype=np.int64), np.array([reach])
    step = np.arange(-reach, reach + 1)
    for _ in range(features):
        i, k = np.nonzero(np.abs(step)[None, :] <= left[:, None])
        out, left = np.c_[out[i], step[k]], left[i] - np.abs(step[k])
    return out[out.any(axis=1)]


def links_within(classes: DataFrame, features: int, shifts: int, similarity: float, piece: int = 2_000) -> DataFrame:
    """(a, b, na, nb, j): all pairs a < b of classes (class, cells, n) with a similarity j of at least ``similarity``.

    The lattice is cut into blocks twice as wide as the steps a pair may be apart. A class lives in its block and
    visits the preceding blocks within reach, so each pair meets in one block; there the cells around a class are
    looked up in the sorted cells of the block. piece: classes looked up at once.
    """
    all_ = features * shifts
    reach = max((d for d in range(shifts) if (all_ - d) / (all_ + d) >= similarity), default=0)
    side, around = max(1, 2 * reach), ball(features, reach)
    if (3 * side + 1) ** features >= 2**62:
        raise ValueError("too many features for a cell to be one number")

    def visits(batches):
        for b in batches:
            if not len(b):
                continue
            cells = np.stack(b["cells"].to_numpy()).astype(np.int64)
            home, at = cells // side, cells % side
            row, block, left, own = np.arange(len(b)), np.zeros((len(b), 0), dtype=np.int64), np.full(len(b), reach), np.ones(len(b), dtype=bool)
            for f in range(features):
                cost = np.c_[at[row, f] + 1, np.zeros(len(row), dtype=np.int64), side - at[row, f]]
                cost[own, 2] = reach + 1  # of two blocks the preceding one is visited
                i, k = np.nonzero(cost <= left[:, None])
                block, left, own, row = np.c_[block[i], home[row[i], f] + k - 1], left[i] - cost[i, k], own[i] & (k == 1), row[i]
            out = b.iloc[row].assign(own=own)
            yield out.assign(block=list(block))[["block", "own", "class", "cells", "n"]]

    def look(x: pd.DataFrame) -> pd.DataFrame:
        cells, name, n = np.stack(x["cells"].to_numpy()).astype(np.int64), x["class"].to_numpy(), x["n"].to_numpy()
        own, found = x["own"].to_numpy(), []
        cells = cells - cells.min(axis=0) + reach
        radix = np.r_[1, np.cumprod(cells.max(axis=0) + reach + 1)[:-1]]
        code = cells @ radix
        order = np.argsort(code)
        code, delta, mine = code[order], around @ radix, np.nonzero(own[order])[0]
        for at in range(0, len(mine), piece):
            i = mine[at : at + piece]
            want = code[i][:, None] + delta[None, :]
            j = np.minimum(np.searchsorted(code, want), len(code) - 1)
            r, k = np.nonzero(code[j] == want)
            u, v = order[i[r]], order[j[r, k]]
            once = ~own[v] | (name[u] < name[v])
            found.append(np.c_[u, v, np.abs(around[k]).sum(axis=1)][once])
        u, v, d = np.concatenate(found).T if found else np.zeros((3, 0), dtype=np.int64)
        u, v = np.where(name[u] < name[v], u, v), np.where(name[u] < name[v], v, u)
        return pd.DataFrame({"a": name[u], "b": name[v], "na": n[u], "nb": n[v], "j": (all_ - d) / (all_ + d)})

    near = classes.select("class", "cells", "n").mapInPandas(visits, "block array<int>, own boolean, class long, cells array<int>, n long")
    near = near.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")  # few bytes, much work
    return near.groupBy("block").applyInPandas(look, "a long, b long, na long, nb long, j double")


def cluster(df: DataFrame, record_id: str, features: Sequence[str], grid: Grid, *, similarity: float = 0.65, density: float = 0.0003, min_share: float = 0.006, loose: float = 0.35, tolerated: float = 0.05, piece: int = 2_000) -> DataFrame:
    """(id, cluster, degree): the members of clusters; the higher its degree, the more typical a member.

    density: share of all records that must lie within the similarity of a class, itself included (three
    at least). min_share: smallest cluster as a share of all records of df. loose, tolerated: a
    component is loose when more than ``tolerated`` of its records are less than ``loose`` similar to its
    medoid; it is then split around the medoid, and the rest again, until none is loose. piece: classes whose
    neighbours are looked up at once.

    With F features, records apart in one feature but equal in the others are (F - 1) / (F + 1) similar,
    so ``similarity`` must be above that.

    Records with a null id or a null, NaN or infinite feature belong to no cluster but count for the
    shares; equal records are of one class; an empty table has no clusters; other columns are ignored.
    The degree is the number of records within the similarity of a member's class.
    """
    if similarity <= (len(features) - 1) / (len(features) + 1):
        raise ValueError("similarity must not hold for records apart in one feature")
    total = df.count()
    ok = None
    for f in features:
        c = F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < 1e9)
        ok = c if ok is None else ok & c
    rows = df.select(F.col(record_id).cast("long").alias("id"), *features).where(F.col("id").isNotNull() & ok)
    rows = materialize(rows.select("id", grid.cells(features).alias("cells")))
    least = max(3, int(np.ceil(density * total)))
    floor_ = max(least, int(np.ceil(min_share * total)))
    classes = materialize(rows.groupBy("cells").agg(F.count("*").alias("n"), F.min("id").alias("class")))
    s = grid.shifts
    links = materialize(links_within(classes, len(features), s, similarity, piece))
    degree = links.select(F.col("a").alias("class"), F.col("nb").alias("w")).unionByName(links.select(F.col("b").alias("class"), F.col("na").alias("w"))).groupBy("class").agg(F.sum("w").alias("w"))
    dense = classes.join(degree, "class", "left").withColumn("degree", F.col("n") + F.coalesce("w", F.lit(0))).where(F.col("degree") >= least)
    dense = materialize(dense.select("class", "cells", "n", "degree"))
    core = links.join(dense.select(F.col("class").alias("a")), "a", "left_semi").join(dense.select(F.col("class").alias("b")), "b", "left_semi")
    comp = dense.join(components(core), F.col("class") == F.col("node"), "left").select("class", "cells", "n", "degree", F.coalesce("component", "class").alias("cluster"))
    # border classes go with their most similar dense class
    ends = links.select("a", "b", "j").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "j"))
    border = ends.join(dense.select(F.col("class").alias("b"), F.col("degree").alias("d")), "b").join(dense.select(F.col("class").alias("a")), "a", "left_anti")
    border = border.groupBy("a").agg(F.max(F.struct("j", "d", -F.col("b"))).alias("m")).select(F.col("a").alias("class"), (-F.col("m.col3")).alias("host"))
    border = border.join(comp.select(F.col("class").alias("host"), "cluster"), "host").join(classes.select("class", "cells", "n"), "class")
    border = border.join(degree, "class").select("class", "cells", "n", (F.col("n") + F.col("w")).alias("degree"), "cluster")
    member = split_loose(materialize(comp.unionByName(border)), s, loose, tolerated)
    size = member.groupBy("cluster").agg(F.sum("n").alias("size")).where(F.col("size") >= floor_)
    member = member.join(size.select("cluster"), "cluster", "left_semi").select("cells", "cluster", "degree")
    return rows.join(member, "cells").select("id", "cluster", "degree")


def _similarity(a: str, b: str, shifts: int) -> Column:
    """Jaccard of two token sets from their cells: each step of difference costs one token, up to shifts a feature."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(F.abs(x - y), F.lit(shifts))), F.lit(0), lambda acc, x: acc + x)
    all_ = F.size(F.col(a)) * shifts
    return (all_ - apart) / (all_ + apart)


def split_loose(member: DataFrame, shifts: int, loose: float, tolerated: float) -> DataFrame:
    """Take from each loose component the classes similar to its medoid, the class of highest degree, and
    look at the rest again, until no component is loose. A turn takes the medoid at least, so it ends."""
    done: list[DataFrame] = []
    keep = ["class", "cells", "n", "degree", "cluster"]
    while True:
        top = member.groupBy("cluster").agg(F.max(F.struct("degree", -F.col("class"), "cells")).alias("m")).select("cluster", F.col("m.cells").alias("medoid"))
        marked = member.join(top, "cluster").withColumn("far", _similarity("cells", "medoid", shifts) < loose)
        state = marked.groupBy("cluster").agg((F.sum(F.when(F.col("far"), F.col("n")).otherwise(0)) > tolerated * F.sum("n")).alias("is_loose"))
        marked = materialize(marked.join(state, "cluster"))
        done.append(marked.where("not is_loose or not far").select(*keep))
        rest = marked.where("is_loose and far")
        if not rest.limit(1).count():
            out = done[0]
            for x in done[1:]:
                out = out.unionByName(x)
            return out
        if len(done) == 16:  # a short plan however many turns
            out = done[0]
            for x in done[1:]:
                out = out.unionByName(x)
            done = [materialize(out)]
        first = rest.groupBy("cluster").agg(F.min("class").alias("_new"))
        member = materialize(rest.join(first, "cluster").select("class", "cells", "n", "degree", F.col("_new").alias("cluster")))


def describe(members: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster, size, rank, id): each cluster with its size and most typical members."""
    w = Window.partitionBy("cluster").orderBy(F.col("degree").desc(), F.col("id").asc())
    best = members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    return best.join(size, "cluster").select("cluster", "size", "rank", "id")
