"""Caps on dominant contributors, kept incrementally.

The state holds each contributor's kept records with its cutoffs, the worst kept record of every full
list, and the log of displaced records; both are tables in the shared folder. A batch of deliveries is
filtered against the cutoffs, the survivors are merged with the kept records, and whatever leaves the
lists is logged. Lists only get better, so a record once out stays out, unless a kept record is
delivered again and becomes worse: then its contributor's displaced records compete anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.runtime import broadcast_if_small, materialize


@dataclass
class Caps:
    """The best ``inner`` of each (contributor, group) stay, then of these the best ``outer`` of each contributor."""

    contributor: str
    group: list[str]
    record_id: str
    score: str
    inner: int = 3
    outer: int = 25

    @property
    def columns(self) -> list[str]:
        return [self.record_id, self.contributor, *self.group, self.score]

    def order(self) -> list[Column]:
        return [F.col(self.score).desc(), F.col(self.record_id).asc()]

    def beaten(self, cut: str) -> Column:
        """Whether the record is worse than a cutoff, a struct (score, minus id)."""
        return F.col(cut).isNotNull() & (F.struct(F.col(self.score), -F.col(self.record_id)) < F.col(cut))

    def ranked(self, df: DataFrame) -> DataFrame:
        """df with ``_in`` and ``_at``, the ranks within the group and, of those within the inner cap, the contributor.

        One shuffle, by contributor; it gets what ``outlasting`` left, at most ``outer`` records of a
        contributor a task."""
        inner = Window.partitionBy(self.contributor, *self.group).orderBy(*self.order())
        outer = Window.partitionBy(self.contributor).orderBy((F.col("_in") > self.inner).asc(), *self.order())
        df = df.repartition(self.contributor).withColumn("_in", F.row_number().over(inner))
        return df.withColumn("_at", F.when(F.col("_in") <= self.inner, F.row_number().over(outer)))


@dataclass
class State:
    #: kept records; ``_inner`` and ``_outer`` mark the worst of a full group and of a full contributor, the cutoffs
    kept: DataFrame
    #: displaced records
    log: DataFrame

    def cutoffs(self, caps: Caps) -> tuple[DataFrame, DataFrame]:
        cut = F.struct(F.col(caps.score), -F.col(caps.record_id))
        inner = self.kept.where("_inner").select(caps.contributor, *caps.group, cut.alias("_ci"))
        return inner, self.kept.where("_outer").select(caps.contributor, cut.alias("_co"))


def _match(left: DataFrame, right: DataFrame, on: list[str], right_col: str) -> DataFrame:
    """Left join with null keys equal to each other; the right side is broadcast only when checked small."""
    r = right.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(on)], right_col)
    cond = [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate(on)]
    return left.join(broadcast_if_small(r), cond, "left").drop(*[f"_j{i}" for i in range(len(on))])


def outlasting(caps: Caps, df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df with ``_out``: whether records of the same task alone already displace the record.

    That holds in the whole too, for what outranks it within its task outranks it or is displaced by
    better ones there. So a hot contributor sends its caps' worth a task to the merge, and what is left
    out is told without a join. A task holds about max_rows records that are still in.
    """
    cols = caps.columns

    def split(b: pd.DataFrame) -> np.ndarray:
        code = np.zeros(len(b), dtype=np.int64)
        for c in caps.group:
            v, u = pd.factorize(b[c], use_na_sentinel=False)
            code = np.unique(code * (len(u) + 1) + v, return_inverse=True)[1]
        who = pd.factorize(b[caps.contributor], use_na_sentinel=False)[0].astype(np.int64)
        score, key = b[caps.score].to_numpy(dtype=float), b[caps.record_id].to_numpy()
        order = np.lexsort((key, -score, code, who))
        keep = np.zeros(len(b), dtype=bool)
        keep[order] = _rank(who[order], code[order]) < caps.inner
        order = np.lexsort((key, -score, ~keep, who))
        keep[order] &= _rank(who[order]) < caps.outer
        return keep

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, new, waiting = None, [], 0
        for b in batches:
            new.append(b)
            waiting += len(b)
            if waiting < max(50_000, 0 if held is None else len(held)):
                continue
            b = pd.concat(new if held is None else [held, *new], ignore_index=True)
            keep = split(b)
            yield b[~keep].assign(_out=True)
            held, new, waiting = b[keep], [], 0
            if len(held) > max_rows:
                yield held.assign(_out=False)
                held = None
        if new:
            b = pd.concat(new if held is None else [held, *new], ignore_index=True)
            keep = split(b)
            yield b.assign(_out=~keep)
        elif held is not None:
            yield held.assign(_out=False)

    # null integers would arrive as floats: whole numbers that may be null travel as text
    kind = {c: df.schema[c].dataType.simpleString() for c in cols}
    sent = {c: "string" if c != caps.record_id and kind[c] in ("tinyint", "smallint", "int", "bigint") else kind[c] for c in cols}
    back = df.select(*[F.col(c).cast(sent[c]).alias(c) for c in cols]).mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in sent.items()) + ", _out boolean")
    return back.select(*[F.col(c).cast(kind[c]).alias(c) for c in cols], "_out")


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 on within runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=int)
    first = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    return np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))


def _merge(caps: Caps, pool: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Kept records with their marks, and the displaced ones, of a pool of records and those kept so far."""
    marked = materialize(outlasting(caps, pool))
    rivals = marked.where("not _out").drop("_out")
    if kept is not None:
        rivals = rivals.unionByName(kept.select(*caps.columns))
    r = caps.ranked(rivals).withColumn("_kept", F.coalesce(F.col("_at") <= caps.outer, F.lit(False)))
    r = r.select(*caps.columns, "_kept", (F.col("_kept") & (F.col("_in") == caps.inner)).alias("_inner"), (F.col("_kept") & (F.col("_at") == caps.outer)).alias("_outer"))
    r = materialize(r)
    gone = marked.where("_out").drop("_out").unionByName(r.where("not _kept").select(*caps.columns))
    return r.where("_kept").drop("_kept"), gone


def apply_batch(caps: Caps, state: State | None, batch: DataFrame) -> State:
    """Take a batch of new records into the state; the new state's log holds all records displaced so far.

    batch: one row a record with the columns of caps, none of them known to the state (else see
    ``revise``); further columns are ignored. Scores must be neither null nor NaN (map them first), ids
    unique and not null. A null contributor or group value is a value of its own; equal scores go by the
    smaller id. An empty batch changes nothing.
    """
    batch = batch.select(*caps.columns)
    if state is None:
        return State(*_merge(caps, batch, None))
    inner, outer = state.cutoffs(caps)
    marked = _match(_match(batch, inner, [caps.contributor, *caps.group], "_ci"), outer, [caps.contributor], "_co")
    marked = materialize(marked.withColumn("_beaten", caps.beaten("_ci") | caps.beaten("_co")).select(*caps.columns, "_beaten"))
    kept, gone = _merge(caps, marked.where("not _beaten").drop("_beaten"), state.kept)
    return State(kept, state.log.unionByName(marked.where("_beaten").drop("_beaten")).unionByName(gone))


def revise(caps: Caps, state: State | None, batch: DataFrame) -> State:
    """Take a batch that may deliver known records again; the batch's version of a record replaces the old one.

    The old versions leave the state and the log. Where a kept record's new version is worse, or belongs
    elsewhere, the contributor's displaced records leave the log and compete again with the batch. Other
    demands as for ``apply_batch``.
    """
    batch = batch.select(*caps.columns)
    if state is None:
        return apply_batch(caps, None, batch)
    key = caps.record_id
    old = state.kept.select(*caps.columns, F.lit(True).alias("_was")).unionByName(state.log.select(*caps.columns, F.lit(False).alias("_was")))
    new = batch.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_n{i}") for i, c in enumerate(caps.columns[1:])])
    hits = old.select(key).join(new.select("_id"), F.col(key) == F.col("_id")).select(key)  # ids alone are shuffled
    hits = materialize(hits)
    if not hits.limit(1).count():
        return apply_batch(caps, state, batch)
    small = broadcast_if_small(hits, 500_000)
    known = old.join(small, key, "left_semi").where("_was").join(new.join(small.withColumnRenamed(key, "_id"), "_id", "left_semi"), F.col(key) == F.col("_id"))
    same = F.lit(True)
    for i, c in enumerate(caps.columns[1:-1]):
        same = same & F.col(c).eqNullSafe(F.col(f"_n{i}"))
    worse = known.where(~(same & (F.col(f"_n{len(caps.columns) - 2}") >= F.col(caps.score)))).select(F.col(caps.contributor).alias("_c")).distinct()
    worse = broadcast_if_small(materialize(worse))
    open_ = F.col(caps.contributor).eqNullSafe(F.col("_c"))
    kept = state.kept.join(small, key, "left_anti")
    log = state.log.join(small, key, "left_anti")
    again = log.join(worse, open_, "left_semi")
    # a contributor that lost a kept record has no valid cutoffs until its lists are merged again
    calm = kept.join(worse, open_, "left_anti")
    hurt = kept.join(worse, open_, "left_semi").withColumns({"_inner": F.lit(False), "_outer": F.lit(False)})
    rest = State(materialize(calm.unionByName(hurt)), log.join(worse, open_, "left_anti"))
    done = apply_batch(caps, rest, batch.unionByName(again))
    return State(done.kept, materialize(done.log))


def cap_in_batches(caps: Caps, batches: list[DataFrame]) -> State:
    """Fold batches of deliveries, in their order, into an empty state."""
    state = None
    for b in batches:
        state = revise(caps, state, b)
    return state
