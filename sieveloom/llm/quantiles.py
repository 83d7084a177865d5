"""Mergeable percentiles: a hierarchy of randomised compactors.

Level h holds items of weight 2^h. A full level is sorted and every other item, starting at a random
one of the first two, moves up; so a rank changes by at most 2^h, without bias. The sketch adds up
4^h over its compactions, from which Hoeffding's inequality gives the stated bound: with probability
1 - delta a rank is off by no more than sqrt(2 * sum * ln(2 / delta)) / n. Merging joins level by
level and adds the sums, so sketches of partitions, files or days combine in any order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.runtime import materialize

K = 512
#: sizes holds an int32 a level, items the float64 values of all levels, one level after the other.
SKETCH = "n long, lo double, hi double, err2 double, sizes binary, items binary"
FIELDS = ["n", "lo", "hi", "err2", "sizes", "items"]


class Sketch:
    __slots__ = ("k", "rng", "n", "lo", "hi", "err2", "levels", "buffer", "waiting")

    def __init__(self, k: int = K, rng: np.random.Generator | None = None) -> None:
        self.k, self.rng = k, rng or np.random.default_rng(0)
        self.n, self.lo, self.hi, self.err2 = 0, math.inf, -math.inf, 0.0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.buffer: list[np.ndarray] = []
        self.waiting = 0

    def update(self, values: np.ndarray) -> None:
        """Add finite values; null and NaN are not values and are left out by the caller."""
        if not len(values):
            return
        self.n += len(values)
        self.lo, self.hi = min(self.lo, float(values.min())), max(self.hi, float(values.max()))
        self.buffer.append(values)
        self.waiting += len(values)
        if self.waiting >= 4 * self.k:
            self.settle()

    def capacity(self, level: int) -> int:
        return max(8, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - level)))

    def settle(self) -> None:
        if self.buffer:
            self.levels[0] = np.concatenate([self.levels[0], *self.buffer])
            self.buffer, self.waiting = [], 0
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) > self.capacity(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                x = np.sort(self.levels[h])
                keep = x[len(x) - len(x) % 2 :]  # an odd item stays behind
                x = x[: len(x) - len(x) % 2]
                self.levels[h] = keep
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], x[int(self.rng.integers(2)) :: 2]])
                self.err2 += 4.0**h
            h += 1

    def merge(self, n: int, lo: float, hi: float, err2: float, sizes: bytes, items: bytes) -> None:
        if not n:
            return
        self.settle()
        levels = np.split(np.frombuffer(items), np.cumsum(np.frombuffer(sizes, dtype=np.int32))[:-1])
        self.n, self.lo, self.hi, self.err2 = self.n + int(n), min(self.lo, lo), max(self.hi, hi), self.err2 + err2
        for h, x in enumerate(levels):
            if h == len(self.levels):
                self.levels.append(np.empty(0))
            self.levels[h] = np.concatenate([self.levels[h], x])
        self.settle()

    def row(self) -> tuple:
        self.settle()
        return self.n, self.lo, self.hi, self.err2, np.array([len(x) for x in self.levels], dtype=np.int32).tobytes(), np.concatenate(self.levels).tobytes()

    def error(self, delta: float) -> float:
        return math.sqrt(2 * self.err2 * math.log(2 / delta)) / self.n if self.n else 0.0

    def quantiles(self, ps: Sequence[float]) -> list[float]:
        """The value of rank ceil(p * n), exact for p = 0 and 1."""
        self.settle()
        if len(self.levels) == 1:  # nothing was compacted
            x = np.sort(self.levels[0])
            return [float(x[min(len(x) - 1, max(0, math.ceil(p * len(x)) - 1))]) for p in ps]
        x = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(v), 2.0**h) for h, v in enumerate(self.levels)])
        order = np.argsort(x, kind="stable")
        x, c = x[order], np.cumsum(w[order])
        return [self.lo if p <= 0 else self.hi if p >= 1 else float(x[min(len(x) - 1, int(np.searchsorted(c, p * c[-1], side="left")))]) for p in ps]


def _schema(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def sketch(df: DataFrame, by: list[str], values: list[str], *, sets: dict[str, list[str]] | None = None, k: int = K, seed: int = 5, max_items: int = 2_000_000) -> DataFrame:
    """One sketch per partition, group ``by`` and value column (named in ``metric``).

    sets: name -> some of ``by``; one pass then sketches every grouping set, named in ``level``, and the
    columns a set leaves out are null. Null and NaN values are left out, a null group is a group, an
    empty table has no sketches. What a task holds is bounded by max_items: beyond it the sketches are
    handed on and begun anew. Other columns are ignored. Draws are seeded by partition and group.
    """
    out = ("level string, " if sets else "") + _schema(df, by) + ", metric string, part int, " + SKETCH
    groups = list((sets or {"": by}).items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: dict[tuple, Sketch] = {}
        items = 0
        for b in batches:
            arrays = [b[v].to_numpy(dtype=float) for v in values]
            for level, cols in groups:
                for key, idx in b.groupby(cols, dropna=False, sort=False).indices.items():
                    named = dict(zip(cols, key if isinstance(key, tuple) else (key,)))
                    key = tuple(None if pd.isna(named.get(c)) else named[c] for c in by)
                    for v, x in zip(values, arrays):
                        x = x[idx]
                        x = x[np.isfinite(x)]
                        if len(x):
                            at = (*((level,) if sets else ()), *key, v)
                            if at not in held:
                                held[at] = Sketch(k, np.random.default_rng([seed, part, zlib.crc32(repr(at).encode())]))
                            held[at].update(x)
                            items += len(x)
            if items > max_items:
                items = sum(s.waiting + sum(map(len, s.levels)) for s in held.values())
                if items > max_items:
                    yield _frame(held, by, part, bool(sets))
                    held, items = {}, 0
        if held:
            yield _frame(held, by, part, bool(sets))

    return df.select(*by, *values).mapInPandas(run, out)


def _frame(held: dict[tuple, Sketch], by: list[str], part: int, named: bool) -> pd.DataFrame:
    rows = [(*key, np.int32(part), *s.row()) for key, s in held.items()]
    return pd.DataFrame(rows, columns=[*(["level"] if named else []), *by, "metric", "part", *FIELDS])


def merge(sketches: DataFrame, by: list[str], *, k: int = K, seed: int = 6) -> DataFrame:
    """Merge sketches level by level to one a group; ``by`` may drop columns the sketches have."""
    out = _schema(sketches, by) + ", " + SKETCH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, s = None, None, None
        done = lambda: first if s is None else (*now, *s.row())
        for b in batches:  # sorted by group
            rows = []
            for r in b.itertuples(index=False, name=None):
                key = tuple(None if pd.isna(v) else v for v in r[: len(by)])
                if key != now:
                    if now is not None:
                        rows.append(done())
                    now, first, s = key, (*key, *r[len(by) :]), None  # a sketch alone stays as it is
                else:
                    if s is None:
                        s = Sketch(k, np.random.default_rng([seed, zlib.crc32(repr(key).encode())]))
                        s.merge(*first[len(by) :])
                    s.merge(*r[len(by) :])
            yield pd.DataFrame(rows, columns=[*by, *FIELDS])
        if now is not None:
            yield pd.DataFrame([done()], columns=[*by, *FIELDS])

    return sketches.select(*by, *FIELDS).repartition(*by).sortWithinPartitions(*by, "n", "lo", "hi", "items").mapInPandas(run, out)


def merge_tree(sketches: DataFrame, by: list[str], *, fan_in: int = 256, k: int = K) -> DataFrame:
    """Merge ranges of fan_in partitions, then ranges of those, until one is left: no task ever meets more
    than fan_in sketches of a group (but for those that max_items divided)."""
    now = materialize(sketches)
    last = now.agg(F.max("part")).first()[0] or 0
    while True:
        last //= fan_in
        now = materialize(merge(now.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")), [*by, "part"], k=k))
        if not last:
            return now


def percentiles(sketches: DataFrame, by: list[str], ps: Sequence[float], *, k: int = K, delta: float = 1e-3) -> DataFrame:
    """Per group and p: the value, the bound on its rank error and the confidence 1 - delta.

    k: of the sketches, so that reading them compacts nothing."""
    out = _schema(sketches, by) + ", n long, p double, value double, rank_error double, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b[[*by, *FIELDS]].itertuples(index=False, name=None):
                s = Sketch(k)
                s.merge(*r[len(by) :])
                if s.n:
                    rows += [(*r[: len(by)], s.n, p, v, s.error(delta), 1 - delta) for p, v in zip(ps, s.quantiles(ps))]
            yield pd.DataFrame(rows, columns=[*by, "n", "p", "value", "rank_error", "confidence"])

    return sketches.mapInPandas(run, out)
