"""Balanced samples that follow target category proportions, by the cube method.

Each record starts with an inclusion probability pi of its category. A flight phase moves the
probabilities of two records of one category along the kernel vector (+1, -1) of the category
indicator until one of them is 0 or 1, so the category total never changes. Flights run inside
each partition in vectorised rounds, with at most one undecided record a category left over; the
undecided records merge upward in groups of partitions until one group is left. There the landing
drops the balancing variables one family after the other (joint category, then each margin, then
the total) and decides the remainder. Partitions and draws go by record ids, so one table gives one
sample however it is laid out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.runtime import broadcast_if_small, materialize

EPS = 1e-9
SCHEMA = "id long, cat int, p double, part int"


def pair_flight(cat: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight on category indicators: at most one undecided unit a category is left; totals are kept."""
    p = p.astype(float).copy()
    while True:
        open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
        if len(open_) < 2:
            return snap(p)
        open_ = open_[rng.permutation(len(open_))]
        open_ = open_[np.argsort(cat[open_], kind="stable")]
        c = cat[open_]
        first = np.r_[True, c[1:] != c[:-1]]
        rank = np.arange(len(c)) - np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
        lead = np.flatnonzero((rank[:-1] % 2 == 0) & (c[:-1] == c[1:]))
        if not len(lead):
            return snap(p)
        a, b = open_[lead], open_[lead + 1]
        up, down = np.minimum(1 - p[a], p[b]), np.minimum(p[a], 1 - p[b])
        go_up = rng.random(len(a)) * (up + down) < down
        step = np.where(go_up, up, -down)
        p[a] += step
        p[b] -= step
        p = snap(p)


def snap(p: np.ndarray) -> np.ndarray:
    p = np.where(p <= EPS, 0.0, p)
    return np.where(p >= 1 - EPS, 1.0, p)


def kernel_flight(x: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """General flight for balancing rows x (variables by units): moves in the kernel while there is one."""
    p = snap(p.astype(float).copy())
    while True:
        open_ = np.flatnonzero((p > 0) & (p < 1))
        if not len(open_):
            return p
        take = open_[: x.shape[0] + 1]
        here = x[:, take]
        here = here[here.any(axis=1)]
        if len(here) < len(take):  # the last column of the full orthogonal factor lies in the kernel
            u = np.linalg.qr(here.T, mode="complete")[0][:, -1]
        else:
            _, s, vt = np.linalg.svd(here, full_matrices=True)
            if int((s > 1e-9).sum()) >= len(take):
                return p
            u = vt[-1]
        u = np.where(np.abs(u) < 1e-12, 0.0, u)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - p[take]) / u, np.where(u < 0, -p[take] / u, np.inf)))
            down = np.min(np.where(u > 0, p[take] / u, np.where(u < 0, (p[take] - 1) / u, np.inf)))
        step = up if rng.random() * (up + down) < down else -down
        p[take] += step * u
        p = snap(p)


def landing(p: np.ndarray, margins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide what the flights left: balance the margins, then each alone, then the total, then toss."""
    n = len(p)
    total = np.ones((1, n))
    families = [np.vstack([total, *[(m[None, :] == np.unique(m)[:, None]) for m in margins]])]
    for m in margins:
        families.append(np.vstack([total, m[None, :] == np.unique(m)[:, None]]))
    families.append(total)
    for x in families:
        p = kernel_flight(x.astype(float), p, rng)
    open_ = (p > 0) & (p < 1)
    p[open_] = rng.random(int(open_.sum())) < p[open_]
    return p


def water_level(available: np.ndarray, minimum: np.ndarray, share: np.ndarray, size: float) -> float:
    """The level at which min(available, max(minimum, level * share)) adds up to size; the highest that changes
    anything if all records together are fewer, 0 if the minima alone are more."""
    s = share > 0
    points = np.unique(np.r_[0.0, minimum[s] / share[s], available[s] / share[s]])
    filled = np.array([np.minimum(available, np.maximum(minimum, x * share)).sum() for x in points])
    i = int(np.searchsorted(filled, size, side="right"))
    if i == 0 or i == len(points):
        return float(points[max(i - 1, 0)])
    return float(points[i - 1] + (size - filled[i - 1]) / (filled[i] - filled[i - 1]) * (points[i] - points[i - 1]))


def _partition_flight(seed: int, chunk: int = 50_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        held, n = [], 0

        def fly() -> tuple[pd.DataFrame, pd.DataFrame]:
            b = pd.concat(held, ignore_index=True)
            p = pair_flight(b["cat"].to_numpy(), b["p"].to_numpy(), rng)
            b, open_ = b.assign(p=p, part=np.int32(part)), (p > 0) & (p < 1)
            return b[~open_], b[open_]

        for b in batches:  # sorted by id; chunks don't depend on the size of batches
            while len(b):
                piece, b = b.iloc[: chunk - n], b.iloc[chunk - n :]
                held.append(piece)
                n += len(piece)
                if n == chunk:
                    done, rest = fly()
                    held, n = [rest], 0
                    yield done
        if held:
            done, rest = fly()
            yield done
            yield rest

    return run


def _group_flight(seed: int, level: int):
    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, 1 + level, int(key[0])])
        b = b.sort_values("id", ignore_index=True)
        p = pair_flight(b["cat"].to_numpy(), b["p"].to_numpy(), rng)
        return b.assign(p=p, part=np.int32(key[0]))[["id", "cat", "p", "part"]]

    return run


def _landing(seed: int, margins: dict[int, tuple[int, ...]]):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, 99])
        b = b.sort_values("id", ignore_index=True)
        p = pair_flight(b["cat"].to_numpy(), b["p"].to_numpy(), rng)
        m = np.array([margins[int(c)] for c in b["cat"]]).T
        open_ = np.flatnonzero((p > 0) & (p < 1))
        if len(open_):
            p[open_] = landing(p[open_], m[:, open_], rng)
        return b.assign(p=p)[["id", "cat", "p", "part"]]

    return run


@dataclass
class BalancedSample:
    #: id, the key columns as written in the targets, selected
    decided: DataFrame
    #: one row a target: available, wanted, allotted, selected, sample_share, share_gap, residual, unmet_share, unmet_min
    report: DataFrame
    #: one row a value of each key column: allotted, selected, residual
    margins: DataFrame
    #: one row a category: what it asks for and what it is given
    quotas: DataFrame


def balanced_sample(records: DataFrame, targets: DataFrame, keys: list[str], record_id: str, *, fraction: float = 0.2, share: str = "target_share", minimum: str = "min_rows", canonical=None, seed: int = 17, fan_in: int = 16, piece_rows: int = 200_000, max_categories: int = 10_000) -> BalancedSample:
    """Draw a sample of ``fraction`` of the eligible records whose category shares follow the targets.

    records: one row a record with ``record_id`` (long) and ``keys``; other columns are ignored, so
    clashing names do no harm. targets: ``keys``, ``share`` (null asks for none) and ``minimum``.
    canonical: key -> function of a column giving the form in which keys are compared.
    The number of target rows is bounded by max_categories (checked); they alone reach the driver.

    Defined results: records with a null id or a category without a target are not eligible; null keys
    equal each other; an empty table gives an empty sample and a report in which every positive target
    or minimum is unmet; targets naming one category twice share its records (the larger wish counts).
    Categories smaller than their wish are taken whole and reported. What they leave over goes to the other
    categories with a share, in proportion to the shares, so the sample has its size if there are records
    enough: each gets min(available, max(minimum, level x share)) with one level for all. The report
    has the share of each category in the records drawn and its gap to the target.
    """
    canon = canonical or {}
    key = [f"_k{i}" for i in range(len(keys))]
    form = lambda c: canon.get(c, F.col)(c)
    wish = targets.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(keys)], *[form(c).alias(key[i]) for i, c in enumerate(keys)], F.col(share).cast("double").alias("_share"), F.col(minimum).cast("long").alias("_min"))
    cats = [tuple(r) for r in wish.select(*key).distinct().limit(max_categories + 1).collect()]
    if len(cats) > max_categories:
        raise ValueError(f"more than {max_categories} target categories")
    cats.sort(key=lambda t: tuple((v is None, str(v)) for v in t))
    spark = records.sparkSession
    levels = [sorted({t[i] for t in cats}, key=lambda v: (v is None, str(v))) for i in range(len(keys))]
    margin_of = {n: tuple(levels[i].index(t[i]) for i in range(len(keys))) for n, t in enumerate(cats)}
    kinds = [wish.schema[k].dataType.simpleString() for k in key]
    table = spark.createDataFrame([(n, *t) for n, t in enumerate(cats)], "_cat int, " + ", ".join(f"{k} {t}" for k, t in zip(key, kinds)))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    table = broadcast_if_small(table, max_categories)

    mine = records.select(F.col(record_id).cast("long").alias("id"), *[form(c).alias(key[i]) for i, c in enumerate(keys)]).where("id is not null")
    mine = mine.join(table, same(mine, table)).select("id", F.col("_cat").alias("cat"))
    mine = materialize(mine)
    counts = mine.groupBy("cat").agg(F.count("*").alias("available"))
    have = {r["cat"]: r["available"] for r in counts.collect()}
    total = sum(have.values())
    size = fraction * total

    # what a category asks for and is given, and its inclusion probability: tables of the size of the targets
    share_of, least, index = np.zeros(len(cats)), np.zeros(len(cats)), {t: n for n, t in enumerate(cats)}
    for r in wish.collect():
        n = index[tuple(r[k] for k in key)]
        share_of[n], least[n] = max(share_of[n], r["_share"] or 0.0), max(least[n], float(r["_min"] or 0))
    stock = np.array([float(have.get(n, 0)) for n in range(len(cats))])
    asked = np.maximum(share_of * size, least)
    given = np.minimum(stock, np.maximum(least, water_level(stock, least, share_of * size, size) * share_of * size)) if cats else stock
    pi = [(n, float(min(1.0, given[n] / stock[n])) if stock[n] else 0.0) for n in range(len(cats))]
    probs = F.broadcast(spark.createDataFrame(pi, "cat int, p double"))

    pieces = max(1, -(-total // piece_rows))
    start = mine.join(probs, "cat").select("id", "cat", "p", F.lit(0).alias("part")).repartition(pieces, "id").sortWithinPartitions("id")
    flown = materialize(start.mapInPandas(_partition_flight(seed), SCHEMA))
    parts = [flown.where("p = 0 or p = 1")]
    open_, level = flown.where("p > 0 and p < 1"), 0
    groups = (open_.agg(F.max("part")).first()[0] or 0) + 1
    while groups > fan_in:
        step = materialize(open_.groupBy(F.floor(F.col("part") / fan_in).cast("int").alias("_g")).applyInPandas(_group_flight(seed, level), SCHEMA))
        parts.append(step.where("p = 0 or p = 1"))
        open_, groups, level = step.where("p > 0 and p < 1"), -(-groups // fan_in), level + 1
    # what is left: at most fan_in records a category
    parts.append(materialize(open_.groupBy().applyInPandas(_landing(seed, margin_of), SCHEMA)))
    decided = parts[0]
    for x in parts[1:]:
        decided = decided.unionByName(x)
    decided = decided.select("id", "cat", (F.col("p") == 1).alias("selected"))

    got = decided.groupBy("cat").agg(F.count("*").alias("available"), F.sum(F.col("selected").cast("long")).alias("selected"))
    wanted = spark.createDataFrame([(n, float(asked[n]), float(given[n])) for n in range(len(cats))], "cat int, wanted double, allotted double")
    per_cat = table.join(F.broadcast(wanted), table["_cat"] == wanted["cat"]).drop("cat").join(got, F.col("_cat") == got["cat"], "left")
    drawn = F.sum("selected").over(Window.partitionBy())  # one row a category
    per_cat = per_cat.select("_cat", *key, "wanted", "allotted", F.coalesce("available", F.lit(0)).cast("long").alias("available"), F.coalesce("selected", F.lit(0)).cast("long").alias("selected")).withColumn("_drawn", drawn)
    joined = wish.join(per_cat, [wish[k].eqNullSafe(per_cat[k]) for k in key])
    report = joined.select(
        *[F.col(f"_w{i}").alias(c) for i, c in enumerate(keys)],
        F.col("_share").alias("target_share"),
        F.col("_min").alias("min_rows"),
        "available",
        "wanted",
        "allotted",
        "selected",
        F.when(F.col("_drawn") > 0, F.col("selected") / F.col("_drawn")).alias("sample_share"),
        F.when(F.col("_drawn") > 0, F.col("selected") / F.col("_drawn") - F.col("_share")).alias("share_gap"),
        (F.col("selected") - F.col("allotted")).alias("residual"),
        (F.col("available") < F.coalesce(F.col("_share") * F.lit(fraction) * F.lit(float(total)), F.lit(0.0))).alias("unmet_share"),
        (F.col("available") < F.coalesce("_min", F.lit(0))).alias("unmet_min"),
    )
    margins = None
    for i, c in enumerate(keys):
        one = per_cat.groupBy(F.lit(c).alias("dimension"), F.col(key[i]).cast("string").alias("value")).agg(F.sum("allotted").alias("allotted"), F.sum("selected").alias("selected")).withColumn("residual", F.col("selected") - F.col("allotted"))
        margins = one if margins is None else margins.unionByName(one)
    stocked = spark.createDataFrame([(n, int(stock[n]), float(asked[n]), float(given[n])) for n in range(len(cats))], "cat int, available long, wanted double, allotted double")
    quotas = table.join(F.broadcast(stocked), F.col("_cat") == F.col("cat")).select(*[F.col(k).alias(c) for k, c in zip(key, keys)], "available", "wanted", "allotted")
    back = table.select("_cat", *[F.col(k).alias(c) for k, c in zip(key, keys)])
    return BalancedSample(decided.join(F.broadcast(back), decided["cat"] == back["_cat"]).select("id", *keys, "selected"), report, margins, quotas)
