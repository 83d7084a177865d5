"""Splits that keep related records together.

Records that share a key are related; components of keys that records tie together are found, the
label counts of each component are added up, and components are placed by iterative stratification:
the one with the rarest outstanding label first, into the split that needs that label most. The few
components that are large against a split are placed first, all in one task; the rest is divided by
hash into shards that are placed side by side. What a shard should give each split is told by running
totals over the shards before it, so the whole rounds once a label, however many shards there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions.parse import strip
from sieveloom.llm.graph import components
from sieveloom.runtime import materialize

#: What is added to a capture name for regions, derived pictures and copies; fixed values, a default of the functions below.
DERIVED = ["__tile_[0-9]+_[0-9]+", "_rot[0-9]+", "_aug[0-9]+", "_crop[0-9]+", "_blur[0-9]+", "_copy[0-9]*", "_flip(?:ud|lr)?", "_[hv]flip", "_mirror", "_resized?", "_scaled?", "_bright", "_dark", "_gray", "_noise[0-9]*", "_mask", " \\([0-9]+\\)", " - copy"]
PREFIXES = ["copy_of_"]
_EXTENSION = "\\.(?:png|jpe?g|bmp|tiff?|gif|webp)$"


def capture_name(stem: Column, derived: Sequence[str] = DERIVED, prefixes: Sequence[str] = PREFIXES) -> Column:
    """The name of the photograph within a file name without directory."""
    s = F.regexp_replace(F.lower(strip(stem)), _EXTENSION, "")
    if derived:
        s = F.regexp_replace(s, f"(?:{'|'.join(derived)})+$", "")
    return F.regexp_replace(s, f"^(?:{'|'.join(prefixes)})+", "") if prefixes else s


def unknown_endings(names: Column) -> Column:
    """The last word after ``_`` of a capture name, null without one: counted over a table, frequent
    endings of many photographs point to derived pictures that ``derived`` doesn't know."""
    end = F.regexp_extract(names, "_([a-z]+)[0-9]*$", 1)
    return F.when(end != "", end)


def photo_keys(image_id: str, image_path: str, defect_type: str, derived: Sequence[str] = DERIVED, prefixes: Sequence[str] = PREFIXES) -> tuple[Column, Column]:
    """The photograph by path and by id, null where it can't be told.

    A name of digits only counts within the last four directories; an id gives no directory, so such an
    id alone names nothing. derived, prefixes: patterns of what file names add to a capture name.
    """
    path = F.regexp_replace(F.regexp_replace(strip(image_path), "\\\\", "/"), "/+", "/")
    path = F.when(path != "", path)
    name = capture_name(F.element_at(F.split(path, "/"), -1), derived, prefixes)
    where = F.lower(F.regexp_extract(path, "([^/]+/[^/]+/[^/]+/[^/]+)/[^/]+$", 1))
    by_path = F.when(name == "", None).when(name.rlike("^[0-9]+$"), F.concat(where, F.lit("/"), name)).otherwise(name)
    sid, kind = F.lower(strip(image_id)), F.lower(F.col(defect_type))
    rest = F.when(kind.isNotNull() & F.startswith(sid, F.concat(kind, F.lit("_"))), F.substring(sid, F.length(kind) + 2, F.lit(1 << 20))).otherwise(sid)
    named = capture_name(rest, derived, prefixes)
    by_id = F.when((named == "") | named.rlike("^[0-9]+$"), None).otherwise(named)
    return by_path, by_id


def related(df: DataFrame, record_id: str, keys: Sequence[Column], carry: Sequence[str] = ()) -> DataFrame:
    """(record_id, component, carried columns): records tied together by any chain of shared keys.

    Null keys tie nothing; a record without any key is alone; rows without an id are left out. Only
    keys that occur together with another key enter the graph; the others are components as they are.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(F.col(record_id).alias("id"), *carry, *[k.alias(n) for n, k in zip(names, keys)]).where("id is not null")
    rows = materialize(rows.withColumn("_set", F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))).drop(*names))
    several = rows.where(F.size("_set") > 1).select("_set").distinct()
    edges = several.select(F.element_at("_set", 1).alias("a"), F.explode("_set").alias("b"))
    comp = components(edges)
    first = F.element_at("_set", 1)
    rows = rows.withColumn("_first", F.when(F.size("_set") > 0, first).otherwise(F.concat(F.lit("\u0000"), F.col("id").cast("string"))))
    rows = rows.join(comp, F.col("_first") == F.col("node"), "left")
    return rows.select("id", F.coalesce("component", "_first").alias("component"), *carry)


def place(vectors: np.ndarray, want: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Iterative stratification of components. vectors: components by labels; want: splits by labels, what
    each split still needs; room: records each split still needs. Changes want and room; returns the splits."""
    n, labels = vectors.shape
    left = vectors.sum(axis=0).astype(float)
    out = np.full(n, -1)
    tie = rng.random(n)
    size = vectors.sum(axis=1)
    order: list[list[int]] = []
    for l in range(labels):  # larger components first, ties at random
        idx = np.flatnonzero(vectors[:, l] > 0)
        order.append(idx[np.lexsort((tie[idx], -size[idx]))].tolist()[::-1])
    live = [l for l in range(labels) if order[l]]
    while live:
        l = min(live, key=lambda x: (left[x] if left[x] > 0 else math.inf, x))
        stack = order[l]
        while stack and out[stack[-1]] >= 0:
            stack.pop()
        if not stack:
            live.remove(l)
            continue
        c = stack.pop()
        v = vectors[c]
        s = max(range(len(want)), key=lambda x: (want[x, l], room[x], -x))
        out[c] = s
        want[s] -= v
        room[s] -= size[c]
        left -= v
    none = np.flatnonzero(out < 0)
    for c in none:  # components without labels
        s = int(np.argmax(room))
        out[c] = s
        room[s] -= size[c]
    return out


def split_shares(targets: DataFrame, name: str = "split_name", share: str = "share", most: int = 1_000) -> dict[str, float]:
    """The wanted share of each split; null and non-positive shares ask for nothing, more than ``most`` splits raise."""
    rows = targets.select(name, F.col(share).cast("double").alias("s")).where(F.col(name).isNotNull() & (F.col("s") > 0)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} splits")
    return {r[name]: r["s"] for r in rows}


def due(before: np.ndarray, own: np.ndarray, part: np.ndarray) -> np.ndarray:
    """What a shard with label counts ``own`` should give each split, after shards with ``before`` in all.

    part: splits by labels. The records of a label are numbered through all shards, and the multiples of the
    golden ratio tell the split of each number, so that any run of numbers is shared out nearly exactly."""
    out = np.zeros(part.shape)
    for l, (b, n) in enumerate(zip(before, own)):
        at = np.mod((b + np.arange(int(n)) + 0.5) * 0.6180339887498949, 1.0)
        out[:, l] = np.bincount(np.searchsorted(np.cumsum(part[:-1, l]), at, side="right"), minlength=len(part))
    return out


def grouped_splits(rows: DataFrame, component: str, label: str, shares: dict[str, float], *, seed: int = 3, shard_rows: int = 200_000, large: float = 1e-3, max_labels: int = 10_000) -> DataFrame:
    """(component, split): every component in one split, labels shared out in the given proportions.

    rows: one row a record. shares must be positive and are scaled to one. A null label is a label of
    its own; rows without a component are left out; an empty table has no splits. Components holding
    ``large`` of all records or more (at most 1/large of them) are placed first in one task, the others
    in shards of about shard_rows records; a label of few records in each shard is still shared out as
    the shares ask, see ``due``. The number of labels is bounded by max_labels (checked).
    """
    names, total_share = list(shares), sum(shares.values())
    share = np.array([shares[n] / total_share for n in names])
    rows = rows.select(F.col(component).alias("component"), F.coalesce(F.col(label).cast("string"), F.lit("\u0000")).alias("label")).where("component is not null")
    cells = materialize(rows.groupBy("component", "label").agg(F.count("*").alias("n")))
    totals = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("n").alias("n")).limit(max_labels + 1).collect()}
    if len(totals) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    labels = sorted(totals)
    index = {x: i for i, x in enumerate(labels)}
    total = sum(totals.values())
    shards = max(1, math.ceil(total / shard_rows))
    vec = cells.groupBy("component").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("v"))
    vec = materialize(vec.withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(shards)).cast("int")))
    count = np.array([totals[x] for x in labels], dtype=float)
    spark = rows.sparkSession
    kind = vec.schema["component"].dataType.simpleString()
    out = f"component {kind}, split string"
    if not labels:
        return spark.createDataFrame([], out)

    def counts(maps) -> np.ndarray:
        """Components by labels; only labels that occur take part in the placement."""
        m = np.zeros((len(maps), len(labels)))
        for i, v in enumerate(maps):
            for k, n in v.items() if isinstance(v, dict) else v:
                m[i, index[k]] = n
        return m

    big = vec.where(F.col("size") >= max(2.0, large * total)).orderBy(F.col("size").desc(), "component").limit(int(1 / large) + 1).collect()
    want, room = share[:, None] * count[None, :], share * total
    placed = place(counts([r["v"] for r in big]), want, room, np.random.default_rng(seed)) if big else []
    fixed = spark.createDataFrame([(r["component"], names[s]) for r, s in zip(big, placed)], out)
    # the proportions in which what is left of each label should go to the splits
    open_ = np.clip(want, 0, None)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(open_.sum(axis=0) > 0, open_ / open_.sum(axis=0), share[:, None])

    small = vec.where(F.col("size") < max(2.0, large * total))
    # label counts of every shard and of the shards before it: labels times shards rows
    held = small.select("shard", F.explode("v").alias("label", "n")).groupBy("shard", "label").agg(F.sum("n").alias("n"))
    upto = held.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = upto.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("label", "before"))).alias("before"))
    sent = small.select("shard", "component", "v").unionByName(upto.select("shard", F.lit(None).cast(kind).alias("component"), F.col("before").alias("v")))

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        head = b["component"].isna()
        before = counts(b.loc[head, "v"].tolist()).sum(axis=0)
        b = b[~head].sort_values("component", ignore_index=True)
        m = counts(b["v"].tolist())
        here = np.flatnonzero(m.sum(axis=0) > 0)
        w = due(before[here], m[:, here].sum(axis=0), part[:, here])
        s = place(m[:, here], w, w.sum(axis=1), np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame({"component": b["component"], "split": [names[i] for i in s]})

    return fixed.unionByName(sent.groupBy("shard").applyInPandas(run, out))
