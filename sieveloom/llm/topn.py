"""The N best items of every group, each item once with its best score.

A mergeable aggregate: every task keeps a bounded list of N items a group before the shuffle, and
the lists are merged afterwards. Items compare by score, then by the bytes of their identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shrink(b: pd.DataFrame, n: int) -> pd.DataFrame:
    """The N best rows (g, i, s) of each group; an item counts once. Strings sort by code point, as their bytes do."""
    b = b.sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable", ignore_index=True)
    b = b[~b.duplicated(["g", "i"])]
    return b[b.groupby("g", sort=False).cumcount() < n]


def _partial(n: int, max_rows: int, least: int = 50_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, new, waiting = None, [], 0
        for b in batches:
            new.append(b)
            waiting += len(b)
            if waiting < max(least, 0 if held is None else len(held)):  # sorted again only when the rows have doubled
                continue
            held, new, waiting = _shrink(pd.concat(new if held is None else [held, *new], ignore_index=True), n), [], 0
            if len(held) > max_rows:  # merged again after the shuffle
                yield held
                held = None
        if new:
            held = _shrink(pd.concat(new if held is None else [held, *new], ignore_index=True), n)
        if held is not None and len(held):
            yield held

    return run


def _final(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        ranked = lambda x: x.assign(rank=(x.groupby("g", sort=False).cumcount() + 1).astype(np.int32))
        for b in batches:  # sorted by group: all but the last group are complete
            held = _shrink(b if held is None else pd.concat([held, b], ignore_index=True), n)
            last = held["g"].to_numpy() == held["g"].iloc[-1] if len(held) else np.zeros(0, bool)
            yield ranked(held[~last])
            held = held[last]
        if held is not None and len(held):
            yield ranked(held)

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, *, max_rows: int = 500_000) -> DataFrame:
    """Columns group, item, score, rank of the N best items of each group.

    Rows with a null group, item or score or a NaN score don't count; infinities do. A repeated item
    counts once, with its highest score; equal scores go by the item's bytes, ascending. Groups with
    fewer items give what they have, an empty table gives none, other columns are ignored. What a
    group sends over the network is at most n rows a task, however many rows it has.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    schema = f"g {rows.schema['g'].dataType.simpleString()}, i {rows.schema['i'].dataType.simpleString()}, s double"
    part = rows.mapInPandas(_partial(n, max_rows, min(50_000, max_rows)), schema)
    done = part.repartition("g").sortWithinPartitions("g").mapInPandas(_final(n), schema + ", rank int")
    return done.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")


def best_of_array(array: str, item: str, score: str, n: int):
    """Expression: of an array of structs the at most n best (item, score), each item once; null stays null.

    Applied before rows are exploded, it is the first level of the merge."""
    valid = F.filter(F.col(array), lambda x: x.isNotNull() & x[item].isNotNull() & x[score].isNotNull() & ~F.isnan(x[score]))
    pairs = F.transform(valid, lambda x: F.struct((-x[score]).alias("neg"), x[item].alias("item")))
    ranked = F.array_sort(pairs)
    # an item repeated within one array may take several of the n places only if all are kept
    return F.when(F.size(F.array_distinct(F.transform(valid, lambda x: x[item]))) == F.size(valid), F.slice(ranked, 1, n)).otherwise(ranked)
