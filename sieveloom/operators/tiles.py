"""Sites on grids of tiles: square blocks of an image with a rim, many images at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.operators.selection import top_per_group

#: Tiles along a block's side; a block with its rim is what a task holds of an image, however long the image is.
BLOCK = 64
FOOT = [(0, 0), (1, 0), (0, 1), (1, 1)]
RING = [(x, y) for y in (-1, 0, 1, 2) for x in (-1, 0, 1, 2) if (x, y) not in FOOT]


def in_blocks(tiles: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Each tile (gx, gy) in its block (bx, by), ``own``, and in the neighbouring blocks whose rim it lies in.

    before, after: how far a site reaches to smaller and to larger coordinates."""

    def spots(c: str):
        b = F.floor(F.col(c) / F.lit(float(block)))
        first, last = F.floor((F.col(c) - after) / F.lit(float(block))), F.floor((F.col(c) + before) / F.lit(float(block)))
        return b.cast("int"), F.sequence(first.cast("int"), last.cast("int"))

    (x, xs), (y, ys) = spots("gx"), spots("gy")
    out = tiles.where("gx is not null and gy is not null").withColumns({"bx": F.explode(xs)}).withColumn("by", F.explode(ys))
    return out.withColumn("own", (F.col("bx") == x) & (F.col("by") == y))


def _place(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted codes of the tiles, with room for a rim between rows and blocks, and the width of a row."""
    image = pd.factorize(pd.MultiIndex.from_frame(b[["image_id", "bx", "by"]]))[0].astype(np.int64)
    x = b["gx"].to_numpy(dtype=np.int64) - b["bx"].to_numpy(dtype=np.int64) * BLOCK + 8
    y = b["gy"].to_numpy(dtype=np.int64) - b["by"].to_numpy(dtype=np.int64) * BLOCK + 8
    width = BLOCK + 24
    return (image * width + y) * width + x, image, width


def _ring_sites(batch: pd.DataFrame) -> pd.DataFrame:
    code, _, width = _place(batch)
    code, first = np.unique(code, return_index=True)
    b = batch.iloc[first]
    void, own, p = b["void"].to_numpy(dtype=bool), b["own"].to_numpy(dtype=bool), b["p"].to_numpy(dtype=float)
    cell = pd.factorize(b["cell_key"], use_na_sentinel=False)[0]

    def at(places: np.ndarray, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        want = code[places] + y * width + x
        i = np.minimum(np.searchsorted(code, want), len(code) - 1)
        return i, code[i] == want

    site = np.flatnonzero(own & ~void)
    for x, y in FOOT[1:]:
        i, there = at(site, x, y)
        site = site[there & ~void[i]]
    around = [at(site, x, y) for x, y in RING]
    there = np.stack([t for _, t in around], axis=1) if len(site) else np.zeros((0, len(RING)), bool)
    which = np.stack([i for i, _ in around], axis=1) if len(site) else np.zeros((0, len(RING)), int)
    score = np.zeros(len(site))
    for a in range(0, len(site), 20_000):
        t, w = there[a : a + 20_000], which[a : a + 20_000]
        c = np.where(t, cell[w], -1)
        n = (c[:, :, None] == c[:, None, :]).sum(axis=2)  # tiles of the ring with the same cell
        share = n / np.maximum(t.sum(axis=1, keepdims=True), 1)
        score[a : a + 20_000] = np.where(t, np.minimum(share, p[w]) / n, 0.0).sum(axis=1)
    some = there.any(axis=1)
    out = b.iloc[site[some]][["image_id", "gx", "gy"]].assign(score=score[some])
    return out.assign(r=out["score"].round(9)).sort_values(["image_id", "r", "gy", "gx"], ascending=[True, False, True, True]).drop_duplicates("image_id")[["image_id", "gx", "gy", "score"]]


def _whole_groups(keys: list[str], f):
    """Apply f to batches cut between groups of rows sorted by keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = np.ones(len(b), dtype=bool)
            for k in keys:
                last &= (b[k] == b[k].iloc[-1]).to_numpy() if len(b) else last
            if (~last).any():
                yield f(b[~last])
            rest = b[last]
        if rest is not None and len(rest):
            yield f(rest)

    return run


def ring_sites(tiles: DataFrame) -> DataFrame:
    """(image_id, gx, gy, score): the best 2 by 2 site of each image, whole and not void, whose ring is likest to
    the target distribution; ties go to the smaller gy, then gx.

    tiles: image_id, gx, gy, cell_key, void and p, the target share of the cell. One shuffle, by image and
    block. Tiles without a place take no part, one of several at a place counts, images without a whole
    site don't come out.
    """
    t = in_blocks(tiles.select("image_id", "gx", "gy", "cell_key", F.coalesce("void", F.lit(False)).alias("void"), F.coalesce("p", F.lit(0.0)).alias("p")), 1, 2)
    t = t.where("image_id is not null").repartition("image_id", "bx", "by").sortWithinPartitions("image_id", "bx", "by", "gy", "gx")
    kind = tiles.schema["image_id"].dataType.simpleString()
    best = t.mapInPandas(_whole_groups(["image_id", "bx", "by"], _ring_sites), f"image_id {kind}, gx int, gy int, score double")
    return top_per_group(best, ["image_id"], [F.round("score", 9).desc(), F.col("gy"), F.col("gx")], 1)
