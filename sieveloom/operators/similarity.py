"""Distances between embeddings and between histograms."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.operators.selection import top_per_group
from sieveloom.runtime import materialize


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - unit(a) @ unit(b).T


def euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def grid(left: DataFrame, right: DataFrame, block: int, shape: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides cut by hash into pieces of about ``block`` rows, or into the numbers of pieces of ``shape``, each
    repeated for every piece of the other."""
    parts, blocks = shape or (max(1, -(-left.count() // block)), max(1, -(-right.count() // block)))
    piece = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("part", piece(parts)).withColumn("block", all_(blocks))
    b = right.withColumn("rblock", piece(blocks)).withColumn("rpart", all_(parts))
    return a, b.select(*[F.col(c).alias(c if c in ("rblock", "rpart") else f"r{c}") for c in b.columns])


def nearest(left: DataFrame, right: DataFrame, k: int = 1, metric: str = "cosine", block: int = 4096, others: bool = False) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest rows of right for each row (id, vec) of left.

    The right side is cut into blocks of about ``block`` rows; each pairs a block with a partition of the
    left as two matrices and keeps k rows a left id, and the lists of the blocks are merged. No pair is
    materialised as a row, and no side is broadcast. Null and empty vectors take no part. others: a row is
    no neighbour of the row with its own id.
    """
    dist = {"cosine": cosine, "euclid": euclid}[metric]
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0)
    left, right = left.where(ok).select("id", "vec"), right.where(ok).select("id", "vec")
    a, b = grid(left, right.select("id", "vec"), block)

    def run(_, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        cols = ["id", "neighbour", "distance"]
        if x.empty or y.empty:
            return pd.DataFrame([], columns=cols)
        d = dist(np.stack(x["vec"].to_numpy()).astype(float), np.stack(y["rvec"].to_numpy()).astype(float))
        if others:
            d[x["id"].to_numpy()[:, None] == y["rid"].to_numpy()[None, :]] = np.inf
        r = np.round(d, 12)
        if 4 * k < d.shape[1]:  # all within the k-th distance, ties included, are ordered; the others can't be among the k
            near = np.partition(r, k - 1, axis=1)[:, k - 1 : k]
            most = int((r <= near).sum(axis=1).max())
            pick = np.argpartition(np.where(r <= near, r, np.inf), most - 1, axis=1)[:, :most]
        else:
            pick = np.broadcast_to(np.arange(d.shape[1]), d.shape)
        rank = np.lexsort((y["rid"].to_numpy()[pick], np.take_along_axis(r, pick, axis=1)), axis=1)[:, :k]
        order = np.take_along_axis(pick, rank, axis=1)
        out = pd.DataFrame({"id": np.repeat(x["id"].to_numpy(), order.shape[1]), "neighbour": y["rid"].to_numpy()[order].ravel(), "distance": np.take_along_axis(d, order, axis=1).ravel()})
        return out[np.isfinite(out["distance"])] if others else out

    kind, kind2 = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    got = a.groupBy("part", "block").cogroup(b.groupBy("rpart", "rblock")).applyInPandas(run, f"id {kind}, neighbour {kind2}, distance double")
    best = top_per_group(got, ["id"], [F.round("distance", 12), F.col("neighbour")], k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 12), "neighbour")))


def within(left: DataFrame, right: DataFrame, radius: str = "r", metric: str = "euclid", block: int = 4096, others: bool = False) -> DataFrame:
    """(id, hits): for each row (id, vec) of left the rows (id, vec, radius) of right whose radius exceeds the distance.

    others: a row is no hit of the row with its own id."""
    dist = {"cosine": cosine, "euclid": euclid}[metric]
    a, b = grid(left.select("id", "vec"), right.select("id", "vec", F.col(radius).alias("r")), block)

    def run(_, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame([], columns=["id", "hits"])
        d = dist(np.stack(x["vec"].to_numpy()).astype(float), np.stack(y["rvec"].to_numpy()).astype(float))
        hit = d < y["rr"].to_numpy()[None, :] - 1e-9
        if others:
            hit &= x["id"].to_numpy()[:, None] != y["rid"].to_numpy()[None, :]
        return pd.DataFrame({"id": x["id"], "hits": hit.sum(axis=1)})

    got = a.groupBy("part", "block").cogroup(b.groupBy("rpart", "rblock")).applyInPandas(run, f"id {left.schema['id'].dataType.simpleString()}, hits long")
    return got.groupBy("id").agg(F.sum("hits").alias("hits"))


def packed(df: DataFrame) -> DataFrame:
    """Histograms in rows (id, cell_key, p) as one row (id, cells, ps) each; rows with a null take no part."""
    ok = "id is not null and cell_key is not null and p is not null"
    return df.where(ok).groupBy("id").agg(F.collect_list("cell_key").alias("cells"), F.collect_list("p").alias("ps"))  # as many entries as the grid has cells


def numbered(*sides: DataFrame) -> tuple[list[DataFrame], int]:
    """Packed histograms with numbers from 0 on for cells, the same in all sides, and how many there are: about half the bytes to move.

    The driver and each task hold the cells of the grid."""
    cells = functools.reduce(DataFrame.union, [s.select(F.explode("cells").alias("cell")) for s in sides])
    names = pa.array(sorted(r["cell"] for r in cells.distinct().collect()), pa.string())  # one row a cell of the grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            c = t["cells"]
            codes = pc.index_in(pc.cast(c.flatten(), pa.string()), names)
            ends = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy())]), pa.int32())
            yield pa.record_batch([t["id"], pa.ListArray.from_arrays(ends, codes), t["ps"]], names=["id", "cells", "ps"])

    return [s.mapInArrow(run, f"id {s.schema['id'].dataType.simpleString()}, cells array<int>, ps array<double>") for s in sides], len(names)


def entries(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and share of each entry of packed histograms (id, cells, ps)."""
    cells, ps = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t["cells"], t["ps"]))
    return np.repeat(np.arange(len(t), dtype=np.int32), pc.list_value_length(cells).to_numpy()), cells.flatten().to_numpy(), ps.flatten().to_numpy()


class ByCell(NamedTuple):
    """Some histograms, by cell: the rows and shares of cell c are those from cut[c] to cut[c + 1]."""

    width: int
    row: np.ndarray
    share: np.ndarray
    cut: list[int]


def by_cell(t: pa.Table | pa.RecordBatch, n: int) -> ByCell:
    row, cell, share = entries(t)
    order = np.argsort(cell, kind="stable")
    return ByCell(len(t), row[order], share[order], np.searchsorted(cell[order], np.arange(n + 1)).tolist())


def fit_rows(x: pa.Table, y: pa.Table | Sequence[ByCell], chunk: int = 16_384, held: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """(first, fits): the fits of rows of x from ``first`` on with all rows of y, packed histograms both (id, cells, ps);
    cells by name, or by number where y comes in pieces by cell.

    At most about ``held`` fits are held at once. For chunks of y each cell has the list of its rows and shares; a row
    of x adds up the lists of its own cells, so cells that only one of two histograms has cost nothing.
    """
    if isinstance(y, pa.Table):
        cells = [t["cells"].combine_chunks() for t in (x, y)]
        names = pc.unique(pa.concat_arrays([c.flatten() for c in cells]))
        x, y = (t.set_column(1, "cells", pa.array(np.split(pc.index_in(c.flatten(), names).to_numpy(), np.cumsum(pc.list_value_length(c).to_numpy())[:-1]), pa.list_(pa.int32()))) for t, c in zip((x, y), cells))
        y = [by_cell(y.slice(at, chunk), len(names)) for at in range(0, len(y), chunk)]
    xrow, xcell, xp = entries(x)
    total = sum(c.width for c in y)
    ends = np.searchsorted(xrow, np.arange(len(x) + 1)).tolist()
    step = max(1, held // max(1, total))
    for first in range(0, len(x), step):
        rows = [(i + np.argsort(xcell[i:j], kind="stable")) for i, j in zip(ends[first : first + step], ends[first + 1 : first + step + 1])]
        some = [list(zip(xcell[o].tolist(), xp[o].tolist())) for o in rows]
        fits, at = np.zeros((len(some), total)), 0
        for width, row, share, cut in y:
            for f, own in zip(fits, some):
                if own:
                    j = np.concatenate([row[cut[c] : cut[c + 1]] for c, _ in own])
                    f[at : at + width] = np.bincount(j, np.concatenate([np.minimum(share[cut[c] : cut[c + 1]], p) for c, p in own]), width)
            at += width
        yield first, fits


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x, 0 or more, rounded as DuckDB's round does."""
    y = x * 10.0**digits
    low = np.floor(y)
    return (low + (y - low >= 0.5)) / 10.0**digits


def blocks_apart(both: Iterator[pa.RecordBatch], n: int, chunk: int = 16_384) -> tuple[pa.Table, pa.Array, list[ByCell]]:
    """From rows (id, rid, cells, ps) those with an id, and the ids and the histograms by cell of those with an rid.

    The latter are put by cell as they come, so no second copy of them is held."""
    left, ids, right, waiting = [], [], [], []

    def put() -> None:
        t = pa.Table.from_batches(waiting).combine_chunks()
        ids.append(t["rid"].combine_chunks())
        right.append(by_cell(t, n))
        waiting.clear()

    for t in both:
        t = t.select(["id", "rid", "cells", "ps"])
        left.append(t.filter(pc.is_valid(t["id"])))
        some = t.filter(pc.is_valid(t["rid"]))
        if len(some):
            waiting.append(some)
        if sum(map(len, waiting)) >= chunk:
            put()
    if waiting:
        put()
    x = pa.Table.from_batches([t for t in left if len(t)] or left[:1]).combine_chunks()
    return x, pa.concat_arrays(ids) if ids else x["rid"].combine_chunks()[:0], right


def paired(a: DataFrame, b: DataFrame, pair: tuple, n: int) -> DataFrame:
    """Rows (pair, id, rid, cells, ps) of two sides (id, cells, ps), one of the ids null; n pairs, a partition each."""
    kind = a.schema["id"].dataType, b.schema["rid"].dataType
    one = a.select(pair[0].alias("pair"), "id", F.lit(None).cast(kind[1]).alias("rid"), "cells", "ps")
    two = b.select(pair[1].alias("pair"), F.lit(None).cast(kind[0]).alias("id"), "rid", F.col("rcells").alias("cells"), F.col("rps").alias("ps"))
    return one.union(two).repartitionById(n, F.col("pair")).groupBy("pair")


def histogram_fits(left: DataFrame, right: DataFrame, k: int | None = None, zeros: bool = False, digits: int | None = None, block: int = 8192) -> DataFrame:
    """(id, rid, fit): the sum over common cells of the smaller share, for histograms in rows (id, cell_key, p).

    Histograms are paired in blocks, a task each; in a block each cell adds the smaller shares of the images that have it, so
    only pairs that are asked for become rows. A task gives out its rows as it goes, so its memory is that of two blocks.
    What moves is each side once for every block of the other, with numbers for cells. Batches are small, as the JVM holds them too.
    k: the k best of each left id, fits compared to nine digits, then by rid; zeros: pairs without a common cell come
    out too, with 0, which k never does; digits: fits come out rounded, in the block, as a round of Spark's costs more
    than the fit. Rows with a null id, cell or share take no part; an empty side gives no rows.
    """
    a, b = materialize(packed(left)), materialize(packed(right))
    n, m, tasks = a.count(), b.count(), 4 * left.sparkSession.sparkContext.defaultParallelism
    parts, blocks = max(1, -(-n // block)), max(1, -(-m // block))
    while parts * blocks < tasks and max(n // parts, m // blocks) > min(block, 512):  # small sides occupy all cores too
        parts, blocks = (parts + 1, blocks) if n // parts > m // blocks else (parts, blocks + 1)
    (a, b), cells = numbered(a, b)
    a, b = grid(a, b, block, (parts, blocks))
    kind = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    pair = lambda p, q: F.col(p) * blocks + F.col(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, two, y = blocks_apart(batches, cells)
        one, by_id = x["id"].combine_chunks(), pc.sort_indices(two).to_numpy()
        two = two.take(pa.array(by_id))
        for first, some in fit_rows(x, y, held=125_000) if len(x) and y else ():
            fit = some[:, by_id]
            if k:
                best = np.argsort(-np.round(fit, 9), axis=1, kind="stable")[:, :k]
                i, j = np.repeat(np.arange(len(fit)), best.shape[1]), best.ravel()
                i, j = i[fit[i, j] > 0], j[fit[i, j] > 0]
            else:
                i, j = np.nonzero(np.ones_like(fit) if zeros else fit)
            f = fit[i, j] if digits is None else half_up(fit[i, j], digits)
            yield pa.record_batch([one.take(pa.array(first + i)), two.take(pa.array(j)), pa.array(f)], names=["id", "rid", "fit"])

    got = paired(a, b, (pair("part", "block"), pair("rpart", "rblock")), parts * blocks).applyInArrow(run, f"id {kind[0]}, rid {kind[1]}, fit double")
    return top_per_group(got, ["id"], [F.round("fit", 9).desc(), F.col("rid")], k) if k else got


def fit_percentile(left: DataFrame, right: DataFrame, p: float, pairs: bool = False, digits: int | None = None, block: int = 65_536) -> DataFrame:
    """(id, low, high, share, most): for each left id the fits on either side of the percentile p of its fits above 0,
    the share of the way between them where it lies, and the largest; ids without a fit don't come out. pairs:
    (id, rid, fit, cut), the pairs that reach the percentile, and those less than 1e-8 below it, so that the caller rounds;
    with digits (id, rid), those that reach it when both are rounded.

    A task holds the histograms of the whole right side, twelve bytes an entry, and all fits of a few left rows at a time,
    and gives out its rows as it goes, so no pair is moved, or held longer, to find a percentile. The right side is sent
    once for each part of up to ``block`` left rows.
    """
    a, b = materialize(packed(left)), materialize(packed(right))
    n = a.count()
    parts = max(1, -(-n // block), min(2 * left.sparkSession.sparkContext.defaultParallelism, -(-n // 512)))
    (a, b), cells = numbered(a, b)
    a = a.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    b = b.select(F.col("id").alias("rid"), F.col("cells").alias("rcells"), F.col("ps").alias("rps"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("rpart"))
    kind = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    names = ["id", "rid", "fit", "cut"][: 4 if digits is None else 2] if pairs else ["id", "low", "high", "share", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, two, y = blocks_apart(batches, cells)
        one = x["id"].combine_chunks()
        for first, fits in fit_rows(x, y, held=1_000_000) if len(x) and y else ():
            none, out = len(two) - np.count_nonzero(fits, axis=1), []
            for i, (f, zeros) in enumerate(zip(fits, none.tolist()), first):
                if zeros == len(f):
                    continue
                at = (len(f) - zeros - 1) * p
                lower, share = zeros + int(at), at - int(at)
                upper = min(lower + 1, len(f) - 1)
                low, high = np.partition(f, [lower, upper])[[lower, upper]].tolist()
                if pairs:
                    cut = low if share == 0 else (1 - share) * low + share * high
                    j = np.nonzero((f >= cut - 1e-8) & (f > 0))[0]
                    if digits is not None:
                        j = j[half_up(f[j], digits) >= half_up(np.array([cut]), digits)]
                    out.append((np.full(len(j), i), j, f[j], np.full(len(j), cut))[: len(names)])
                else:
                    out.append((i, low, high, share, float(f.max())))
            if out and pairs:
                i, j, *rest = map(np.concatenate, zip(*out))
                yield pa.record_batch([one.take(pa.array(i)), two.take(pa.array(j)), *map(pa.array, rest)], names=names)
            elif out:
                i, *rest = zip(*out)
                yield pa.record_batch([one.take(pa.array(i)), *map(pa.array, rest)], names=names)

    schema = ", ".join(f"{c} {dict(zip(('id', 'rid'), kind)).get(c, 'double')}" for c in names)
    return paired(a, b, (F.col("part"), F.col("rpart")), parts).applyInArrow(run, schema)


def mean_vector(df: DataFrame, vec: str = "vec") -> DataFrame:
    """One row, the element-wise mean of an array column, by (position, value) sums."""
    e = df.select(F.posexplode(vec).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    return e.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))  # one entry a dimension


def moments(df: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of vectors: each task adds up its outer products, the driver the tasks' sums."""

    def run(batches):
        n, s, q = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_numpy()).astype(float)
                n, s, q = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    rows = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(vec).alias("vec")).mapInPandas(run, "n long, s array<double>, q array<double>").collect()  # one row a task
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, s = sum(r["n"] for r in rows), np.sum([r["s"] for r in rows], axis=0)
    q = np.sum([r["q"] for r in rows], axis=0).reshape(len(s), len(s))
    return n, s / n, (q - np.outer(s, s) / n) / max(n - 1, 1)


def frechet(a: DataFrame, b: DataFrame) -> float | None:
    """Frechet distance of two sets of vectors taken as normal; none if either is empty."""
    (n, m, c), (k, o, e) = moments(a), moments(b)
    if not n or not k:
        return None
    w, v = np.linalg.eigh(c)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ e @ root), 0)).sum()
    return float(((m - o) ** 2).sum() + np.trace(c) + np.trace(e) - 2 * cross)
