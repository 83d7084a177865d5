"""Kernels over one image or array a row, in NumPy behind Arrow batches; run lengths natively."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- run-length masks -------------------------------------------------------------------------


def rle_runs(rle: Column | str) -> Column:
    """``start length start length ...`` as an array of (start, length), from 1 on, column by column."""
    p = F.filter(F.split(F.trim(F.col(rle) if isinstance(rle, str) else rle), "\\s+"), lambda x: x != "")
    v = F.transform(p, lambda x: x.try_cast("long"))
    idx = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(v) / 2).cast("int")))
    runs = F.transform(idx, lambda i: F.struct(F.try_element_at(v, 2 * i - 1).alias("start"), F.try_element_at(v, 2 * i).alias("length")))
    return F.filter(runs, lambda r: r["start"].isNotNull() & (r["length"] > 0))


def rle_area(rle: Column | str) -> Column:
    """Pixels of a run-length mask; null, empty and unreadable masks have 0."""
    return F.coalesce(F.aggregate(rle_runs(rle), F.lit(0).cast("long"), lambda a, r: a + r["length"]), F.lit(0).cast("long"))


def rle_box(rle: Column | str, height: int) -> Column:
    """Bounding box of a run-length mask of the given image height, null for an empty mask."""
    runs = rle_runs(rle)
    first = F.transform(runs, lambda r: r["start"] - 1)
    last = F.transform(runs, lambda r: r["start"] + r["length"] - 2)
    x0 = F.floor(F.array_min(first) / height)
    x1 = F.floor(F.array_max(last) / height)
    same = lambda r: F.floor((r["start"] - 1) / height) == F.floor((r["start"] + r["length"] - 2) / height)
    y0 = F.array_min(F.transform(runs, lambda r: F.when(same(r), (r["start"] - 1) % height).otherwise(0)))
    y1 = F.array_max(F.transform(runs, lambda r: F.when(same(r), (r["start"] + r["length"] - 2) % height).otherwise(height - 1)))
    box = F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), (x1 - x0 + 1).cast("int").alias("w"), (y1 - y0 + 1).cast("int").alias("h"))
    return F.when(F.size(runs) > 0, box)


def decoded_bitmap(text: str | None) -> tuple[int, int, list[int]] | None:
    """(height, width, values) of a base64 text of a zlib stream of a PNG file; a stream of anything else is one row of bytes."""
    try:
        raw = zlib.decompress(base64.b64decode(text))
    except (TypeError, ValueError, zlib.error):
        return None
    return png(raw) or (1, len(raw), list(raw))


def bitmap_mask(data: Column | str) -> Column:
    """The mask of a bitmap annotation as a struct (h, w, pixels); unreadable ones have null."""

    @F.pandas_udf("struct<h int, w int, pixels array<int>>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded_bitmap(t) or (None, None, None) for t in s], columns=["h", "w", "pixels"]).astype({"h": "Int32", "w": "Int32"})

    x = run(F.col(data) if isinstance(data, str) else data)
    return F.when(x["h"].isNotNull(), x)


def bitmap_area(data: Column | str) -> Column:
    """Set pixels of a bitmap annotation; unreadable ones have null."""
    return F.aggregate(bitmap_mask(data)["pixels"], F.lit(0).cast("long"), lambda a, v: a + F.when(v > 0, 1).otherwise(0))


# ---- grey images: arrays of h * w values ------------------------------------------------------


def entropy(p: np.ndarray) -> float:
    p = p[p > 0] / max(p.sum(), 1e-12)
    return float(-(p * np.log2(p)).sum())


def gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives with mirrored borders."""
    p = np.pad(g.astype(float), 1, mode="reflect" if min(g.shape) > 1 else "edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return dx, dy


def binary_patterns(g: np.ndarray) -> np.ndarray:
    """Uniform, rotation-invariant codes of the eight neighbours: 0 to 8 set bits, 9 for the rest."""
    p = np.pad(g.astype(float), 1, mode="edge")
    ring = [(0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0)]
    h, w = g.shape
    bits = np.stack([(p[a : a + h, b : b + w] >= g) for a, b in ring]).astype(int)
    changes = np.abs(np.diff(np.concatenate([bits, bits[:1]]), axis=0)).sum(axis=0)
    return np.where(changes <= 2, bits.sum(axis=0), 9)


def context_features(g: np.ndarray) -> dict[str, float]:
    """Variance, mean gradient, pattern entropy, share of high frequencies, entropy of directions."""
    dx, dy = gradients(g)
    mag = np.hypot(dx, dy)
    f = np.abs(np.fft.fftshift(np.fft.fft2(g.astype(float)))) ** 2
    h, w = g.shape
    yy, xx = np.ogrid[:h, :w]
    far = np.hypot(yy - h // 2, xx - w // 2) > min(h, w) / 8
    turn = np.histogram(np.arctan2(dy, dx), bins=18, range=(-np.pi, np.pi), weights=mag)[0]
    return {
        "local_variance": float(g.astype(float).var()),
        "edge_density": float(mag.mean()),
        "texture_entropy": entropy(np.bincount(binary_patterns(g).ravel(), minlength=10).astype(float)),
        "frequency_energy": float(f[far].sum() / max(f.sum(), 1e-12)),
        "orientation_consistency": entropy(turn) if turn.sum() > 0 else 0.0,
    }


def background_class(g: np.ndarray) -> str:
    """smooth, directional, periodic, organic or complex, the first rule that holds."""
    x = g.astype(float)
    if x.var() < 100:
        return "smooth"
    f = context_features(g)
    dx, dy = gradients(g)
    turn = np.histogram(np.mod(np.arctan2(dy, dx), np.pi), bins=18, range=(0, np.pi), weights=np.hypot(dx, dy))[0]
    if entropy(turn) < 1.0:
        return "directional"
    z = x - x.mean()
    ac = np.fft.ifft2(np.abs(np.fft.fft2(z)) ** 2).real
    ac /= max(ac[0, 0], 1e-12)
    h, w = g.shape
    near = np.zeros_like(ac, dtype=bool)
    for a in range(-4, 5):
        for b in range(-4, 5):
            near[a % h, b % w] = True
    if ac[~near].max(initial=0) > 0.15:
        return "periodic"
    return "organic" if f["texture_entropy"] > 2.5 else "complex"


def otsu(g: np.ndarray) -> int:
    """The grey level that separates two classes best."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w0 = np.cumsum(n)
    m = np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (m / w0 - (m[-1] - m) / w1) ** 2, -1.0)
    return int(between.argmax())


def labels(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Components of set pixels joined by sides or corners, numbered from 1 on in the order of their first pixel.

    Runs of a row are united with those of the row above they touch, so one pass does for any form."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # one behind the last
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    lab = np.zeros((h, w), dtype=int)
    numbers: dict[int, int] = {}
    for k in range(len(row)):
        lab[row[k], start[k] : end[k]] = numbers.setdefault(find(k), len(numbers) + 1)
    return lab, len(numbers)


def boxes(mask: np.ndarray, min_area: int = 100) -> list[tuple[int, int, int, int]]:
    """Boxes of the components of at least min_area pixels, else the whole image."""
    lab, n = labels(mask)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(lab == k)
        if len(y) >= min_area:
            out.append((int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)))
    return out or [(0, 0, mask.shape[1], mask.shape[0])]


def _hull_area(pts: np.ndarray) -> float:
    """Area of the convex hull of pixel squares, by the monotone chain."""
    corners = np.unique(np.concatenate([pts + o for o in ((0, 0), (0, 1), (1, 0), (1, 1))]), axis=0)
    if len(corners) < 3:
        return 0.0

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = np.array(half(corners.tolist())[:-1] + half(corners[::-1].tolist())[:-1], dtype=float)
    x, y = ring[:, 0], ring[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def region_props(mask: np.ndarray) -> dict[str, float] | None:
    """Shape measures of the largest component; none for an empty mask."""
    lab, n = labels(mask)
    if not n:
        return None
    k = int(np.bincount(lab.ravel())[1:].argmax()) + 1
    m = lab == k
    y, x = np.nonzero(m)
    area = len(y)
    c = np.cov(np.stack([x, y]).astype(float), bias=True) if area > 1 else np.zeros((2, 2))
    small, large = np.sort(np.linalg.eigvalsh(c + np.eye(2) / 12))
    w, h = x.max() - x.min() + 1, y.max() - y.min() + 1
    p = np.pad(m, 1)
    edge = int((m & ~p[:-2, 1:-1]).sum() + (m & ~p[2:, 1:-1]).sum() + (m & ~p[1:-1, :-2]).sum() + (m & ~p[1:-1, 2:]).sum())
    return {
        "linearity": float(1 - small / large),
        "solidity": float(min(1.0, area / max(_hull_area(np.stack([x, y], axis=1)), 1.0))),
        "extent": float(area / (w * h)),
        "aspect_ratio": float(np.sqrt(large / small)) if small > 1e-9 else 99.0,
        "eccentricity": float(np.sqrt(max(0.0, 1 - small / large))),
        "circularity": float(min(1.0, 4 * np.pi * area / edge**2)),
        "area": float(area),
    }


def laplacian(g: np.ndarray) -> np.ndarray:
    p = np.pad(g.astype(float), 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def background_quality(g: np.ndarray) -> float:
    """0.3 sharpness + 0.3 contrast + 0.2 brightness + 0.2 freedom from noise, each in the unit interval."""
    x = g.astype(float)
    sharp = min(1.0, laplacian(g).var() / 500)
    contrast = min(1.0, x.std() / 64)
    bright = 1 - abs(x.mean() - 128) / 128
    p = np.pad(x, 1, mode="edge")
    smooth = sum(p[a : a + g.shape[0], b : b + g.shape[1]] for a in range(3) for b in range(3)) / 9
    noise = 1 - min(1.0, np.abs(x - smooth).mean() / 20)
    return float(0.3 * sharp + 0.3 * contrast + 0.2 * bright + 0.2 * noise)


def resize(g: np.ndarray, size: int) -> np.ndarray:
    """To a square: averages of the covered pixels when shrinking, linear interpolation when growing."""
    h, w = g.shape
    if (h, w) == (size, size):
        return g

    def weights(n: int) -> np.ndarray:
        m = np.zeros((size, n))
        for i in range(size):
            if n > size:
                a, b = i * n / size, (i + 1) * n / size
                for j in range(int(a), min(n, int(np.ceil(b)))):
                    m[i, j] = min(b, j + 1) - max(a, j)
                m[i] /= m[i].sum()
            else:
                at = min(max((i + 0.5) * n / size - 0.5, 0), n - 1)
                j = int(at)
                m[i, j] += 1 - (at - j)
                m[i, min(j + 1, n - 1)] += at - j
        return m

    return np.clip(np.rint(weights(h) @ g.astype(float) @ weights(w).T), 0, 255).astype(np.uint8)


def quality_scores(g: np.ndarray, where: np.ndarray | None = None) -> dict[str, float]:
    """Freedom from pasting artefacts and sharpness, both in the unit interval, over the pixels ``where``."""
    mag, lap = np.hypot(*gradients(g)), laplacian(g)
    if where is not None and where.any():
        mag, lap = mag[where], lap[where]
    mean, std = mag.mean(), mag.std()
    if mean < 1e-6:
        artifact = 1.0
    else:
        edge = 1 - min(10 * (mag > mean + 3 * std).mean(), 1.0)
        artifact = 0.6 * edge + 0.4 * (1 - min(np.abs(lap).mean() / (mean + std + 1e-6) / 5, 1.0))
    p50, p90 = np.percentile(mag, [50, 90])
    contrast = 0.0 if p50 < 1e-6 else min(max((p90 / (p50 + 1e-6) - 1) / 9, 0.0), 1.0)
    return {"artifact": float(artifact), "sharpness": float(0.5 * min(lap.var() / 1000, 1.0) + 0.5 * contrast)}


def gram_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of the channel products of two patches (h, w, c); 0.5 where one of them vanishes."""
    x, y = (np.einsum("ijc,ijd->cd", p.astype(float), p.astype(float)) / (p.shape[0] * p.shape[1]) for p in (a, b))
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return float((x * y).sum() / n) if n > 1e-8 else 0.5


def mask_box(m: np.ndarray) -> dict[str, int] | None:
    """Bounding box of the set pixels, none for an empty mask."""
    y, x = np.nonzero(m)
    return {"x": int(x.min()), "y": int(y.min()), "w": int(x.max() - x.min() + 1), "h": int(y.max() - y.min() + 1)} if len(y) else None


def background_classes(t: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """``background_class`` of many images of one size (number, h, w), rule by rule over those left.

    Values nearer to a bound than rounding are looked at one by one, so no class depends on the others."""
    if len(t) > chunk:
        return np.concatenate([background_classes(t[i : i + chunk]) for i in range(0, len(t), chunk)])
    (n, h, w), kind, one = t.shape, np.full(len(t), "smooth", dtype=object), np.zeros(len(t), dtype=bool)
    if not n or not h or not w:
        return np.array([background_class(g) for g in t], dtype=object)

    def below(left: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
        one[left[np.abs(v - bound) < 1e-9 * max(1.0, bound)]] = True
        return v < bound

    def entropies(p: np.ndarray) -> np.ndarray:
        p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    def sums(at: np.ndarray, bins: int, weights: np.ndarray | None = None) -> np.ndarray:
        at = at.reshape(len(at), -1) + bins * np.arange(len(at))[:, None]
        return np.bincount(at.ravel(), None if weights is None else weights.ravel(), bins * len(at)).reshape(-1, bins).astype(float)

    left = np.arange(n)
    left = left[~below(left, t.reshape(n, -1).astype(float).var(axis=1), 100)]
    if not len(left):
        return kind
    p = np.pad(t[left].astype(float), ((0, 0), (1, 1), (1, 1)), mode="reflect" if min(h, w) > 1 else "edge")
    dx = (p[:, :-2, 2:] + 2 * p[:, 1:-1, 2:] + p[:, 2:, 2:]) - (p[:, :-2, :-2] + 2 * p[:, 1:-1, :-2] + p[:, 2:, :-2])
    dy = (p[:, 2:, :-2] + 2 * p[:, 2:, 1:-1] + p[:, 2:, 2:]) - (p[:, :-2, :-2] + 2 * p[:, :-2, 1:-1] + p[:, :-2, 2:])
    at = np.searchsorted(np.linspace(0, np.pi, 19)[1:-1], np.mod(np.arctan2(dy, dx), np.pi), side="right")
    straight = below(left, entropies(sums(at, 18, np.hypot(dx, dy))), 1.0)
    kind[left[straight]] = "directional"
    left = left[~straight]
    near = np.zeros((h, w), dtype=bool)
    near[np.ix_(np.arange(-4, 5) % h, np.arange(-4, 5) % w)] = True
    if not near.all():
        x = t[left].astype(float)
        ac = np.fft.ifft2(np.abs(np.fft.fft2(x - x.mean(axis=(1, 2), keepdims=True))) ** 2).real
        ac /= np.maximum(ac[:, :1, :1], 1e-12)
        again = ~below(left, ac[:, ~near].max(axis=1, initial=0), 0.15)
        kind[left[again]] = "periodic"
        left = left[~again]
    g = t[left]
    p = np.pad(g, ((0, 0), (1, 1), (1, 1)), mode="edge")
    bits = np.stack([p[:, a : a + h, b : b + w] >= g for a, b in [(0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0)]]).astype(np.int8)
    changes = (bits != np.roll(bits, -1, axis=0)).sum(axis=0)
    plain = below(left, entropies(sums(np.where(changes <= 2, bits.sum(axis=0), 9), 10)), 2.5)
    kind[left] = np.where(plain, "complex", "organic")
    for i in np.nonzero(one)[0]:
        kind[i] = background_class(t[i])
    return kind


def cell_classes(images: list[np.ndarray], size: int) -> list[list[str]]:
    """Background class of each whole cell of a grid over each image, row by row."""
    whole = lambda g: g[: g.shape[0] // size * size, : g.shape[1] // size * size]
    tiles = [(x := whole(g)).reshape(x.shape[0] // size, size, x.shape[1] // size, size).swapaxes(1, 2).reshape(-1, size, size) for g in images]
    found = background_classes(np.concatenate([np.zeros((0, size, size), dtype=np.uint8), *tiles])).tolist()
    ends = np.cumsum([0, *map(len, tiles)]).tolist()
    return [found[i:j] for i, j in zip(ends, ends[1:])]


def as_png(g: np.ndarray) -> bytes:
    """A grey image as a PNG file."""
    h, w = g.shape
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), g.astype(np.uint8)], axis=1).tobytes()
    part = lambda kind, x: len(x).to_bytes(4, "big") + kind + x + zlib.crc32(kind + x).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def netpbm(data: bytes | None) -> tuple[int, int, list[int]] | None:
    """(height, width, grey values) of a binary PGM or PPM file of 8 bits; none for anything else."""
    gap = rb"(?:\s|#[^\n]*\n)+"
    m = re.match(rb"(P[56])" + gap + rb"(\d{1,6})" + gap + rb"(\d{1,6})" + gap + rb"255\s", data or b"")
    if not m:
        return None
    w, h, c = int(m[2]), int(m[3]), 1 if m[1] == b"P5" else 3
    if len(data) < m.end() + h * w * c:
        return None
    px = np.frombuffer(data, dtype=np.uint8, offset=m.end(), count=h * w * c).reshape(h, w, c)
    return h, w, np.rint(px.mean(axis=2)).astype(int).ravel().tolist()


def png(data: bytes | None) -> tuple[int, int, list[int]] | None:
    """(height, width, grey values) of a PNG file of 8 bits a channel without interlacing; none for anything else.

    Transparency is left out; colours become the mean of their channels, as for other files."""
    if not data or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, body, palette = 8, None, [], None
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        if len(chunk) < n:
            return None
        head = chunk if kind == b"IHDR" else head
        palette = np.frombuffer(chunk[: n - n % 3], dtype=np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        body += [chunk] if kind == b"IDAT" else []
        at += n + 12
    if head is None or len(head) < 13:
        return None
    w, h, depth, colour, _, _, laced = (int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), *head[8:13])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or laced or channels is None or not w or not h or colour == 3 and palette is None:
        return None
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error:
        return None
    line = w * channels
    if len(raw) < h * (line + 1):
        return None
    rows = np.frombuffer(raw, dtype=np.uint8, count=h * (line + 1)).reshape(h, line + 1)
    out, above = np.zeros((h, line), dtype=np.uint8), np.zeros(line, dtype=np.uint8)
    for y in range(h):
        out[y] = above = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, channels)
    px = out.reshape(h, w, channels)
    if colour == 3:
        if px.max() >= len(palette):
            return None
        px = palette[px[:, :, 0]]
    elif colour in (4, 6):
        px = px[:, :, :-1]
    return h, w, np.rint(px.astype(float).mean(axis=2)).astype(int).ravel().tolist()


def _unfiltered(kind: int, x: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes of which each is stored less a guess from its neighbours."""
    if kind == 0:
        return x
    if kind == 2:
        return x + above
    if kind == 1:
        return np.add.accumulate(x.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out, up = x.astype(int).tolist(), above.astype(int).tolist()
    for i in range(len(out)):
        left, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            guess = (left + b) // 2
        else:
            pa, pb, pc = abs(b - c), abs(left - c), abs(left + b - 2 * c)
            guess = left if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (out[i] + guess) % 256
    return np.array(out, dtype=np.uint8)


def read_images(files: DataFrame) -> DataFrame:
    """(path, h, w, pixels) of (path, content) rows: PNG, PGM and PPM; files that can't be read have nulls, not errors."""

    def run(batches):
        for b in batches:
            rows = [(p, *(png(c) or netpbm(c) or (None, None, None))) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["path", "h", "w", "pixels"]).astype({"h": "Int32", "w": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, h int, w int, pixels array<int>")


# ---- arrays without a kernel: plain expressions -------------------------------------------------


def tile_origins(length: Column, size: int, stride: int) -> Column:
    """Starts of tiles along a side: every stride, the last one moved in to end at the border."""
    last = F.greatest(F.lit(0), length - size).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def crop(pixels: Column, width: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The rows of a box, cut out of an array of pixels."""
    rows = F.transform(F.sequence(y, y + h - 1), lambda r: F.slice(pixels, (r * width + x + 1).cast("int"), w))
    return F.flatten(rows)


def composite(front: Column, back: Column, alpha: Column) -> Column:
    """front over back with an opacity for each pixel, rounded."""
    both = F.zip_with(front, back, lambda f, b: F.struct(f.alias("f"), b.alias("b")))
    return F.zip_with(both, alpha, lambda p, a: F.round(p["f"] * a + p["b"] * (1 - a)).cast("int"))


_FEATURES = "local_variance double, edge_density double, texture_entropy double, frequency_energy double, orientation_consistency double"
_PROPS = "linearity double, solidity double, extent double, aspect_ratio double, eccentricity double, circularity double, area double"


def map_images(df: DataFrame, key: str, kernel: str) -> DataFrame:
    """Apply a named kernel to rows (key, h, w, pixels); images without pixels or of another size have null results."""
    plans = {
        "context": (_FEATURES, context_features),
        "props": (_PROPS, lambda g: region_props(g > 0)),
        "background": ("background string", lambda g: {"background": background_class(g)}),
        "quality": ("quality double", lambda g: {"quality": background_quality(g)}),
        "otsu": ("threshold int, mask array<int>", lambda g: {"threshold": otsu(g), "mask": (g > otsu(g)).astype(int).ravel()}),
        "boxes": ("boxes array<array<int>>", lambda g: {"boxes": [list(b) for b in boxes(g > otsu(g), 20)]}),
        "scores": ("artifact double, sharpness double", quality_scores),
        "gram": ("gram double", lambda g: {"gram": gram_similarity(*np.split(g.reshape(g.shape[0], -1, 2), 2))}),
        "mask_box": ("x int, y int, w int, h int", lambda g: mask_box(g > 150)),
        "grid": ("cells array<string>", lambda gs: [{"cells": c} for c in cell_classes(gs, 8)], True),
        "seed_mask": ("mask array<int>", lambda g: {"mask": (g <= otsu(g)).astype(int).ravel()}),
        "roi_meta": ("rois array<array<int>>, background string", lambda g: {"rois": [list(b) for b in boxes(g > otsu(g), 20)], "background": background_class(g)}),
        "half": ("side int, small array<int>", lambda g: (lambda r: {"side": r.shape[0], "small": r.astype(int).ravel()})(resize(g, max(1, min(g.shape) // 2)))),
    }
    return map_arrays(df, key, *plans[kernel])


def map_arrays(df: DataFrame, key: str, schema: str, f: Callable[[np.ndarray], dict | None] | Callable[[list[np.ndarray]], list[dict | None]], many: bool = False) -> DataFrame:
    """(key, schema): f of the grey image of each row (key, h, w, pixels), null where it has none or is no image.

    many: f takes the list of the images of a batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            ok = [px is not None and h and w and len(px) == h * w for _, h, w, px in b.itertuples(index=False)]
            images = (np.asarray(px, dtype=np.uint8).reshape(int(h), int(w)) for o, (_, h, w, px) in zip(ok, b.itertuples(index=False)) if o)
            got = iter(f(list(images)) if many else map(f, images))
            found = [next(got) if o else None for o in ok]
            yield pd.DataFrame([(k, *[r[n] if r else None for n in names]) for k, r in zip(b.iloc[:, 0], found)], columns=[key, *names])

    if len({key, *names}) < len(names) + 1:
        raise ValueError("the key has the name of a result")
    return df.select(key, "h", "w", "pixels").mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")


def explode_patches(df: DataFrame, size: int = 64) -> DataFrame:
    """The top left corners of a grid of whole patches of each image (key columns, h, w), the rest cut off."""
    grid = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.col(n) / size).cast("int")), lambda i: i * size)
    x = df.withColumn("px", F.explode(grid("w"))).withColumn("py", F.explode(grid("h")))
    return x.where((F.col("px") + size <= F.col("w")) & (F.col("py") + size <= F.col("h")))
