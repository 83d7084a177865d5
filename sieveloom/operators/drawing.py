"""Pasting, blending and warping of small images, and what decides where: NumPy kernels over one array each."""

from __future__ import annotations

import numpy as np

from sieveloom.operators.kernels import background_quality, gradients, labels, laplacian, otsu

# ---- filters ----------------------------------------------------------------------------------


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Indices beyond the borders come back from the pixel next to the border on."""
    if n == 1:
        return np.zeros_like(i)
    i = np.mod(i, 2 * (n - 1))
    return np.where(i >= n, 2 * (n - 1) - i, i)


def along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r, n = len(kernel) // 2, x.shape[axis]
    return sum(w * np.take(x, mirrored(np.arange(n) + k - r, n), axis=axis) for k, w in enumerate(kernel))


def gaussian(x: np.ndarray, size: int) -> np.ndarray:
    """A blur of odd size; its width follows from the size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    return along(along(x.astype(float), k, 0), k, 1)


def dilated(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Grown by its eight neighbours, so many times."""
    for _ in range(times):
        p = np.pad(mask.astype(bool), 1)
        mask = np.any([p[a : a + mask.shape[0], b : b + mask.shape[1]] for a in range(3) for b in range(3)], axis=0)
    return mask.astype(bool)


def sample(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at fractional places, linear between pixels, mirrored beyond the borders."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    at = lambda i, j: g[mirrored(i, g.shape[0]), mirrored(j, g.shape[1])].astype(float)
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


# ---- variants ---------------------------------------------------------------------------------

#: Subtype: which displacement fields there are (x, y, or one for both), their reach as a share of a side, the side,
#: and the least reach in pixels; fixed values. What is of no subtype here is general, which may also be mirrored and turned.
WARPS = {
    "linear_scratch": ("y", 0.15, "short", 1.0),
    "elongated": ("x", 0.2, "width", 1.0),
    "compact_blob": ("one", 0.18, "short", 1.0),
    "irregular": ("xy", 0.35, "short", 2.0),
    "general": ("xy", 0.25, "short", 1.5),
}
BRIGHTNESS = 0.85, 1.15
TURN = 15.0


def variant(g: np.ndarray, seed: int, subtype: str = "general") -> np.ndarray:
    """A warped copy with another brightness, the same for the same seed."""
    rng, (h, w) = np.random.default_rng(seed), g.shape
    kind = subtype if subtype in WARPS else "general"
    fields, share, side, least = WARPS[kind]
    reach, size = max(least, share * (w if side == "width" else min(h, w))), max(3, (min(h, w) // 4) | 1)
    field = lambda: gaussian(rng.uniform(-reach, reach, (h, w)), size)
    y, x = np.mgrid[:h, :w].astype(float)
    dx = field() if "x" in fields or fields == "one" else 0.0
    dy = dx if fields == "one" else field() if "y" in fields else 0.0
    out = np.rint(sample(g, x + dx, y + dy))
    if kind == "general":
        if rng.random() < 0.5:
            out = out[:, ::-1]
        t = np.deg2rad(rng.uniform(-TURN, TURN))
        cx, cy = w / 2, h / 2
        out = np.rint(sample(out, cx + (x - cx) * np.cos(t) - (y - cy) * np.sin(t), cy + (x - cx) * np.sin(t) + (y - cy) * np.cos(t)))
    return np.clip(out * rng.uniform(*BRIGHTNESS), 0, 255).astype(np.uint8)


# ---- pasting ----------------------------------------------------------------------------------


def shrunk(p: np.ndarray, h: int, w: int) -> np.ndarray:
    y, x = (np.arange(h) + 0.5) * p.shape[0] / h - 0.5, (np.arange(w) + 0.5) * p.shape[1] / w - 0.5
    return np.rint(sample(p, *np.meshgrid(np.clip(x, 0, p.shape[1] - 1), np.clip(y, 0, p.shape[0] - 1)))).astype(np.uint8)


def spot(back: tuple[int, int], front: np.ndarray, x: int, y: int) -> tuple[np.ndarray, int, int]:
    """The patch, shrunk to nine tenths of the largest that fits if it is larger than the background, and its top
    left corner, moved so that it lies within."""
    h, w = back
    if front.shape[0] > h or front.shape[1] > w:
        s = min(w / front.shape[1], h / front.shape[0]) * 0.9
        front = shrunk(front, max(1, int(front.shape[0] * s)), max(1, int(front.shape[1] * s)))
    ph, pw = front.shape
    cx, cy = max(pw // 2 + 1, min(w - pw // 2 - 1, x + pw // 2)), max(ph // 2 + 1, min(h - ph // 2 - 1, y + ph // 2))
    return front, max(0, min(h - ph, cy - ph // 2)), max(0, min(w - pw, cx - pw // 2))


def paste(back: np.ndarray, front: np.ndarray, x: int, y: int, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(image, mask) with the patch over the background; without an opacity a patch covers what is below."""
    p, top, left = spot(back.shape, front, x, y)
    out, mask = back.copy(), np.zeros(back.shape, dtype=np.uint8)
    at = np.s_[top : top + p.shape[0], left : left + p.shape[1]]
    a = np.ones(p.shape) if alpha is None or alpha.shape != p.shape else alpha
    out[at] = np.clip(p * a + back[at] * (1 - a), 0, 255).astype(np.uint8)
    mask[at] = np.where(a > 0, 255, 0)
    return out, mask


def blend(back: np.ndarray, front: np.ndarray, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    """(image, mask) with the patch's structure in the background's light: within the patch the result has the
    patch's Laplacian and, around it, the background's values (a Poisson equation, solved by sine transforms)."""
    p, top, left = spot(back.shape, front, x, y)
    h, w = p.shape
    mask = np.zeros(back.shape, dtype=np.uint8)
    mask[top : top + h, left : left + w] = 255
    rim = np.pad(back.astype(float), 1, mode="edge")[top : top + h + 2, left : left + w + 2]
    want = laplacian(p)
    want[0] -= rim[0, 1:-1]
    want[-1] -= rim[-1, 1:-1]
    want[:, 0] -= rim[1:-1, 0]
    want[:, -1] -= rim[1:-1, -1]

    def sines(n: int) -> np.ndarray:
        k = np.arange(1, n + 1)
        return np.sin(np.pi * np.outer(k, k) / (n + 1)) * np.sqrt(2 / (n + 1))

    a, b = sines(h), sines(w)
    wave = lambda n: 2 * np.cos(np.pi * np.arange(1, n + 1) / (n + 1)) - 2
    out = back.copy()
    out[top : top + h, left : left + w] = np.clip(np.rint(a @ ((a @ want @ b) / (wave(h)[:, None] + wave(w)[None, :])) @ b), 0, 255).astype(np.uint8)
    return out, mask


def in_its_light(front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The patch with the mean and the spread of what it is put on; a patch without spread only takes the mean."""
    f, b = front.astype(float), back.astype(float)
    s = b.std() / f.std() if f.std() > 1e-6 else 1.0
    return np.clip(np.rint((f - f.mean()) * s + b.mean()), 0, 255).astype(np.uint8)


def yolo(mask: np.ndarray) -> list[float] | None:
    """Centre and size of the set pixels' box as shares of the image; none for an empty mask."""
    y, x = np.nonzero(mask)
    if not len(y):
        return None
    h, w = mask.shape
    x0, x1, y0, y1 = x.min(), x.max() + 1, y.min(), y.max() + 1
    return [float((x0 + x1) / 2 / w), float((y0 + y1) / 2 / h), float((x1 - x0) / w), float((y1 - y0) / h)]


# ---- where ------------------------------------------------------------------------------------

#: A foreground of less or more of the frame is none, and a flat one of poor quality is a void; fixed values.
FOREGROUND = 0.02, 0.90
VOID_SPREAD, VOID_QUALITY = 5.0, 0.5


def foreground(g: np.ndarray) -> np.ndarray | None:
    """The object of an image: of two grey classes the one that has fewer of the corners (the dark one in a tie),
    its largest component; none if that is next to nothing, nearly all, or a void."""
    if min(g.shape) < 2:
        return None
    bright = g > otsu(g)
    corners = int(bright[0, 0]) + int(bright[0, -1]) + int(bright[-1, 0]) + int(bright[-1, -1])
    lab, n = labels(~bright if corners >= 2 else bright)
    if not n:
        return None
    mask = lab == int(np.bincount(lab.ravel(), minlength=n + 1)[1:].argmax()) + 1
    if not FOREGROUND[0] <= mask.mean() <= FOREGROUND[1]:
        return None
    if g[mask].astype(float).std() < VOID_SPREAD:
        y, x = np.nonzero(mask)
        if background_quality(g[y.min() : y.max() + 1, x.min() : x.max() + 1]) < VOID_QUALITY:
            return None
    return mask


def place_on(mask: np.ndarray, crop: np.ndarray, rng: np.random.Generator, tries: int = 20) -> tuple[int, int] | None:
    """A corner (x, y) for a crop such that the centre of its set pixels lies on the mask; none after so many tries."""
    (h, w), (ch, cw) = mask.shape, crop.shape
    if ch > h or cw > w:
        return None
    y, x = np.nonzero(crop >= 128)
    cx, cy = (x.mean(), y.mean()) if len(x) else (cw / 2, ch / 2)
    for _ in range(max(1, tries)):
        px, py = int(rng.integers(0, w - cw + 1)), int(rng.integers(0, h - ch + 1))
        i, j = int(round(py + cy)), int(round(px + cx))
        if i < h and j < w and mask[i, j]:
            return px, py
    return None


def scan_place(fit: np.ndarray, void: np.ndarray, size: tuple[int, int], crop: tuple[int, int], tile: int = 64, stride: int = 32, top: int = 8, most: int = 4096) -> tuple[list[tuple[int, int]], float, int]:
    """(best corners, best mean, number without void): the places for a crop on a grid of tiles.

    fit, void: a value and a flag for each tile. Corners lie a stride apart and at the far ends, farther
    apart where there would be more than ``most``. A place has the mean fit of the tiles it touches; those
    that touch a void tile don't count, unless all do: then there is no corner, and the best mean is that
    of all. Best come first, equal ones in scanning order.
    """
    (h, w), (ch, cw) = size, crop

    def axis(span: int, step: int) -> np.ndarray:
        return np.unique(np.r_[np.arange(0, max(span, 0) + 1, step), max(span, 0)])

    while len(ys := axis(h - ch, stride)) * len(xs := axis(w - cw, stride)) > most:
        stride *= 2
    total = lambda m: np.pad(np.cumsum(np.cumsum(m.astype(float), axis=0), axis=1), ((1, 0), (1, 0)))
    ends = lambda at, n, tiles: (np.minimum(at // tile, tiles - 1), np.minimum((at + n - 1) // tile, tiles - 1) + 1)
    (y0, y1), (x0, x1) = ends(ys, ch, fit.shape[0]), ends(xs, cw, fit.shape[1])
    area = lambda s: s[np.ix_(y1, x1)] - s[np.ix_(y0, x1)] - s[np.ix_(y1, x0)] + s[np.ix_(y0, x0)]
    mean = np.round(area(total(fit)) / np.outer(y1 - y0, x1 - x0), 12)
    free = area(total(void)) < 0.5
    if not free.any():
        return [], float(mean.max()), 0
    order = [k for k in np.argsort(-mean.ravel(), kind="stable") if free.ravel()[k]]
    corners = [(int(xs[k % len(xs)]), int(ys[k // len(xs)])) for k in order[:top]]
    return corners, float(mean.ravel()[order[0]]), int(free.sum())


# ---- texture, hints, boxes --------------------------------------------------------------------


def texture(g: np.ndarray, where: np.ndarray | None = None, least: int = 64) -> list[float] | None:
    """Contrast, sharpness, periodicity and direction, each in the unit interval, of a patch freed of its slope;
    none for a flat patch or fewer than ``least`` pixels."""
    h, w = g.shape
    where = np.ones(g.shape, dtype=bool) if where is None else where.astype(bool)
    if where.sum() < least:
        return None
    y, x = np.mgrid[:h, :w]
    plane = np.stack([x.ravel(), y.ravel(), np.ones(h * w)], axis=1)
    z = g.astype(float) - (plane @ np.linalg.lstsq(plane, g.ravel().astype(float), rcond=None)[0]).reshape(h, w)
    if z.std() < 1.0:
        return None
    ac = np.fft.ifft2(np.abs(np.fft.fft2(z - z.mean())) ** 2).real
    if ac[0, 0] <= 1e-6:
        return None
    r = max(2, min(h, w) // 8)
    far = np.ones((h, w), dtype=bool)
    for a in (np.s_[:r], np.s_[-r:]):
        for b in (np.s_[:r], np.s_[-r:]):
            far[a, b] = False
    dx, dy = gradients(z)
    turn = np.histogram(np.mod(np.arctan2(dy, dx), np.pi)[where], bins=8, range=(0, np.pi), weights=np.hypot(dx, dy)[where])[0]
    p = turn / turn.sum() if turn.sum() > 1e-6 else np.full(8, 1 / 8)
    even = float(-(p * np.log(p + 1e-12)).sum() / np.log(8))
    return [min(float(z[where].std()) / 128, 1.0), float(np.tanh(laplacian(z)[where].var() / 500)), float(np.clip((ac / ac[0, 0])[far].max(initial=0), 0, 1)), 1 - min(max(even, 0.0), 1.0)]


def thinned(mask: np.ndarray) -> np.ndarray:
    """The skeleton: border pixels go in turns from two sides while the rest stays connected."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        before = m.copy()
        for side in (0, 1):
            n = [np.roll(m, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # clockwise from above
            count = sum(a.astype(int) for a in n)
            turns = sum((~a & b).astype(int) for a, b in zip(n, [*n[1:], n[0]]))
            a, b = ((0, 2, 4), (2, 4, 6)) if side == 0 else ((0, 2, 6), (0, 4, 6))
            gone = m & (count >= 2) & (count <= 6) & (turns == 1) & ~(n[a[0]] & n[a[1]] & n[a[2]]) & ~(n[b[0]] & n[b[1]] & n[b[2]])
            m = m & ~gone
        if (m == before).all():
            return m[1:-1, 1:-1]


def stretched(x: np.ndarray) -> np.ndarray:
    span = x.max() - x.min()
    return (x - x.min()) / span * 255 if span > 0 else np.zeros_like(x)


def hint(g: np.ndarray, mask: np.ndarray, linearity: float, solidity: float, background: str, stability: float) -> np.ndarray:
    """A grey image of half the defect's form, three tenths the background's edges and two tenths its fine texture.

    The form is the skeleton of a linear mask, the whole of a solid one, else the mask with its outline. Edges
    count along the background's direction; white noise of texture is the variance of seven by seven pixels."""
    form = np.zeros(g.shape)
    if mask.any():
        if linearity > 0.7:
            form[dilated(thinned(mask))] = 255
        elif solidity > 0.8:
            form[mask] = 200
        else:
            form[mask] = 100
            form[dilated(mask & dilated(~mask))] = 255
    dx, dy = gradients(g)
    across = {"vertical_stripe": np.abs(dx), "directional": np.abs(dx), "horizontal_stripe": np.abs(dy)}
    edges = across.get(background, np.hypot(dx, dy) * (1.0 if background in ("complex_pattern", "periodic") else 0.3))
    edges = np.floor(stretched(edges) * (0.5 + 0.5 * stability))
    if background == "smooth":
        fine = np.full(g.shape, 20.0)
    else:
        k, x = np.full(7, 1 / 7), g.astype(float)
        mean = along(along(x, k, 0), k, 1)
        fine = np.floor(stretched(np.maximum(along(along(x * x, k, 0), k, 1) - mean**2, 0)))
        if background in ("textured", "complex_pattern", "periodic"):
            fine = np.floor(np.clip(fine * 1.2, 0, 255))
    return np.clip(0.5 * form + 0.3 * edges + 0.2 * fine, 0, 255).astype(np.uint8)


def component_boxes(mask: np.ndarray, least: int, whole: bool = False) -> list[list[int]]:
    """Boxes (x, y, w, h) of the components whose box has ``least`` pixels; whole: else the box of all set pixels."""
    lab, n = labels(mask)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(lab == k)
        out.append([int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)])
    kept = [b for b in out if b[2] * b[3] >= least]
    if not kept and whole and mask.any():
        y, x = np.nonzero(mask)
        kept = [[int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)]]
    return kept


def changed_boxes(image: np.ndarray, back: np.ndarray, least: int = 200, floor: int = 8) -> list[list[int]]:
    """Boxes of what differs from the background: the blurred difference above a low floor, or above the level that
    divides it best where nothing is, grown by three pixels."""
    d = np.rint(gaussian(np.abs(image.astype(int) - back.astype(int)), 5)).astype(np.uint8)
    mask = d > floor
    if not mask.any():
        mask = d > otsu(d)
    return component_boxes(dilated(mask, 3), least)
