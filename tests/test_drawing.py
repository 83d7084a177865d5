import zlib

import numpy as np
import pytest

from sieveloom.operators import drawing as D
from sieveloom.operators import kernels as K


def noise(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)


def test_components_match_a_search():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (1, 9), (7, 1), (9, 12), (20, 17)):
        for share in (0.0, 0.3, 0.5, 1.0):
            m = rng.random((h, w)) < share
            want, n = np.zeros((h, w), int), 0
            for y in range(h):
                for x in range(w):
                    if m[y, x] and not want[y, x]:
                        n, todo = n + 1, [(y, x)]
                        want[y, x] = n
                        while todo:
                            a, b = todo.pop()
                            for i in range(max(0, a - 1), min(h, a + 2)):
                                for j in range(max(0, b - 1), min(w, b + 2)):
                                    if m[i, j] and not want[i, j]:
                                        want[i, j] = n
                                        todo.append((i, j))
            lab, k = K.labels(m)
            assert k == n and (lab == want).all()
    path = np.zeros((40, 41), bool)  # one winding component
    path[::2] = True
    path[1::4, -1] = path[3::4, 0] = True
    assert K.labels(path)[1] == 1


def chunk(kind, data):
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def as_png(px, colour, palette=b""):
    """All five row filters in turn."""
    h, w, c = px.shape
    rows, above = b"", np.zeros(w * c, int)
    for y in range(h):
        x = px[y].reshape(-1).astype(int)
        left, corner = np.r_[np.zeros(c, int), x[:-c]], np.r_[np.zeros(c, int), above[:-c]]
        pa, pb, pc = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][y % 5]
        rows += bytes([y % 5]) + ((x - guess) % 256).astype(np.uint8).tobytes()
        above = x
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])
    body = zlib.compress(rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


def test_png_files(spark):
    rng = np.random.default_rng(2)
    for colour, c in ((0, 1), (2, 3), (4, 2), (6, 4)):
        px = rng.integers(0, 256, (11, 6, c)).astype(np.uint8)
        shown = px[:, :, : {1: 1, 3: 3, 2: 1, 4: 3}[c]]
        assert K.png(as_png(px, colour)) == (11, 6, np.rint(shown.astype(float).mean(axis=2)).astype(int).ravel().tolist())
    colours = np.array([[0, 30, 60], [9, 9, 9]], np.uint8)
    which = rng.integers(0, 2, (7, 5, 1)).astype(np.uint8)
    whole = as_png(which, 3, colours.tobytes())
    assert K.png(whole)[2] == np.array([30, 9])[which].ravel().tolist()
    bad = [None, b"", b"\x89PNG\r\n\x1a\n", whole[:60], whole[:40] + b"x" * 40, as_png(which, 3)]
    files = spark.createDataFrame([(str(i), b) for i, b in enumerate([whole, *bad])], "path string, content binary")
    got = {r["path"]: (r["h"], r["w"]) for r in K.read_images(files).collect()}
    assert got == {"0": (7, 5)} | {str(i + 1): (None, None) for i in range(len(bad))}


def test_patches_stay_within_the_image():
    back = noise(20, 30)
    for x, y in ((0, 0), (-9, 50), (29, 19), (7, 3)):
        for h, w in ((4, 6), (20, 30), (50, 10), (1, 1), (19, 29)):
            out, mask = D.paste(back, noise(h, w, 1), x, y)
            b = D.blend(back, noise(h, w, 1), x, y)
            assert out.shape == back.shape == mask.shape and (out[mask == 0] == back[mask == 0]).all() and mask.any()
            assert (b[1] == mask).all() and (b[0][mask == 0] == back[mask == 0]).all()
    assert (D.paste(back, noise(4, 6, 1), 7, 3)[0][3:7, 7:13] == noise(4, 6, 1)).all()
    half = D.paste(back, noise(4, 6, 1), 7, 3, np.full((4, 6), 0.5))[0]
    assert (half[3:7, 7:13] == (noise(4, 6, 1) * 0.5 + back[3:7, 7:13] * 0.5).astype(np.uint8)).all()


def test_blending_keeps_structure_and_takes_the_light():
    back = np.full((24, 24), 90, np.uint8)
    front = np.full((10, 10), 200, np.uint8)
    assert (D.blend(back, front, 5, 5)[0] == 90).all()  # a patch without structure vanishes
    y, x = np.mgrid[:24, :24]
    ramp = (60 + 3 * x + 2 * y).astype(np.uint8)
    assert np.abs(D.blend(ramp, ramp[5:15, 5:15] // 1 + 40, 5, 5)[0].astype(int) - ramp).max() <= 40 * 0.6
    front[4:6, 4:6] = 120
    out = D.blend(back, front, 5, 5)[0]
    assert out[9:11, 9:11].mean() < 60 < 80 < out[5:15, 5:15].max()
    lit = D.in_its_light(noise(8, 8), np.array([[100, 120], [110, 130]], np.uint8))
    assert abs(lit.mean() - 115) < 1 and abs(lit.std() - 11.18) < 1


def test_variants():
    g = noise(32, 32)
    for k in [*D.WARPS, "no such subtype"]:
        a, b, c = D.variant(g, 3, k), D.variant(g, 3, k), D.variant(g, 4, k)
        assert a.shape == g.shape and a.dtype == np.uint8 and (a == b).all() and (a != c).any()
    rows = np.tile(np.arange(0, 160, 10, dtype=np.uint8)[:, None], (1, 16))
    assert (np.ptp(D.variant(rows, 1, "elongated"), axis=1) == 0).all()  # moved along the rows only
    assert D.variant(np.full((1, 1), 100, np.uint8), 0).shape == (1, 1)


def test_foreground_and_places_on_it():
    g = np.full((40, 40), 30, np.uint8)
    g[10:30, 12:28] = noise(20, 16) // 2 + 120
    m = D.foreground(g)
    assert m is not None and m[12:28, 14:26].mean() > 0.9 and not m[:8].any()
    assert D.foreground(255 - g)[12:28, 14:26].mean() > 0.9
    assert D.foreground(np.full((9, 9), 7, np.uint8)) is None and D.foreground(np.zeros((1, 5), np.uint8)) is None
    flat = np.full((40, 40), 200, np.uint8)
    flat[5:35, 5:35] = 10
    assert D.foreground(flat) is None  # a void, not an object
    crop = np.zeros((6, 6), np.uint8)
    crop[2:4, 2:4] = 255
    rng = np.random.default_rng(1)
    for _ in range(20):
        at = D.place_on(m, crop, rng)
        assert at is None or m[round(at[1] + 2.5), round(at[0] + 2.5)]
    assert D.place_on(m, np.zeros((50, 5), np.uint8), rng) is None and D.place_on(np.zeros((9, 9), bool), crop, rng) is None


@pytest.mark.parametrize("most", [4096, 9])
def test_scanned_places_match_brute_force(most):
    rng = np.random.default_rng(7)
    fit, void = rng.random((5, 6)), rng.random((5, 6)) < 0.2
    h, w, ch, cw, tile, stride = 40, 48, 9, 13, 8, 4
    corners, best, n = D.scan_place(fit, void, (h, w), (ch, cw), tile, stride, 8, most)
    while True:
        ys, xs = sorted({*range(0, h - ch + 1, stride), h - ch}), sorted({*range(0, w - cw + 1, stride), w - cw})
        if len(ys) * len(xs) <= most:
            break
        stride *= 2
    want = []
    for y in ys:
        for x in xs:
            at = np.s_[y // tile : (y + ch - 1) // tile + 1, x // tile : (x + cw - 1) // tile + 1]
            if not void[at].any():
                want.append((-round(fit[at].mean(), 12), y, x))
    want.sort()
    assert n == len(want) and corners == [(x, y) for _, y, x in want[:8]] and best == pytest.approx(-want[0][0])
    none = D.scan_place(fit, np.ones((5, 6), bool), (h, w), (ch, cw), tile, stride)
    assert none[0] == [] and none[2] == 0 and none[1] > 0


def test_texture_tells_patterns_apart():
    stripes = np.tile((np.arange(32) // 4 % 2 * 150 + 50).astype(np.uint8), (32, 1))
    a, b = D.texture(stripes), D.texture(noise(32, 32))
    assert all(0 <= v <= 1 for v in a + b) and a[2] > 0.8 > 0.4 > b[2] and a[3] > 0.6 > 0.3 > b[3]
    y, x = np.mgrid[:32, :32]
    assert D.texture((3 * x + 2 * y).astype(np.uint8)) is None and D.texture(noise(4, 4)) is None


def test_hints_and_skeletons():
    bar = np.zeros((20, 20), bool)
    bar[8:13, 3:17] = True
    thin = D.thinned(bar)
    assert thin.any() and (thin & ~bar).sum() == 0 and K.labels(thin)[1] == 1 and thin.sum() < 16
    g = np.full((20, 20), 100, np.uint8)
    assert set(np.unique(D.hint(g, bar, 0.5, 0.9, "smooth", 1.0))) == {4, 104}
    assert (D.hint(g, bar, 0.9, 0.9, "smooth", 1.0) >= 127).sum() == D.dilated(thin).sum()
    assert (D.hint(g, np.zeros_like(bar), 0.5, 0.5, "smooth", 1.0) == 4).all()
    assert D.hint(noise(20, 20), bar, 0.2, 0.2, "periodic", 0.5).shape == (20, 20)


def test_boxes_of_changes_and_masks():
    back = noise(60, 60)
    out, mask = D.paste(back, 255 - back[20:35, 10:30], 10, 20)
    (x, y, w, h), = D.changed_boxes(out, back, 100)
    assert x <= 10 and y <= 20 and x + w >= 30 and y + h >= 35 and w < 40 and h < 35
    assert D.changed_boxes(back, back) == []
    assert D.component_boxes(mask > 0, 50) == [[10, 20, 20, 15]]
    dots = np.zeros((9, 9), bool)
    dots[1, 1] = dots[7, 5] = True
    assert D.component_boxes(dots, 50) == [] and D.component_boxes(dots, 50, whole=True) == [[1, 1, 5, 7]]
    assert D.yolo(mask) == [1 / 3, 27.5 / 60, 1 / 3, 0.25] and D.yolo(mask * 0) is None
