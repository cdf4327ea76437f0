"""Raster kernels on drawn scenes."""

import numpy as np
import pytest

from chartstone.operators import kernels as K


def ring(size=64, r=20, stroke=2, c=None):
    cy, cx = c or (size // 2, size // 2)
    yy, xx = np.mgrid[:size, :size]
    d = np.hypot(yy - cy, xx - cx)
    return (d >= r - stroke / 2) & (d <= r + stroke / 2)


def test_square_properties():
    m = np.zeros((20, 20), bool)
    m[5:15, 5:15] = True
    (g,) = K.region_table(*K.label(m))
    assert (g["area"], g["solidity"], g["euler"], g["extent"]) == (100, 1.0, 1, 1.0)
    assert (g["y0"], g["x0"], g["y1"], g["x1"], g["cy"], g["cx"]) == (5, 5, 15, 15, 9.5, 9.5)
    assert g["eccentricity"] == 0 and g["perimeter"] == 36


def test_ring_has_a_hole():
    (g,) = K.region_table(*K.label(ring()))
    assert g["euler"] == 0 and g["eccentricity"] < 0.05 and g["solidity"] < 0.3


def test_corners_connect():
    m = np.zeros((6, 6), bool)
    m[0:2, 0:2] = m[2:4, 2:4] = True
    labels, n = K.label(m)
    assert n == 1 and K.euler_of(m) == 1
    m[0, 5] = True
    assert K.label(m)[1] == 2


def test_label_equals_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(20):
        m = rng.random((25, 30)) < 0.4
        labels, n = K.label(m)
        seen, want = np.zeros(m.shape, int), 0
        for y, x in zip(*np.nonzero(m)):
            if not seen[y, x]:
                want += 1
                stack = [(y, x)]
                seen[y, x] = want
                while stack:
                    a, b = stack.pop()
                    for c in range(max(0, a - 1), min(25, a + 2)):
                        for d in range(max(0, b - 1), min(30, b + 2)):
                            if m[c, d] and not seen[c, d]:
                                seen[c, d] = want
                                stack.append((c, d))
        assert n == want and (labels == seen).all()


def test_sauvola_finds_ink_on_uneven_paper():
    paper = np.tile(np.linspace(0.5, 1.0, 100), (100, 1))
    paper[40:44, 20:80] *= 0.3
    ink = K.sauvola(paper)
    assert ink[41:43, 25:75].all() and not ink[:25].any()


def test_otsu_and_denoise():
    a = np.concatenate([np.full(500, 0.2), np.full(500, 0.8)])
    assert 0.2 <= K.otsu(a) <= 0.8
    rng = np.random.default_rng(1)
    flat = np.full((24, 24), 0.5)
    noisy = flat + rng.normal(0, 0.05, flat.shape)
    assert np.abs(K.denoise_means(noisy, reach=3) - flat).mean() < np.abs(noisy - flat).mean() / 2


def test_morphology():
    m = np.zeros((11, 11), bool)
    m[5, 5] = True
    assert K.dilate(m, 1).sum() == 5 and K.erode(K.dilate(m, 2), 2).sum() == 1
    assert K.opening(m).sum() == 0 and K.closing(m)[5, 5]
    sq = np.zeros((11, 11), bool)
    sq[3:8, 3:8] = True
    assert not K.edge_of(sq)[5, 5] and K.edge_of(sq)[3, 3]


@pytest.mark.parametrize("angle", [-1.2, -0.3, 0.0, 1.2])
def test_skew(angle):
    m = np.zeros((200, 300), bool)
    m[40:160:30] = True
    tilted = K.rotate(m, angle)
    found = K.skew_angle(tilted)
    assert abs(abs(found) - abs(angle)) <= 0.25
    if abs(angle) > 1:
        level = K.rotate(tilted, -angle)
        assert abs(K.skew_angle(level)) <= 0.25


def test_hough_and_coverage():
    m = ring(80, 20, 2, (38, 41))
    y, x, r, score = K.hough_circles(m, range(17, 24))[0]
    assert abs(y - 38) <= 1 and abs(x - 41) <= 1 and abs(r - 20) <= 1 and score > 0.8
    gap = m.copy()
    gap[:38, 41:] = False
    assert all(s < 0.88 for *_, s in K.hough_circles(gap, range(17, 24)))


def test_ncc_finds_the_template():
    t = K.open_v(24)
    scene = np.zeros((100, 120), bool)
    scene[30 : 30 + t.shape[0], 50:74] |= t
    score = K.ncc(scene, t)
    (y, x, s), *_ = K.peaks(score, 0.62, 10)
    assert (y, x) == (30, 50) and s == pytest.approx(1.0, abs=1e-6)
    want = np.corrcoef(scene[31 : 31 + t.shape[0], 52:76].ravel(), t.ravel())[0, 1]
    assert score[31, 52] == pytest.approx(want, abs=1e-9)
    assert K.ncc(scene[:5, :5], t).size == 0


def test_lines_skeleton_edges():
    m = np.zeros((60, 60), bool)
    m[30, 5:55] = True
    (x0, y0, x1, y1), *_ = K.line_segments(m)
    assert y0 == y1 == 30 and abs(x1 - x0) == 49
    thick = np.zeros((40, 60), bool)
    thick[15:25, 5:55] = True
    s = K.skeleton(thick)
    assert 0 < s.sum() < 80 and K.label(s)[1] == 1
    img = np.zeros((40, 40))
    img[:, 20:] = 1.0
    e = K.canny(img, 1.0, 0.5, 1.0)
    assert set(np.nonzero(e)[1]) <= {18, 19, 20, 21} and e[5:35].any(1).all()
    assert K.gradient_angle(img)[20, 20] == 0


def test_circles_by_bisectors():
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    pts = np.stack([50 + 20 * np.cos(t), 30 + 20 * np.sin(t)], 1)
    found = K.circles_by_bisectors(pts, (15, 28), samples=500)
    assert len(found) > 100 and np.allclose(np.median(found, 0), [50, 30, 20], atol=1e-6)
    assert (K.circles_by_bisectors(pts, (15, 28), 500) == found).all()
    assert K.circles_by_bisectors(pts[:2], (1, 9)).shape == (0, 3)


def test_templates_moments_patches():
    pic = np.full((40, 30), 255.0)
    pic[10:30, 5:15] = 0
    t = K.template_from_picture(pic)
    assert sorted(t) == list(range(7, 15)) and t[10].shape == (10, 5) and t[10].all()
    a = np.zeros((40, 40), bool)
    a[5:20, 5:11] = True
    assert np.allclose(K.hu_moments(a)[:2], K.hu_moments(np.rot90(a))[:2], atol=1e-6)
    assert K.patch_for_text(np.zeros((2, 3), np.uint8)).shape == (6, 9) and K.patch_for_text(np.zeros((2, 3), np.uint8)).min() == 255
    assert K.star(18).any() and K.sharpen(np.full((4, 4), 7, np.uint8)).tolist() == np.full((4, 4), 7).tolist()
    assert K.resize_nearest(np.arange(4).reshape(2, 2), 4, 4)[0].tolist() == [0, 0, 1, 1]
