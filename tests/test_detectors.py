"""Detectors on drawn scenes."""

import numpy as np
import pytest

from chartstone.functions.color import HsvRange
from chartstone.operators import detectors as D
from chartstone.operators import kernels as K

RED = HsvRange("red", (0.0, 0.05), (0.3, 1.0), (0.3, 1.0))


def triangle(size=24, at=(20, 20), shape=(80, 80)):
    m = np.zeros(shape, bool)
    for k in range(size):
        m[at[0] + k, at[1] + size // 2 - k // 2 : at[1] + size // 2 + k // 2 + 1] = True
    return m


def test_triangles_but_not_squares():
    rgb = np.full((80, 80, 3), 255, np.uint8)
    rgb[triangle()] = (220, 10, 10)
    rgb[55:75, 50:70] = (220, 10, 10)
    (t,) = D.coloured_triangles(rgb, RED)
    assert abs(t["y"] - 32) <= 2 and abs(t["x"] - 32) <= 2 and t["score"] == 0.75


def test_dots_and_legs():
    m = np.zeros((100, 100), bool)
    v = K.open_v(32)
    m[20 : 20 + v.shape[0], 30:62] |= v
    yy, xx = np.mgrid[:100, :100]
    m |= (yy - 72) ** 2 + (xx - 46) ** 2 <= 9
    found = [d for d in D.dots(m) if d["type"] == "dot"]
    assert [(d["y"], d["x"]) for d in found] == [(72, 46)]
    (o,) = D.legs_over_dots(m, found)
    assert o["type"] == "obstacle_single" and o["x"] == 46
    assert D.legs_over_dots(np.zeros((100, 100), bool), found) == []


def test_outlines_and_blobs():
    m = np.zeros((80, 120), bool)
    m[20:40, 10:80] = True
    m[23:37, 13:77] = False
    assert [r["type"] for r in D.racetracks(m)] == ["holding"]
    m[60:66, 100:106] = True
    assert [(r["y"], r["x"]) for r in D.dark_blobs(m)] == [(63, 103)]
    line = np.zeros((60, 200), bool)
    line[30, 10:190] = True
    assert [r["type"] for r in D.route_lines(line)] == ["route"]


def test_semantic_masks():
    black, blue = np.zeros((100, 100), bool), np.zeros((100, 100), bool)
    black[10:20, 10:14] = True
    black[50, 5:95] = True
    black[80, 80] = True
    blue[30:45, 60:75] = True
    s = D.semantic_masks(np.zeros_like(blue), blue, black)
    assert s["text"][12:18, 11:13].all() and not s["text"][80, 80]
    assert s["routes"][50].sum() > 80 and s["symbols"][32:43, 62:73].all() and s["boundaries"].any()


def test_airspace_and_helipads():
    rgb = np.full((120, 120, 3), 255, np.uint8)
    rgb[20:50, 20:55] = (220, 10, 10)
    (a,) = D.airspace_blobs(rgb, RED)
    assert a["type"] == "airspace_red" and a["score"] == pytest.approx(30 * 35 / 5000, rel=0.05)
    m = np.zeros((80, 80), bool)
    yy, xx = np.mgrid[:80, :80]
    d = np.hypot(yy - 40, xx - 40)
    m |= (d >= 11) & (d <= 13.5)
    assert any(abs(r["y"] - 40) <= 1 and abs(r["x"] - 40) <= 1 for r in D.helipad_rings(m, range(10, 16)))


def test_insets(spark):
    charts = spark.createDataFrame([("c", 1000, 1000)], "chart_id string, height int, width int")
    comps = spark.createDataFrame([("c", 0, 0, 400, 500, 1800), ("c", 0, 0, 100, 100, 50), ("c", 0, 0, 990, 990, 9000), ("c", 0, 0, 300, 300, 90000)], "chart_id string, y0 long, x0 long, y1 long, x1 long, area long")
    assert [(r.y1, r.x1) for r in D.inset_boxes(comps, charts).collect()] == [(400, 500)]


def test_upscale_and_peak_map():
    a, s = K.upscale_long_edge(np.full((10, 20, 3), 77, np.uint8), 60)
    assert a.shape == (30, 60, 3) and s == 3 and (a == 77).all()
    assert K.upscale_long_edge(a, 50)[1] == 1.0
    t = K.open_v(24)
    m = np.zeros((80, 80), bool)
    m[20 : 20 + t.shape[0], 30:54] |= t
    p = K.peak_map(m, [t, K.open_v(28)])
    assert p[~m].max() == -1 and p.shape == m.shape
