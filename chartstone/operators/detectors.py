"""Detectors on one tile beyond correlation and rings: coloured shapes, outlines, lines over dots, insets, semantic masks.

Kernels take pixels and return records for ``tiles.find_in_tiles`` or masks for ``tiles.map_tiles``. Confidences are fixed per detector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartstone.functions import color
from chartstone.operators import kernels as K

RECORD = "y long, x long, w long, h long, type string, score double"


def circularity(area, perimeter):
    """4 pi area / perimeter^2, at most 1; on numbers."""
    return min(1.0, 4 * np.pi * area / max(perimeter, 1.0) ** 2)


def circularity_of(area: Column, perimeter: Column) -> Column:
    p = F.greatest(perimeter, F.lit(1.0))
    return F.least(F.lit(1.0), 4 * F.pi() * area / (p * p))


def family(rgb: np.ndarray, f: color.HsvRange) -> np.ndarray:
    """Mask of a colour family."""
    c = rgb[..., :3].astype(np.float64) / 255.0
    v, d = c.max(-1), c.max(-1) - c.min(-1)
    safe, (r, g, b) = np.where(d == 0, 1, d), np.moveaxis(c, -1, 0)
    h = np.where(d == 0, 0, np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) / 6 % 1.0)
    s = np.where(v == 0, 0, d / np.where(v == 0, 1, v))
    within = lambda z, bounds: (z >= bounds[0]) & (z <= bounds[1])
    hue = within(h, f.h) | (within(h, f.h2) if f.h2 else False)
    return hue & within(s, f.s) & within(v, f.v)


def keep_sizes(mask: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
    """Components of low..high pixels."""
    labels, n = K.label(mask)
    size = np.bincount(labels.ravel(), minlength=n + 1)
    ok = (size >= low) & (size <= (high if high is not None else size.max(initial=0)))
    ok[0] = False
    return ok[labels]


def semantic_masks(magenta: np.ndarray, blue: np.ndarray, black: np.ndarray) -> dict[str, np.ndarray]:
    """Text, routes, symbols and boundaries from colour masks."""
    coloured = magenta | blue
    return {
        "text": K.opening(keep_sizes(black, 8), 1),
        "routes": K.skeleton(K.closing(keep_sizes(black | blue, 50), 1)),
        "symbols": keep_sizes(K.closing(coloured, 3), 20, 8000),
        "boundaries": keep_sizes(K.closing(coloured, 5), 200),
    }


def _records(mask: np.ndarray, kind: str, score, test) -> list[dict]:
    out = []
    labels, n = K.label(mask)
    for g in K.region_table(labels, n):
        if test(g, labels == g["label"]):
            h, w = g["y1"] - g["y0"], g["x1"] - g["x0"]
            out.append({"y": (g["y0"] + g["y1"]) // 2, "x": (g["x0"] + g["x1"]) // 2, "w": w, "h": h, "type": kind, "score": score(g) if callable(score) else score})
    return out


def corners(part: np.ndarray, tolerance: float = 0.08) -> int:
    """Corners of a filled shape's hull after simplification by ``tolerance`` of its diameter."""
    ys, xs = np.nonzero(part)
    t = np.linspace(0, 2 * np.pi, 72, endpoint=False)
    far = [int(np.argmax(xs * np.cos(a) + ys * np.sin(a))) for a in t]
    pts = list(dict.fromkeys((int(xs[k]), int(ys[k])) for k in far))
    limit = tolerance * max(np.ptp(xs), np.ptp(ys), 1)
    changed = True
    while changed and len(pts) > 3:
        changed = False
        for k in range(len(pts)):
            (ax, ay), (bx, by), (cx, cy) = pts[k - 1], pts[k], pts[(k + 1) % len(pts)]
            span = np.hypot(cx - ax, cy - ay)
            away = abs((cx - ax) * (ay - by) - (ax - bx) * (cy - ay)) / span if span else np.hypot(bx - ax, by - ay)
            if away <= limit:
                del pts[k]
                changed = True
                break
    return len(pts)


def coloured_triangles(rgb: np.ndarray, f: color.HsvRange) -> list[dict]:
    """Filled triangles of a colour: waypoints."""
    return _records(K.opening(family(rgb, f), 1), "waypoint", 0.75, lambda g, part: 30 < g["area"] < 2000 and corners(part) == 3)


def racetracks(mask: np.ndarray) -> list[dict]:
    """Hollow elongated outlines: holding patterns."""

    def test(g, part):
        h, w = g["y1"] - g["y0"], g["x1"] - g["x0"]
        return g["euler"] <= 0 and 1.8 <= max(h, w) / max(1, min(h, w)) <= 6 and g["extent"] < 0.6

    return _records(mask, "holding", 0.65, test)


def dark_blobs(mask: np.ndarray) -> list[dict]:
    return _records(mask, "obstacle", 0.55, lambda g, _: 15 <= g["area"] <= 400 and g["solidity"] >= 0.6)


def dots(mask: np.ndarray, low: int = 6, high: int = 140, least: float = 0.68) -> list[dict]:
    return _records(mask, "dot", lambda g: circularity(g["area"], g["perimeter"]), lambda g, _: low <= g["area"] <= high and circularity(g["area"], g["perimeter"]) >= least)


def airspace_blobs(rgb: np.ndarray, f: color.HsvRange) -> list[dict]:
    """Closed and opened colour regions from 200 px to a tenth of the tile."""
    m = K.opening(K.closing(K.closing(family(rgb, f), 2), 2), 1)
    return _records(m, f"airspace_{f.name}", lambda g: min(1.0, g["area"] / 5000), lambda g, _: 200 <= g["area"] <= m.size / 10)


def helipad_rings(mask: np.ndarray, radii: range = range(8, 41)) -> list[dict]:
    return [{"y": y, "x": x, "w": 2 * r, "h": 2 * r, "type": "helipad", "score": 0.60} for y, x, r, _ in K.hough_circles(mask, radii, 0.75)]


def route_lines(mask: np.ndarray, least: int = 80) -> list[dict]:
    return [{"y": (y0 + y1) // 2, "x": (x0 + x1) // 2, "w": abs(x1 - x0), "h": abs(y1 - y0), "type": "route", "score": 0.60} for x0, y0, x1, y1 in K.line_segments(mask, least)]


def legs_over_dots(mask: np.ndarray, found: list[dict], reach: int = 70) -> list[dict]:
    """Dots with two legs or more above them (40..75 and 105..140 degrees): obstacles."""
    out = []
    for d in found:
        y, x = d["y"], d["x"]
        top, left = max(0, y - reach), max(0, x - reach)
        crop = mask[top : max(0, y - d["h"] // 2), left : x + reach]
        if not crop.any():
            continue
        legs = []
        for x0, y0, x1, y1 in K.line_segments(crop, 8, 3, 3.0, 8):
            angle = np.degrees(np.arctan2(y1 - y0, x1 - x0)) % 180
            if 40 <= angle <= 75 or 105 <= angle <= 140:
                legs.append((x0, y0, x1, y1))
        if len(legs) < 2:
            continue
        ax, ay = np.mean([v for s in legs for v in (s[0], s[2])]), min(v for s in legs for v in (s[1], s[3]))
        if abs(ax - (x - left)) <= 0.6 * reach:
            high = y - (top + ay) + 5
            out.append({"y": (y + top + ay) // 2, "x": x, "w": max(high, 30), "h": high, "type": "obstacle_single", "score": 0.86})
    return out


def inset_boxes(components: DataFrame, charts: DataFrame) -> DataFrame:
    """(chart_id, y0, x0, y1, x1): frames of insets among whole-chart components, by the share of the chart they span and their shape."""
    j = components.join(charts, "chart_id")
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    share, aspect = h * w / (F.col("height").cast("double") * F.col("width")), w / h
    return j.filter((share > 0.05) & (share < 0.40) & (aspect > 0.5) & (aspect < 3.0) & (F.col("area") < 0.5 * h * w)).select("chart_id", "y0", "x0", "y1", "x1")


def inset_transform(insets: DataFrame, parents: DataFrame) -> DataFrame:
    """Insets (chart_id, x0, y0, width, height) with their own transform (a..f) from the parent page's: its origin at the inset's corner, its scale by the zoom.

    parents has chart_id, page_width, page_height and a..f.
    """
    j = insets.join(parents, "chart_id")
    zx, zy = F.col("width") / F.col("page_width"), F.col("height") / F.col("page_height")
    at = lambda k, sx, sy: F.col(k) + F.col(sx) * F.col("x0") + F.col(sy) * F.col("y0")
    zero = F.lit(0.0)
    return j.select(
        *insets.columns, at("a", "b", "c").alias("a"), (F.col("b") / zx).alias("b"), zero.alias("c"), at("d", "e", "f").alias("d"), zero.alias("e"), (F.col("f") / zy).alias("f")
    )


def text_payload(blocks: DataFrame, transforms: DataFrame, limit: int = 400) -> DataFrame:
    """The first ``limit`` blocks of each chart with approximate positions: what an outside text model receives."""
    w = Window.partitionBy("chart_id").orderBy("ord")
    first = blocks.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
    j = first.join(transforms, "chart_id")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    lon, lat = F.col("a") + F.col("b") * cx + F.col("c") * cy, F.col("d") + F.col("e") * cx + F.col("f") * cy
    return j.select("chart_id", "ord", "text", F.round(lat, 5).alias("approx_lat"), F.round(lon, 5).alias("approx_lon"), F.round("size", 1).alias("font_size"))
