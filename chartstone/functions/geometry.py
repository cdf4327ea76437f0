"""Geometry on columns: transforms, circles, angles, lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def affine(px: Column, py: Column, a: Column, b: Column, c: Column) -> Column:
    """a + b*px + c*py: one axis of a pixel-to-map transform."""
    return _c(a) + _c(b) * px + _c(c) * py


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(_c(x1) - _c(x2), _c(y1) - _c(y2))


def circle_from_points(x1, y1, x2, y2, x3, y3, eps: float = 1e-8) -> Column:
    """struct(cx, cy, r) of the circle through three points; null if they are (nearly) on a line."""
    ax, ay, bx, by = x2 - x1, y2 - y1, x3 - x1, y3 - y1
    det = F.lit(2.0) * (ax * by - ay * bx)
    qa, qb = ax * ax + ay * ay, bx * bx + by * by
    ux, uy = (by * qa - ay * qb) / F.nullif(det, F.lit(0.0)), (ax * qb - bx * qa) / F.nullif(det, F.lit(0.0))
    found = F.struct((x1 + ux).alias("cx"), (y1 + uy).alias("cy"), F.sqrt(ux * ux + uy * uy).alias("r"))
    return F.when(F.abs(det) >= eps, found)


def chord_gradient_centre(x1, y1, x2, y2, angle_deg, eps: float = 1e-6) -> Column:
    """struct(cx, cy): where the chord's perpendicular bisector meets the gradient line through its first point."""
    gx, gy = F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg))
    dx, dy = x2 - x1, y2 - y1
    along = dx * gx + dy * gy
    t = (dx * dx + dy * dy) / (F.lit(2.0) * F.nullif(along, F.lit(0.0)))
    return F.when(F.abs(along) >= eps, F.struct((x1 + t * gx).alias("cx"), (y1 + t * gy).alias("cy")))


def angle_diff(a: Column, b: Column, period: float = 360.0) -> Column:
    """Smallest difference of two angles in degrees."""
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, F.lit(period) - d)


def isosceles(chord_deg: Column, grad1_deg: Column, grad2_deg: Column, tolerance: float = 35.0) -> Column:
    """Whether both gradients make about the same base angle with the chord (directions folded to 180 degrees)."""
    return F.abs(angle_diff(grad1_deg, chord_deg, 180.0) - angle_diff(grad2_deg, chord_deg, 180.0)) <= tolerance


def bearing(dx: Column, dy: Column) -> Column:
    """Track in degrees, 0 up the page, clockwise (y grows downwards)."""
    return F.pmod(F.degrees(F.atan2(dx, -dy)), F.lit(360.0))


def path_length(points: Column) -> Column:
    """Length of an array of struct(x, y), summed from its start; a leg without one of its ends counts as nothing."""
    n = F.size(points)
    at = lambda i, c: F.get(points, i)[c] - F.get(points, i - 1)[c]
    # the root of the squares' sum is exact to the last bit where hypot is not
    legs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.coalesce(F.sqrt(at(i, "x") * at(i, "x") + at(i, "y") * at(i, "y")), F.lit(0.0))))
    return F.coalesce(F.aggregate(legs, F.lit(0.0), lambda a, v: a + v), F.lit(0.0))


def line_intersection(x1, y1, x2, y2, x3, y3, x4, y4, eps: float = 1e-9) -> Column:
    """struct(x, y) of two infinite lines; null if they are parallel."""
    det = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    safe = F.nullif(det, F.lit(0.0))
    return F.when(F.abs(det) > eps, F.struct(((a * (x3 - x4) - (x1 - x2) * b) / safe).alias("x"), ((a * (y3 - y4) - (y1 - y2) * b) / safe).alias("y")))


def rotate(x: Column, y: Column, cx, cy, angle_deg: Column) -> Column:
    """struct(x, y) turned about (cx, cy)."""
    c, s = F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg))
    return F.struct((_c(cx) + c * (x - cx) - s * (y - cy)).alias("x"), (_c(cy) + s * (x - cx) + c * (y - cy)).alias("y"))


def chord_ratio(area: Column, perimeter: Column) -> Column:
    return area / F.greatest(perimeter, F.lit(1.0))


def aspect(h: Column, w: Column) -> Column:
    return F.greatest(h, w) / F.greatest(F.least(h, w), F.lit(1))


def scaled_length(value, dpi, base_dpi: float = 150.0) -> Column:
    """A length threshold at another resolution: half-even rounding, 1 at least."""
    return F.greatest(F.lit(1.0), F.bround(_c(value) * _c(dpi) / base_dpi))


def scaled_area(value, dpi, base_dpi: float = 150.0) -> Column:
    ratio = _c(dpi) / base_dpi
    return F.greatest(F.lit(1.0), F.bround(_c(value) * ratio * ratio))


def bounds_transform(lat_max, lat_min, lon_min, lon_max, width, height) -> Column:
    """struct(a, b, c, d, e, f): lon = a + b*px + c*py, lat = d + e*px + f*py for a page that fills its bounds."""
    zero = F.lit(0.0)
    return F.struct(
        _c(lon_min).cast("double").alias("a"), ((_c(lon_max) - _c(lon_min)) / _c(width)).cast("double").alias("b"), zero.alias("c"),
        _c(lat_max).cast("double").alias("d"), zero.alias("e"), (-(_c(lat_max) - _c(lat_min)) / _c(height)).cast("double").alias("f"),
    )


def identity_transform() -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.struct(zero.alias("a"), one.alias("b"), zero.alias("c"), zero.alias("d"), zero.alias("e"), one.alias("f"))


def header_transform(lat, lon, width, height, margin: float = 0.05) -> Column:
    """A page about a position known from its header: ``margin`` degrees to each side."""
    return bounds_transform(lat + margin, lat - margin, lon - margin, lon + margin, width, height)


def box_centre(x0, y0, x1, y1) -> Column:
    return F.struct(((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y"))


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, _c(low)), _c(high))
