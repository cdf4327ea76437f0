"""Colour on columns: grey, HSV, inclusive ranges with hue wrap."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Luma weights (fixed values).
LUMA = (0.2125, 0.7154, 0.0721)


def grey(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h, s, v) in 0..1 of channels in 0..255."""
    r, g, b = (c.cast("double") / 255.0 for c in (r, g, b))
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    safe = F.nullif(d, F.lit(0.0))
    h = F.when(v == r, (g - b) / safe).when(v == g, 2.0 + (b - r) / safe).otherwise(4.0 + (r - g) / safe)
    h = F.when(d == 0, 0.0).otherwise(F.pmod(h / 6.0, F.lit(1.0)))
    return F.struct(h.alias("h"), F.when(v == 0, 0.0).otherwise(d / F.nullif(v, F.lit(0.0))).alias("s"), v.alias("v"))


@dataclass(frozen=True)
class HsvRange:
    """Inclusive bounds; a second hue interval serves colours that wrap round red."""

    name: str
    h: tuple[float, float]
    s: tuple[float, float] = (0.0, 1.0)
    v: tuple[float, float] = (0.0, 1.0)
    h2: tuple[float, float] | None = None

    def matches(self, c: Column) -> Column:
        hue = c["h"].between(*self.h)
        if self.h2:
            hue = hue | c["h"].between(*self.h2)
        return hue & c["s"].between(*self.s) & c["v"].between(*self.v)

    def matches8(self, c: Column) -> Column:
        """The same for bounds on the 8-bit scale (hue 0..179, others 0..255)."""
        eight = F.struct(F.rint(c["h"] * 180).alias("h"), F.rint(c["s"] * 255).alias("s"), F.rint(c["v"] * 255).alias("v"))
        return self.matches(eight)


#: Colour families of a chart (fixed values; charts differ, pass your own).
FAMILIES = (
    HsvRange("magenta", (0.78, 1.0), (0.15, 1.0), (0.25, 1.0), (0.0, 0.08)),
    HsvRange("blue", (0.55, 0.72), (0.15, 1.0), (0.20, 1.0)),
    HsvRange("black", (0.0, 1.0), (0.0, 1.0), (0.0, 0.45)),
    HsvRange("grey", (0.0, 1.0), (0.0, 0.15), (0.45, 0.70)),
    HsvRange("terrain", (0.05, 0.15), (0.08, 0.55), (0.55, 1.0)),
)
#: Colour classes of a survey of a whole chart (fixed values); classes may overlap.
CLASSES = (
    HsvRange("faa_blue", (0.53, 0.72), (0.20, 1.0), (0.25, 1.0)),
    HsvRange("faa_magenta", (0.82, 1.00), (0.25, 1.0), (0.20, 1.0), (0.00, 0.05)),
    HsvRange("black_ink", (0.00, 1.00), (0.00, 1.0), (0.00, 0.28)),
    HsvRange("terrain_brown", (0.04, 0.12), (0.20, 1.0), (0.30, 1.0)),
    HsvRange("terrain_green", (0.25, 0.45), (0.05, 1.0), (0.50, 1.0)),
    HsvRange("urban_yellow", (0.09, 0.20), (0.08, 1.0), (0.65, 1.0)),
    HsvRange("water_cyan", (0.48, 0.56), (0.22, 1.0), (0.55, 0.90)),
    HsvRange("white_background", (0.00, 1.00), (0.00, 0.12), (0.80, 1.0)),
)
#: Percent of a chart that each family may cover.
COVERAGE_BOUNDS = (("magenta", 0.5, 8.0), ("blue", 1.0, 15.0), ("black", 5.0, 40.0))


def family_flags(c: Column, families=FAMILIES) -> Column:
    """array of the names of all families a pixel belongs to: families may overlap.

    c is a column that holds ``hsv``: it is used many times, so compute it in a projection of its own.
    """
    return F.array_compact(F.array(*[F.when(f.matches(c), F.lit(f.name)) for f in families]))


def class_shares(df: DataFrame, c: str, keys: Sequence[str] = (), classes=CLASSES) -> DataFrame:
    """(keys, class, n, share) of every class, in percent of the pixels; ``unclassified`` is what the classes' sum leaves, 0 at least.

    ``c`` is a column that holds ``hsv``. One aggregation, whatever the number of classes; no pixels give no rows.
    """
    counts = [F.count_if(k.matches(F.col(c))).alias(k.name) for k in classes]
    sums = df.groupBy(*keys).agg(F.count("*").alias("total"), *counts).filter("total > 0")
    classified = sum((F.col(k.name) for k in classes), F.lit(0))
    entry = lambda name, n: F.struct(F.lit(name).alias("class"), n.cast("long").alias("n"))
    rest = F.col("total") - F.least(classified, F.col("total"))
    rows = F.explode(F.array(*[entry(k.name, F.col(k.name)) for k in classes], entry("unclassified", rest)))
    return sums.select(*keys, "total", rows.alias("e")).select(*keys, "e.class", "e.n", (100.0 * F.col("e.n") / F.col("total")).alias("share"))
