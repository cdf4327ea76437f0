"""Tiles with halos, kernels over them, and components across their seams.

A tile row carries its inner box (what it owns, half open) and its padded payload. Kernels run in Arrow batches, one tile at a
time, so a task's memory is a tile. Objects found twice in halos are kept by the tile that owns their centre.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartstone.operators import kernels as K
from chartstone.operators.suppression import components
from chartstone.operators.tables import written

TILE_SCHEMA = "chart_id string, ty int, tx int, y0 int, x0 int, y1 int, x1 int, py int, px int, h int, w int, channels int, payload binary"


def grid(charts: DataFrame, tile: int, halo: int = 0) -> DataFrame:
    """charts (chart_id, height, width) to tile boxes: inner box (y0, x0, y1, x1) and padded box (py, px, qy, qx)."""
    ty = F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / tile).cast("int") - 1))
    tx = F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / tile).cast("int") - 1))
    t = charts.withColumn("ty", ty).withColumn("tx", tx)
    low = lambda c: F.col(c) * tile
    t = t.withColumns({"y0": low("ty"), "x0": low("tx")})
    t = t.withColumns({"y1": F.least(F.col("y0") + tile, F.col("height")), "x1": F.least(F.col("x0") + tile, F.col("width"))})
    return t.withColumns(
        {
            "py": F.greatest(F.lit(0), F.col("y0") - halo), "px": F.greatest(F.lit(0), F.col("x0") - halo),
            "qy": F.least(F.col("height"), F.col("y1") + halo), "qx": F.least(F.col("width"), F.col("x1") + halo),
        }
    )


def assign(points: DataFrame, tile: int, halo: int) -> DataFrame:
    """points with a row for each tile whose padded box holds them, and ``owner``: whether the inner box does. Four rows at most."""
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    t = points.withColumn("ty", F.explode(span("y"))).withColumn("tx", F.explode(span("x")))
    # a padded box is half open: a point that lies exactly one halo beyond the inner box's far edge is outside
    t = t.filter((F.col("y") < (F.col("ty") + 1) * tile + halo) & (F.col("x") < (F.col("tx") + 1) * tile + halo))
    owner = (F.col("ty") == F.floor(F.col("y") / tile)) & (F.col("tx") == F.floor(F.col("x") / tile))
    return t.withColumn("owner", owner)


def owned(y: Column, x: Column) -> Column:
    """Whether chart coordinates lie in the inner box of the row's tile."""
    return (y >= F.col("y0")) & (y < F.col("y1")) & (x >= F.col("x0")) & (x < F.col("x1"))


def cut(spark: SparkSession, images: DataFrame, tile: int, halo: int = 0) -> DataFrame:
    """images (chart_id, height, width, channels, data: row-major bytes) to tiles."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                rows = []
                for y0 in range(0, r.height, tile):
                    for x0 in range(0, r.width, tile):
                        y1, x1 = min(y0 + tile, r.height), min(x0 + tile, r.width)
                        py, px, qy, qx = max(0, y0 - halo), max(0, x0 - halo), min(r.height, y1 + halo), min(r.width, x1 + halo)
                        rows.append((r.chart_id, y0 // tile, x0 // tile, y0, x0, y1, x1, py, px, qy - py, qx - px, r.channels, zlib.compress(a[py:qy, px:qx].tobytes(), 1)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILE_SCHEMA.split(", ")])

    return images.select("chart_id", "height", "width", "channels", "data").mapInPandas(run, TILE_SCHEMA)


def pixels(row) -> np.ndarray:
    a = np.frombuffer(zlib.decompress(row.payload), np.uint8).reshape(row.h, row.w, row.channels)
    return a[..., 0] if row.channels == 1 else a


def map_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tile to tile: the kernel sees the padded pixels and gives an array of the same height and width; masks are kept as 0/255."""

    def run(batches):
        for batch in batches:
            out = batch.copy()
            made = []
            for r in batch.itertuples():
                a = kernel(pixels(r))
                a = a.astype(np.uint8) * 255 if a.dtype == bool else a.astype(np.uint8)
                made.append((1 if a.ndim == 2 else a.shape[2], zlib.compress(np.ascontiguousarray(a).tobytes(), 1)))
            out["channels"], out["payload"] = [m[0] for m in made], [m[1] for m in made]
            yield out

    return tiles.mapInPandas(run, tiles.schema)


def find_in_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray], list[dict]], schema: str, y: str = "y", x: str = "x") -> DataFrame:
    """Records that a kernel finds in each tile, shifted to chart coordinates and kept where the tile owns their place.

    schema lists the kernel's fields; its place fields ``y`` and ``x`` (and any field named in SHIFTED) move with the tile.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                for rec in kernel(pixels(r)):
                    rec = {k: v + (r.py if k in SHIFT_Y else r.px if k in SHIFT_X else 0) if k in SHIFT_Y | SHIFT_X else v for k, v in rec.items()}
                    if r.y0 <= rec[y] < r.y1 and r.x0 <= rec[x] < r.x1:
                        rows.append((r.chart_id, r.ty, r.tx, *[rec[n] for n in names]))
            yield pd.DataFrame(rows, columns=["chart_id", "ty", "tx", *names])

    return tiles.mapInPandas(run, "chart_id string, ty int, tx int, " + schema)


SHIFT_Y, SHIFT_X = frozenset({"y", "cy", "y0", "y1"}), frozenset({"x", "cx", "x0", "x1"})
REGION = "label long, area long, y0 long, x0 long, y1 long, x1 long, cy double, cx double, perimeter double, solidity double, eccentricity double, euler long, extent double"


def regions_in_tiles(tiles: DataFrame) -> DataFrame:
    """Components of each tile by itself (objects cut by a seam count twice): the per-tile scope."""
    return find_in_tiles(tiles, lambda a: K.region_table(*K.label(a > 128)), REGION, "cy", "cx")


def mask_runs(tiles: DataFrame) -> DataFrame:
    """(chart_id, y, x0, x1): ink runs of the inner boxes in chart coordinates, cut at seams. Needs tiles without halo or cuts it off."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a = pixels(r)[r.y0 - r.py : r.y1 - r.py, r.x0 - r.px : r.x1 - r.px] > 128
                labels, _ = K.label(a)
                rows += [(r.chart_id, r.ty, r.tx, int(labels[y, x0]), int(y) + r.y0, int(x0) + r.x0, int(x1) + r.x0) for y, x0, x1 in K.runs(a)]
            yield pd.DataFrame(rows, columns=["chart_id", "ty", "tx", "local", "y", "x0", "x1"])

    return tiles.mapInPandas(run, "chart_id string, ty int, tx int, local long, y long, x0 long, x1 long")


def components_across(tiles: DataFrame, tile: int) -> DataFrame:
    """(chart_id, label, runs): 8-connected components of whole charts.

    Tiles label their inner boxes; runs that touch across a seam (rows next to a tile edge, or columns) meet in an equi-join on
    the border line, and the label graph is contracted. Pixels never leave their tile but as runs.
    """
    runs = mask_runs(tiles)
    key = F.xxhash64("chart_id", "ty", "tx", "local")
    runs = written(runs.withColumn("node", key))
    # across horizontal seams: the last row of a tile against the first row of the tiles below
    above = runs.filter(F.col("y") % tile == tile - 1).select("chart_id", (F.col("y") + 1).alias("line"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("node").alias("u"))
    below = runs.filter(F.col("y") % tile == 0).select(F.col("chart_id").alias("_c"), F.col("y").alias("_line"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("node").alias("v"))
    cell = lambda c: F.floor(F.col(c) / tile)
    above = above.withColumn("cell", F.explode(F.sequence(F.floor((F.col("a0") - 1) / tile), cell("a1"))))
    below = below.withColumn("_cell", cell("b0"))  # a run lies in one tile
    touch = (F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1"))
    vertical = above.join(below, (F.col("chart_id") == F.col("_c")) & (F.col("line") == F.col("_line")) & (F.col("cell") == F.col("_cell")) & touch).select("u", "v")
    # across vertical seams: runs that end at a seam against runs that begin there, in the rows around
    left = runs.filter(F.col("x1") % tile == 0).select("chart_id", F.col("x1").alias("line"), F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("row"), F.col("node").alias("u"))
    right = runs.filter(F.col("x0") % tile == 0).select(F.col("chart_id").alias("_c"), F.col("x0").alias("_line"), F.col("y").alias("_row"), F.col("node").alias("v"))
    horizontal = left.join(right, (F.col("chart_id") == F.col("_c")) & (F.col("line") == F.col("_line")) & (F.col("row") == F.col("_row"))).select("u", "v")
    roots = components(vertical.unionByName(horizontal))
    named = runs.join(roots, runs["node"] == roots["id"], "left")
    return named.select("chart_id", F.coalesce("to", "node").alias("label"), "y", "x0", "x1")


def component_stats(runs: DataFrame) -> DataFrame:
    """Additive properties of components from their runs: area, box, centre."""
    n = F.col("x1") - F.col("x0")
    mid = (F.col("x0") + F.col("x1") - 1) / 2
    g = runs.groupBy("chart_id", "label").agg(
        F.sum(n).alias("area"), F.min("y").alias("y0"), F.min("x0").alias("x0"), (F.max("y") + 1).alias("y1"), F.max("x1").alias("x1"),
        F.sum(n * F.col("y")).alias("sy"), F.sum(n * mid).alias("sx"),
    )
    return g.withColumns({"cy": F.col("sy") / F.col("area"), "cx": F.col("sx") / F.col("area")}).drop("sy", "sx")


def coverage(runs: DataFrame, charts: DataFrame) -> DataFrame:
    """(chart_id, percent): ink share of whole charts."""
    ink = runs.groupBy("chart_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("ink"))
    total = F.col("height").cast("double") * F.col("width")
    return charts.join(ink, "chart_id", "left").select("chart_id", (100.0 * F.coalesce("ink", F.lit(0)) / total).alias("percent"))
