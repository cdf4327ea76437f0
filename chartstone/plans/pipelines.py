"""End-to-end chains: pictures to masks, components, detections, positions, layers and entity documents.

Each function adds steps to one lazy DataFrame graph. Tables are written only after components and after
suppression, the wide stages that later steps reuse.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartstone.functions import color, rules
from chartstone.functions import text as T
from chartstone.operators import entities, fit, spatial, suppression, tiles
from chartstone.operators import kernels as K
from chartstone.operators.tables import written


def binarise(image_tiles: DataFrame, window: int = 25, k: float = 0.2) -> DataFrame:
    """RGB or grey tiles (halo of half the window or more) to ink masks."""
    return tiles.map_tiles(image_tiles, lambda a: K.sauvola(K.to_grey(a) if a.ndim == 3 else a / 255.0, window, k))


def denoise(image_tiles: DataFrame) -> DataFrame:
    return tiles.map_tiles(image_tiles, lambda a: np.clip(K.denoise_means(K.to_grey(a) if a.ndim == 3 else a / 255.0) * 255, 0, 255))


def skew(mask_tiles: DataFrame, limit: float = 5.0, step: float = 0.1) -> DataFrame:
    """(chart_id, angle): tiles vote for lines in chart coordinates, votes are summed by line, and the median of the strongest angles is the tilt."""
    angles = np.round(np.arange(-limit, limit + step / 2, step), 6)

    def vote(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a = tiles.pixels(r)[r.y0 - r.py : r.y1 - r.py, r.x0 - r.px : r.x1 - r.px] > 128
                ys, xs = np.nonzero(a)
                if not len(ys):
                    continue
                for t in angles:
                    n = np.radians(90 + t)
                    rho, votes = np.unique(np.rint((xs + r.x0) * np.cos(n) + (ys + r.y0) * np.sin(n)).astype(int), return_counts=True)
                    strong = votes >= max(3, 0.05 * (r.x1 - r.x0))  # a line that spans a fifth of the chart is strong in some tile
                    rows += [(r.chart_id, float(t), int(p), int(v)) for p, v in zip(rho[strong], votes[strong])]
            yield pd.DataFrame(rows, columns=["chart_id", "angle", "rho", "votes"])

    lines = mask_tiles.mapInPandas(vote, "chart_id string, angle double, rho long, votes long").groupBy("chart_id", "angle", "rho").agg(F.sum("votes").alias("votes"))
    best = lines.groupBy("chart_id", "angle").agg(F.max("votes").alias("votes"))
    top = best.withColumn("top", F.max("votes").over(Window.partitionBy("chart_id"))).filter("votes >= 0.95 * top")  # a chart has a hundred angles
    width = mask_tiles.groupBy("chart_id").agg(F.max("x1").alias("width"))
    found = top.groupBy("chart_id").agg(F.median("angle").alias("angle"), F.max("top").alias("top"))
    return width.join(found, "chart_id", "left").select("chart_id", F.when(F.col("top") >= 0.20 * F.col("width"), F.col("angle")).otherwise(0.0).alias("angle"))


def deskew(images: DataFrame, angles: DataFrame, least: float = 0.5) -> DataFrame:
    """Pictures turned level where the tilt is ``least`` or more; white comes in at the corners."""
    joined = images.join(angles, "chart_id", "left").withColumn("angle", F.coalesce("angle", F.lit(0.0)))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                if abs(r.angle) >= least:
                    a = K.rotate(a, r.angle, nearest=False, fill=255)
                out.append(np.ascontiguousarray(a).tobytes())
            batch["data"] = out
            yield batch.drop(columns=["angle"])

    return joined.select(*images.columns, "angle").mapInPandas(run, images.schema)


def components(mask_tiles: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """(runs, table): whole-chart components with measured shape."""
    runs = written(tiles.components_across(mask_tiles, tile))

    def measure(key, g: pd.DataFrame) -> pd.DataFrame:
        m = K.run_measures(g["y"].to_numpy(), g["x0"].to_numpy(), g["x1"].to_numpy())
        return pd.DataFrame([(*key, m["perimeter"], m["solidity"], m["eccentricity"], m["euler"])], columns=["chart_id", "label", "perimeter", "solidity", "eccentricity", "euler"])

    stats = written(tiles.component_stats(runs))
    shape = runs.groupBy("chart_id", "label").applyInPandas(measure, "chart_id string, label long, perimeter double, solidity double, eccentricity double, euler long")
    table = stats.join(shape, ["chart_id", "label"], "left")
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    return runs, table.withColumns(
        {
            "h": h, "w": w, "max_dim": F.greatest(h, w), "min_dim": F.least(h, w), "aspect": F.greatest(h, w) / F.least(h, w),
            "chord": F.col("area") / F.greatest(F.coalesce("perimeter", (2 * (h + w)).cast("double")), F.lit(1.0)), "extent": F.col("area") / (h * w),
        }
    )


def densities(mask_tiles: DataFrame, sigma: float = 8.0) -> DataFrame:
    """(chart_id, cy, cx, local_density) of each tile-owned component; needs a halo of 6 sigma."""

    def kernel(a):
        m = a > 128
        g = K.region_table(*K.label(m))
        return [{"cy": r["cy"], "cx": r["cx"], "area": r["area"], "local_density": d} for r, d in zip(g, K.local_density(m, g, sigma))]

    return tiles.find_in_tiles(mask_tiles, kernel, "cy double, cx double, area long, local_density double", "cy", "cx")


def template_hits(mask_tiles: DataFrame, library: dict[str, np.ndarray], threshold: float = 0.62, distance: int = 10) -> DataFrame:
    """(chart_id, y, x, name, score, w, h): correlation peaks of every template, centre coordinates, owned by their tile."""

    def kernel(a):
        m, out = a > 128, []
        for name, t in library.items():
            for y, x, s in K.peaks(K.ncc(m, t), threshold, distance):
                out.append({"y": y + t.shape[0] // 2, "x": x + t.shape[1] // 2, "name": name, "score": s, "w": t.shape[1], "h": t.shape[0]})
        return out

    return tiles.find_in_tiles(mask_tiles, kernel, "y long, x long, name string, score double, w long, h long")


def with_ids(df: DataFrame) -> DataFrame:
    """A unique id from the place, stable between runs."""
    return df.withColumn("id", F.xxhash64("chart_id", "y", "x", *[c for c in ("name", "r") if c in df.columns]))


def ink_pixels(runs: DataFrame) -> DataFrame:
    return runs.select("chart_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


def obstacles(mask_tiles: DataFrame, runs: DataFrame, widths=(24, 28, 32), threshold: float = 0.62, require_dot: bool = False) -> DataFrame:
    """Open-V obstacles of one chart: correlation, suppression, structural gates; the dot below is an attribute unless required."""
    library = {f"v{w}": K.open_v(w) for w in widths}
    hits = written(with_ids(template_hits(mask_tiles, library, threshold)))
    limit = 0.6 * (F.col("l_w") + F.col("r_w")) / 2
    kept = written(suppression.greedy_nms(hits, 0.6 * max(widths), limit))
    at = lambda c, d, sign: (F.col(c) + sign * F.floor(F.col(d) / 2)).cast("long")
    boxes = kept.withColumns({"x0": at("x", "w", -1), "y0": at("y", "h", -1)}).withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")})
    ink = written(ink_pixels(runs).select("x", "y"))
    passed = spatial.gates(spatial.box_ink(boxes, ink, max(widths))).filter("gate = 'passed'")
    below = passed.select("id", (F.col("x0") + F.col("w") * 0.3).alias("x0"), F.col("y1").alias("y0"), (F.col("x1") - F.col("w") * 0.3).alias("x1"), (F.col("y1") + F.col("h") * 0.3).alias("y1"))
    dots = spatial.points_in_boxes(ink, below, max(widths)).groupBy(F.col("b_id").alias("_id")).agg(F.count("*").alias("dot_area"))
    out = passed.join(dots, passed["id"] == dots["_id"], "left").drop("_id").withColumn("dot_found", F.coalesce(F.col("dot_area").between(3, 25), F.lit(False)))
    return out.filter("dot_found") if require_dot else out


def rings(mask_tiles: DataFrame, radii: range = range(17, 27), least: float = 0.60, coverage: float = 0.88) -> DataFrame:
    """Rings with the ink figures of their inside, suppressed by mean radius; ``r_verified`` is the letter test."""

    def kernel(a):
        m = a > 128
        out = []
        for cy, cx, r, score in K.hough_circles(m, radii, least):
            dy, dx = K.ring(r)
            y, x = cy + dy, cx + dx
            ok = (y >= 0) & (y < m.shape[0]) & (x >= 0) & (x < m.shape[1])
            hit = np.zeros(len(y), bool)
            hit[ok] = m[y[ok], x[ok]]
            ri = 0.68 * r
            yy, xx = np.mgrid[: m.shape[0], : m.shape[1]]
            inside = (yy - cy) ** 2 + (xx - cx) ** 2 <= ri * ri
            n = max(1, int(inside.sum()))
            part = lambda s: int((m & inside & s).sum())  # noqa: E731, B023
            bl, br, top = part((yy >= cy) & (xx < cx)), part((yy >= cy) & (xx >= cx)), part(yy < cy)
            out.append({"y": cy, "x": cx, "r": r, "score": score, "coverage": float(hit.mean()), "ink": part(True) / n, "br_bl": br / max(bl, 1), "top": top / (n / 2)})
        return out

    found = tiles.find_in_tiles(mask_tiles, kernel, "y long, x long, r long, score double, coverage double, ink double, br_bl double, top double")
    found = written(with_ids(found.filter(F.col("coverage") >= coverage)))
    kept = suppression.greedy_nms(found, float(max(radii)), (F.col("l_r") + F.col("r_r")) / 2.0)
    letter = F.col("ink").between(0.12, 0.55) & (F.col("br_bl") <= 0.83) & (F.col("top") >= 0.15)
    return kept.withColumn("r_verified", letter)


def bisector_circles(table: DataFrame, runs: DataFrame, radii=(15.0, 28.0), cell: int = 4, least: int = 80) -> DataFrame:
    """Circles voted by random point triplets of each component, clustered on a grid."""

    def vote(key, g: pd.DataFrame) -> pd.DataFrame:
        pts = np.concatenate([np.stack([np.arange(a, b), np.full(b - a, y)], 1) for y, a, b in zip(g["y"], g["x0"], g["x1"])])
        c = K.circles_by_bisectors(pts, radii, seed=int(key[1]) % (1 << 32))
        return pd.DataFrame({"x": c[:, 0], "y": c[:, 1], "r": c[:, 2]})

    big = table.filter("area >= 12").select(F.col("chart_id").alias("_c"), F.col("label").alias("_l"))
    own = runs.join(big, (F.col("chart_id") == F.col("_c")) & (F.col("label") == F.col("_l"))).select(*runs.columns)
    votes = written(own.groupBy("chart_id", "label").applyInPandas(vote, "x double, y double, r double"))
    return suppression.grid_clusters(votes, cell, least)


def layers(image_tiles: DataFrame, families=color.FAMILIES) -> DataFrame:
    """(chart_id, family, percent): coverage of the colour families; a pixel may count in several."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a = tiles.pixels(r)[r.y0 - r.py : r.y1 - r.py, r.x0 - r.px : r.x1 - r.px]
                colours, n = np.unique(a.reshape(-1, a.shape[-1])[:, :3], axis=0, return_counts=True)
                rows += [(r.chart_id, *map(int, c), int(k)) for c, k in zip(colours, n)]
            yield pd.DataFrame(rows, columns=["chart_id", "r", "g", "b", "n"])

    counts = image_tiles.mapInPandas(run, "chart_id string, r int, g int, b int, n long").groupBy("chart_id", "r", "g", "b").agg(F.sum("n").alias("n"))
    counts = counts.select("chart_id", "n", color.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    flags = color.family_flags(F.col("c"), families)
    total = counts.groupBy("chart_id").agg(F.sum("n").alias("total"))
    per = counts.select("chart_id", "n", F.explode(flags).alias("family")).groupBy("chart_id", "family").agg(F.sum("n").alias("n"))
    return per.join(total, "chart_id").select("chart_id", "family", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def family_mask(image_tiles: DataFrame, family: color.HsvRange) -> DataFrame:
    """Mask tiles of one colour family."""

    def kernel(a):
        c = a[..., :3].astype(np.float64) / 255.0
        v, d = c.max(-1), c.max(-1) - c.min(-1)
        safe = np.where(d == 0, 1, d)
        r, g, b = c[..., 0], c[..., 1], c[..., 2]
        h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) / 6 % 1.0
        h, s = np.where(d == 0, 0, h), np.where(v == 0, 0, d / np.where(v == 0, 1, v))
        within = lambda z, bounds: (z >= bounds[0]) & (z <= bounds[1])
        hue = within(h, family.h) | (within(h, family.h2) if family.h2 else False)
        return hue & within(s, family.s) & within(v, family.v)

    return tiles.map_tiles(image_tiles, kernel)


def all_detections(parts: dict[str, DataFrame], radius: float = 18.0) -> DataFrame:
    """Bag union of detector outputs (id, x, y, score, type), dots that no other detector explains becoming spot elevations, then one global suppression."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("type", F.lit(kind)) for kind, df in parts.items() if kind != "dot"])
    if "dot" in parts:
        free = spatial.radius_join(parts["dot"], every, radius, how="left_anti")
        every = every.unionByName(free.withColumn("type", F.lit("spot_elevation")), allowMissingColumns=True)
    return suppression.greedy_nms(written(every), radius)


def georeferenced(detections: DataFrame, gcps: DataFrame, score: str = "score") -> DataFrame:
    """Detections with lon, lat and tier."""
    return fit.georeference(detections, fit.fit_plane(gcps)).withColumn("tier", rules.tier(F.col(score)))


def elevations(georef: DataFrame, image_tiles: DataFrame, read_text: Callable[[np.ndarray], str], keep=("HIGH", "MEDIUM")) -> DataFrame:
    """Trusted detections with the elevations that ``read_text`` reads in the patch above them (no reader is bundled). Tiles need a halo of 60."""
    trusted = georef.filter(F.col("tier").isin(*keep)).select(F.col("chart_id").alias("_c"), "id", "x", "y")
    own = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    met = image_tiles.join(trusted, (F.col("chart_id") == F.col("_c")) & own)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a, y, x = tiles.pixels(r), r.y - r.py, r.x - r.px
                grey = a if a.ndim == 2 else (K.to_grey(a) * 255).astype(np.uint8)
                patch = grey[max(0, y - 40) : max(0, y - 2), max(0, x - 35) : x + 55]
                rows.append((r.id, read_text(K.patch_for_text(patch)) if patch.size else ""))
            yield pd.DataFrame(rows, columns=["id", "text"])

    read = met.mapInPandas(run, "id long, text string").withColumn("e", T.elevations(F.col("text")))
    return read.select("id", F.col("e.msl").alias("elevation_msl_ft"), F.col("e.agl").alias("elevation_agl_ft"))


def document_chain(blocks: DataFrame, symbols: DataFrame, paths: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, violations) of charts' texts, symbols and drawings; ``verified`` marks known waypoints."""
    found = written(entities.extract(blocks, symbols, paths))
    if known is not None:
        from chartstone.operators.changes import flag_known

        found = flag_known(found, known, "name")
    return found, entities.violations(found)


def label_symbols(symbols: DataFrame, blocks: DataFrame, radius: float = 60.0) -> DataFrame:
    """Symbols (id, x, y, ...) with the nearest text block within radius as ``label``."""
    near = spatial.nearest_within(symbols, blocks.select("id", "x", "y"), radius)
    names = blocks.select(F.col("id").alias("_b"), F.col("text").alias("label"))
    return near.join(names, F.col("near_id") == F.col("_b"), "left").drop("_b", "near_id", "dist")


def classify(spark: SparkSession, payload: DataFrame, model: Callable[[str], str] | None = None, schema: str = "category string, name string") -> DataFrame | None:
    """Entities by an outside text model, two attempts a payload; None without a model, for the caller to fall back to rules."""
    if model is None:
        return None

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                answer = None
                for _ in range(2):
                    try:
                        answer = model(r.payload)
                        break
                    except OSError:
                        continue
                out.append((r.chart_id, answer))
            yield pd.DataFrame(out, columns=["chart_id", "answer"])

    read = payload.select("chart_id", "payload").mapInPandas(run, "chart_id string, answer string")
    fields = ",".join(":".join(f.split()) for f in schema.split(", "))
    return read.select("chart_id", F.explode(F.from_json(T.strip_fence(F.col("answer")), f"array<struct<{fields}>>")).alias("e")).select("chart_id", "e.*")
