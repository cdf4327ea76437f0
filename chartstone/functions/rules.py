"""Rule cascades as single CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failure(rules: Sequence[tuple[str, Column]], passed: str = "kept") -> Column:
    """Name of the first rule whose condition (of rejection) holds; conditions that are null don't reject."""
    out = None
    for name, reject in rules:
        out = F.when(reject, name) if out is None else out.when(reject, name)
    return out.otherwise(passed)


def failure_names(rules: Sequence[tuple[str, Column]], joint: str = " | ") -> Column:
    """All rules that reject, joined; '' if none does."""
    return F.concat_ws(joint, *[F.when(reject, F.lit(name)) for name, reject in rules])


def histogram(df: DataFrame, reason: str, names: Sequence[str]) -> DataFrame:
    """(reason, n) with every name, zero if it never occurs; names is a short literal list."""
    spark = df.sparkSession
    every = spark.createDataFrame([(n,) for n in names], f"{reason} string")
    counts = df.groupBy(reason).agg(F.count("*").alias("n"))
    return every.join(counts, reason, "left").select(reason, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def tier(score: Column) -> Column:
    """Confidence tier; a null score is MARGINAL."""
    return F.when(score >= 0.90, "HIGH").when(score >= 0.75, "MEDIUM").when(score >= 0.55, "LOW").otherwise("MARGINAL")


def obstacle_cascade(legend, area, w, h, aspect, solidity, eccentricity) -> list[tuple[str, Column]]:
    """Obstacle blobs at 150 dpi: position, area, size, aspect, solidity, eccentricity, in this order."""
    return [
        ("legend", legend),
        ("area", ~area.between(100, 400)),
        ("size", ~w.between(12, 36) | ~h.between(14, 40)),
        ("aspect", ~aspect.between(0.70, 1.40)),
        ("solidity", ~solidity.between(0.45, 0.65)),
        ("eccentricity", eccentricity >= 0.70),
    ]


def colour_obstacle_cascade(area, w, h, aspect, solidity, eccentricity) -> list[tuple[str, Column]]:
    return [
        ("area", ~area.between(65, 240)),
        ("size", ~w.between(12, 26) | ~h.between(12, 26)),
        ("aspect", ~aspect.between(0.78, 1.25)),
        ("solidity", ~solidity.between(0.50, 0.62)),
        ("eccentricity", eccentricity >= 0.85),
    ]


def symbol_cascade(area, max_dim, min_dim, chord, solidity, euler, density, boosted=None, density_at=0.10, chord_at=1.20, size_gate=80) -> Column:
    """Fate of a component of the symbol mask: noise, long_line, thin, density, chord, reinstated, size_gate or kept.

    ``boosted`` components (their centre is a correlation peak) are reinstated where density or chord would
    reject them, and pass the size gate. ``size_gate=None`` leaves the gate out (background removal).
    """
    boosted = F.lit(False) if boosted is None else F.coalesce(boosted, F.lit(False))
    short = F.greatest(min_dim, F.lit(1))
    dense = (area < 100) & (density > density_at)
    flat = (max_dim > 25) & (chord < chord_at) & (solidity < 0.45) & (euler >= 0)
    rules = [
        ("noise", area <= 3),
        ("long_line", (max_dim / short > 50) & (max_dim > 50)),
        ("thin", (short == 1) & (area < 20)),
        ("reinstated", (dense | flat) & boosted),
        ("density", dense),
        ("chord", flat),
    ]
    if size_gate is not None:
        rules.append(("size_gate", (max_dim > size_gate) & ~boosted))
    return first_failure(rules)


def layer_tree(area, max_dim, min_dim, aspect, chord, solidity, euler, density) -> Column:
    """Layer of a component, first match wins."""
    arc = (max_dim > 25) & (chord < 1.25) & (solidity < 0.45)
    return first_failure(
        [
            ("NOISE", area <= 3),
            ("GRID", ((aspect > 50) & (max_dim > 50)) | ((min_dim == 1) & (area < 15))),
            ("TEXT", (euler < -3) & (area < 400)),
            ("AIRSPACE", ((density > 0.13) & (area < 100)) | (arc & (aspect <= 6))),
            ("AIRWAY", arc),
            ("TOPO", (max_dim > 60) & (solidity > 0.02) & (chord < 1.5)),
            ("SYMBOL", ((area > 300) & (max_dim < 80) & (solidity > 0.3)) | ((area < 200) & (max_dim < 40) & (aspect < 6))),
        ],
        passed="TEXT",
    )


@dataclass(frozen=True)
class LayerRule:
    """Bounds of one layer; None is open. Layers are not exclusive."""

    layer: str
    area: tuple[float | None, float | None] = (None, None)
    solidity: tuple[float | None, float | None] = (None, None)
    eccentricity: tuple[float | None, float | None] = (None, None)
    max_dim: tuple[float | None, float | None] = (None, None)
    aspect: tuple[float | None, float | None] = (None, None)


#: Layer bounds (fixed values).
LAYER_RULES = (
    LayerRule("airport", (20, 2500), (0.40, None), (None, 0.90)),
    LayerRule("airport_large", (2500, 50000), (0.25, None), (None, 0.98)),
    LayerRule("vor", (200, 2000), (0.20, None), (None, 0.80)),
    LayerRule("vortac", (150, 800), (0.10, None), (None, 0.70)),
    LayerRule("dme", (30, 600), (0.55, None), aspect=(0.6, 1.6)),
    LayerRule("airspace", (50, None), eccentricity=(0.80, None), max_dim=(40, None)),
    LayerRule("special_use", (200, None), (None, 0.40)),
    LayerRule("airway", solidity=(None, 0.30), eccentricity=(0.95, None), max_dim=(100, None)),
    LayerRule("text", (4, 500), (0.25, None), aspect=(0.3, 4.0)),
)


def layer_rules_table(spark, rules=LAYER_RULES) -> DataFrame:
    """The rules as rows, so that tuning is data."""
    features = ("area", "solidity", "eccentricity", "max_dim", "aspect")
    rows = [(r.layer, *[None if v is None else float(v) for f in features for v in getattr(r, f)]) for r in rules]
    return spark.createDataFrame(rows, "layer string, " + ", ".join(f"{f}_min double, {f}_max double" for f in features))


def apply_layer_rules(df: DataFrame, rules=LAYER_RULES) -> DataFrame:
    """df with ``layer``, a row for each layer whose bounds a component meets; one pass, no join."""

    def meets(r: LayerRule) -> Column:
        out = F.lit(True)
        for f in ("area", "solidity", "eccentricity", "max_dim", "aspect"):
            low, high = getattr(r, f)
            out = out & (F.col(f) >= low) if low is not None else out
            out = out & (F.col(f) <= high) if high is not None else out
        return out

    layers = F.array_compact(F.array(*[F.when(meets(r), F.lit(r.layer)) for r in rules]))
    return df.withColumn("layer", F.explode(layers))


def window_gates(score, x, width, blue_fraction, overlap, least_score=0.65, legend=0.18, least_blue=0.08, least_overlap=0.5) -> list[tuple[str, Column]]:
    """Gates of a sliding-window candidate, in order: correlation, legend strip, share of blue pixels, template overlap."""
    return [
        ("score", score < least_score),
        ("legend", x < F.floor(width * legend)),
        ("colour", blue_fraction < least_blue),
        ("overlap", overlap < least_overlap),
    ]


def interior_tests(count, eccentricity, largest, disk, most=3, most_eccentric=0.96, most_filled=0.45) -> dict[str, Column]:
    """Tests of the blobs inside a ring, true if passed: how many (one at least), the largest one's eccentricity, and its share of the disk."""
    some = count > 0
    return {"passes_a": some & (count <= most), "passes_b": some & (eccentricity < most_eccentric), "passes_c": some & (largest / disk <= most_filled)}


def interior_reason(count, eccentricity, largest, disk) -> Column:
    """The figures of the interior tests that failed, joined; '' if all passed."""
    t = interior_tests(count, eccentricity, largest, disk)
    figures = (("passes_a", F.format_string("cc=%d", count)), ("passes_b", F.format_string("ecc=%.2f", eccentricity)), ("passes_c", F.format_string("bf=%.2f", largest / disk)))
    return F.concat_ws(" | ", *[F.when(~t[name], text) for name, text in figures])


def circle_class(radius: Column, annulus: Column, inner: Column, scale: float = 1.0) -> Column:
    """Kind of a detected circle: large ones by the ink of the ring, small ones by the ink inside."""
    large = radius >= int(70 * scale)
    return F.when(large, F.when(annulus > 0.35, "vor").otherwise("class_d")).otherwise(F.when(inner > 0.08, "airport_civil").otherwise("ndb"))


def residual_class(aspect, log_area, circularity, solidity, euler) -> Column:
    """Kind of a shape that no detector explained; null if no rule fits."""
    inside = lambda c, low, high: (c > low) & (c < high)  # noqa: E731 - open bounds
    return (
        F.when((circularity > 0.80) & inside(log_area, 0.9, 2.1), "spot_elevation")
        .when(inside(circularity, 0.30, 0.62) & (solidity > 0.88) & inside(aspect, 0.55, 1.20), "waypoint")
        .when((aspect < 0.55) & (log_area > 1.8) & (solidity > 0.45), "parachute")
        .when((aspect > 1.6) & (log_area > 1.5) & (solidity > 0.50), "ultralight")
        .when(inside(circularity, 0.65, 0.85) & (euler < -0.5) & inside(log_area, 1.8, 2.8), "ndb")
    )
