"""Least squares as aggregates, and georeferencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilometres of one degree of latitude (fixed value).
KM_PER_DEGREE = 111.0


def fit_plane(gcps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (per group): lon = a + b*px + c*py and lat = d + e*px + f*py by centred normal equations, in one aggregation."""
    cov = lambda u, v: F.covar_pop(u, v)
    sums = gcps.groupBy(*(by or [])).agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("px", "py", "lon", "lat")],
        F.var_pop("px").alias("xx"), F.var_pop("py").alias("yy"), cov("px", "py").alias("xy"),
        cov("px", "lon").alias("x_lon"), cov("py", "lon").alias("y_lon"), cov("px", "lat").alias("x_lat"), cov("py", "lat").alias("y_lat"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    safe = F.nullif(det, F.lit(0.0))
    slope_x = lambda z: (F.col(f"x_{z}") * F.col("yy") - F.col(f"y_{z}") * F.col("xy")) / safe
    slope_y = lambda z: (F.col(f"y_{z}") * F.col("xx") - F.col(f"x_{z}") * F.col("xy")) / safe
    at0 = lambda z: F.col(f"m_{z}") - slope_x(z) * F.col("m_px") - slope_y(z) * F.col("m_py")
    return sums.select(
        *(by or []), at0("lon").alias("a"), slope_x("lon").alias("b"), slope_y("lon").alias("c"), at0("lat").alias("d"), slope_x("lat").alias("e"), slope_y("lat").alias("f")
    )


def georeference(df: DataFrame, model: DataFrame, x: str = "x", y: str = "y", on: list[str] | None = None) -> DataFrame:
    """df with lon and lat. A model is one row for a chart: broadcast where it is a single one, joined by key otherwise."""
    lon = F.col("a") + F.col("b") * F.col(x) + F.col("c") * F.col(y)
    lat = F.col("d") + F.col("e") * F.col(x) + F.col("f") * F.col(y)
    if on:
        joined = df.join(model, on)
    else:
        row = model.first()  # six numbers
        names = "abcdef"
        joined = df.withColumns({n: F.lit(row[n]) for n in names})
    return joined.withColumns({"lon": lon, "lat": lat}).drop(*"abcdef")


def error_km(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Distance on a local plane."""
    return F.hypot((lon - lon0) * KM_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * KM_PER_DEGREE)


def reprojection(gcps: DataFrame, model: DataFrame) -> DataFrame:
    """One row: mean_error_km and rms_km of the control points."""
    fitted = georeference(gcps.select("px", "py", F.col("lon").alias("lon0"), F.col("lat").alias("lat0")), model, "px", "py")
    e = error_km(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    return fitted.agg(F.avg(e).alias("mean_error_km"), F.sqrt(F.avg(e * e)).alias("rms_km"))


def fit_axis(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(slope, intercept) of y over x."""
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def transform_ladder(pages: DataFrame, candidates: list[str]) -> DataFrame:
    """pages with ``transform`` and its ``source``: the first candidate column (a struct) that is not null, in order of precedence."""
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in candidates])
    return pages.withColumns({"transform": F.coalesce(*[F.col(c) for c in candidates]), "source": source})
