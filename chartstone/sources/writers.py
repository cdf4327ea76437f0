"""Sinks: pictures, JSON, CSV, GeoJSON, run logs, documents. All take zero rows."""

from __future__ import annotations

import json
import struct
import time
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_png(a: np.ndarray, level: int = 3) -> bytes:
    """Grey, RGB or mask (True: 255) to PNG."""
    a = a.astype(np.uint8) * 255 if a.dtype == bool else a.astype(np.uint8)
    h, w = a.shape[:2]
    colour = {1: 0, 3: 2, 4: 6}[1 if a.ndim == 2 else a.shape[2]]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def tiles_as_png(tiles: DataFrame) -> DataFrame:
    """(chart_id, ty, tx, png): each tile's inner box as a PNG; write it with any sink."""
    from chartstone.operators.tiles import pixels

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(r.chart_id, r.ty, r.tx, encode_png(pixels(r)[r.y0 - r.py : r.y1 - r.py, r.x0 - r.px : r.x1 - r.px])) for r in batch.itertuples()]
            yield pd.DataFrame(rows, columns=["chart_id", "ty", "tx", "png"])

    return tiles.mapInPandas(run, "chart_id string, ty int, tx int, png binary")


def features(df: DataFrame, lon: Column, lat: Column, properties: list[str]) -> DataFrame:
    """(feature): one GeoJSON feature a row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def geojson_features(df: DataFrame, tiers=("HIGH", "MEDIUM")) -> DataFrame:
    """Features of the trusted tiers; lon and lat leave the properties."""
    keep = df.filter(F.col("tier").isin(*tiers)) if tiers else df
    return features(keep, F.col("lon"), F.col("lat"), [c for c in df.columns if c not in ("lon", "lat")])


def pixel_features(df: DataFrame) -> DataFrame:
    """Features in pixel coordinates, y up."""
    return features(df, F.col("x").cast("double"), (-F.col("y")).cast("double"), [c for c in df.columns if c not in ("x", "y")])


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header in every file, and one file with a header for zero rows."""
    df.write.mode("overwrite").csv(path, header=True)


def write_features(df: DataFrame, path: str) -> None:
    """One feature a line: collections of any size stay distributed."""
    df.write.mode("overwrite").text(path)


def feature_collection(df: DataFrame, limit: int = 100_000) -> str:
    """One document for a small result; more features than ``limit`` is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} features: write them as lines")
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(r.feature) for r in rows]})


def run_log(spark: SparkSession, stage: str, params: dict, stats: dict, notes: list[str], began: float) -> DataFrame:
    """One row about a run."""
    text = lambda d: {str(k): json.dumps(v) for k, v in d.items()}
    schema = "stage string, params map<string,string>, stats map<string,string>, notes array<string>, elapsed_sec double"
    return spark.createDataFrame([(stage, text(params), text(stats), notes, round(time.time() - began, 2))], schema)


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, min, max, mean) in one aggregation."""
    aggs = [f(F.col(c)).alias(f"{c}_{n}") for c in columns for n, f in (("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg))]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"{c}_n").alias("n"), *[F.col(f"{c}_{n}").cast("double").alias(n) for n in ("min", "max", "mean")]) for c in columns]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def entity_document(entities: DataFrame, categories: list[str], group: str = "chart_id") -> DataFrame:
    """(group, doc): one JSON document for each chart, with an array for every category, empty ones included."""
    arrays = [F.collect_list(F.when(F.col("category") == c, F.struct("name", "value", "lat", "lon"))).alias(c) for c in categories]
    return entities.groupBy(group).agg(*arrays).select(group, F.to_json(F.struct(*categories)).alias("doc"))
