"""The driver's tables seen as chart objects, in Spark and as CTEs for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartstone.session import load

DET = "det AS (SELECT event_id AS id, user_id * 8 + event_id % 8 AS x, CAST(floor(value * 10) AS BIGINT) AS y, value AS score, event_type AS type FROM events)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") * 8 + F.col("event_id") % 8).alias("x"),
        F.floor(F.col("value") * 10).cast("long").alias("y"),
        F.col("value").alias("score"),
        F.col("event_type").alias("type"),
    )


BLOB = """blob AS (SELECT l_orderkey * 10 + l_linenumber AS id, 1 + (l_partkey * 37 + l_linenumber * 11) % 700 AS area,
  1 + (l_orderkey * 13 + l_partkey * 7) % 120 AS h, 1 + (l_suppkey * 5 + l_linenumber * 3) % 40 AS w,
  l_linenumber - 5 AS euler, l_discount * 2 AS density, l_returnflag AS flag FROM lineitem),
shape AS (SELECT *, greatest(h, w) AS max_dim, least(h, w) AS min_dim, CAST(greatest(h, w) AS DOUBLE) / least(h, w) AS aspect,
  CAST(area AS DOUBLE) / (2 * (h + w)) AS chord, least(CAST(area AS DOUBLE) / (h * w), 1.0::DOUBLE) AS solidity, (area % 100) / 100.0::DOUBLE AS eccentricity FROM blob)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by features that reach every class of the rules."""
    c = F.col
    b = load(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"),
        (1 + (c("l_partkey") * 37 + c("l_linenumber") * 11) % 700).alias("area"),
        (1 + (c("l_orderkey") * 13 + c("l_partkey") * 7) % 120).alias("h"),
        (1 + (c("l_suppkey") * 5 + c("l_linenumber") * 3) % 40).alias("w"),
        (c("l_linenumber") - 5).alias("euler"),
        (c("l_discount") * 2).alias("density"),
        c("l_returnflag").alias("flag"),
    )
    return b.withColumns(
        {
            "max_dim": F.greatest("h", "w"),
            "min_dim": F.least("h", "w"),
            "aspect": F.greatest("h", "w") / F.least("h", "w"),
            "chord": c("area") / (2 * (c("h") + c("w"))),
            "solidity": F.least(c("area") / (c("h") * c("w")), F.lit(1.0)),
            "eccentricity": (c("area") % 100) / F.lit(100.0),
        }
    )


PIXEL = "pixel AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 256 AS r, l_partkey % 256 AS g, (l_suppkey * 7 + l_linenumber * 31) % 256 AS b, l_linestatus AS band FROM lineitem)"
HSV = """nrm AS (SELECT *, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM pixel),
vd AS (SELECT *, greatest(rr, gg, bb) AS v, greatest(rr, gg, bb) - least(rr, gg, bb) AS d FROM nrm),
hsv AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s,
  CASE WHEN d = 0 THEN 0 ELSE (CASE WHEN v = rr THEN (gg - bb) / d WHEN v = gg THEN 2 + (bb - rr) / d ELSE 4 + (rr - gg) / d END) / 6 END AS h0 FROM vd),
colour AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END AS h FROM hsv)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return load(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"),
        (c("l_orderkey") % 256).alias("r"),
        (c("l_partkey") % 256).alias("g"),
        ((c("l_suppkey") * 7 + c("l_linenumber") * 31) % 256).alias("b"),
        c("l_linestatus").alias("band"),
    )
