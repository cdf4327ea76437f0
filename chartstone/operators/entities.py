"""Entities from text blocks, symbols and vector paths by rules; validation as violations.

All extractors give one long table (chart_id, category, name, value, kind, lat, lon, ord); documents are assembled at the sink.
Blocks: chart_id, ord, text, lat, lon. Symbols: chart_id, ord, type, label, lat, lon. Paths: chart_id, ord, points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartstone.functions import geometry as G
from chartstone.functions import text as T
from chartstone.operators.changes import keep_first_by

CATEGORIES = ["waypoints", "frequencies", "holding_patterns", "routes", "nhp", "obstacles", "heli_routes", "other"]
#: Blocks whose latitudes differ by less stand in one row.
ROW_BAND = 0.002


def _rows(df: DataFrame, category: str, name, value=None, kind=None, lat="lat", lon="lon") -> DataFrame:
    col = lambda x, t: F.lit(None).cast(t) if x is None else (x if isinstance(x, Column) else F.col(x)).cast(t)
    return df.select(
        "chart_id", F.lit(category).alias("category"), col(name, "string").alias("name"), col(value, "double").alias("value"), col(kind, "string").alias("kind"),
        col(lat, "double").alias("lat"), col(lon, "double").alias("lon"), F.col("ord").cast("long").alias("ord"),
    )


def row_mates(blocks: DataFrame, asking: DataFrame) -> DataFrame:
    """asking (chart_id, ord, lat) with each block of its row: r_ord, r_text. A band join inside each chart, self included."""
    cell = lambda c: F.floor(F.col(c) / ROW_BAND)
    a = asking.select("chart_id", "ord", F.coalesce("lat", F.lit(0.0)).alias("lat")).withColumn("c", F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1)))
    b = blocks.select(F.col("chart_id").alias("_chart"), F.col("ord").alias("r_ord"), F.col("text").alias("r_text"), F.coalesce("lat", F.lit(0.0)).alias("r_lat")).withColumn("_c", cell("r_lat"))
    return a.join(b, (F.col("chart_id") == F.col("_chart")) & (F.col("c") == F.col("_c")) & (F.abs(F.col("lat") - F.col("r_lat")) < ROW_BAND))


def frequencies(blocks: DataFrame) -> DataFrame:
    """Each frequency value once (first block), with the service and call sign of its row."""
    hits = blocks.select("chart_id", "ord", "lat", "lon", F.posexplode(F.regexp_extract_all("text", F.lit(T.FREQUENCY), 1)).alias("k", "t"))
    hits = hits.withColumn("mhz", F.col("t").cast("double"))
    first = keep_first_by(hits, ["chart_id", "mhz"], ["ord", "k"])
    mates = row_mates(blocks, first.select("chart_id", "ord", "lat").distinct())
    words = [w for w, _ in T.SERVICES]
    sign = F.trim("r_text")
    is_sign = (sign == F.upper(sign)) & sign.rlike("[A-Z]") & F.length(sign).between(2, 10) & ~sign.rlike(T.FREQUENCY)
    found = mates.groupBy("chart_id", "ord").agg(
        F.min(F.when(is_sign, F.struct("r_ord", sign.alias("sign")))).alias("s"),
        *[F.max(F.contains(F.upper("r_text"), F.lit(w))).alias(f"w{i}") for i, w in enumerate(words)],
    )
    kind = F.coalesce(*[F.when(F.col(f"w{i}"), F.lit(s)) for i, (_, s) in enumerate(T.SERVICES)], F.lit("other"))
    found = found.select(F.col("chart_id").alias("_chart"), F.col("ord").alias("_ord"), F.col("s.sign").alias("sign"), kind.alias("service"))
    joined = first.join(found, (F.col("chart_id") == F.col("_chart")) & (F.col("ord") == F.col("_ord")), "left")
    return _rows(joined, "frequencies", "sign", "mhz", "service")


def waypoints(blocks: DataFrame, symbols: DataFrame) -> DataFrame:
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("UNKNOWN"))
    drawn = symbols.filter((F.col("type") == "waypoint") & ~label.isin(*T.NOT_WAYPOINTS))
    written = keep_first_by(blocks.filter(T.is_waypoint(F.col("text"))).withColumn("t", F.trim("text")), ["chart_id", "t"], ["ord"])
    return _rows(drawn.withColumn("n", label), "waypoints", "n").unionByName(_rows(written, "waypoints", "t"))


def obstacles(blocks: DataFrame) -> DataFrame:
    height = F.nullif(F.regexp_extract("text", r"\b" + T.ALTITUDE, 1), F.lit("")).cast("double")
    named = blocks.filter(F.size(F.array_intersect(F.regexp_extract_all(F.upper("text"), F.lit("([A-Z]+)"), 1), F.array(*map(F.lit, T.OBSTACLE_WORDS)))) > 0)
    bare = blocks.withColumn("n", T.obstacle_number(F.col("text"))).filter("n is not null")
    at = [F.bround(F.coalesce(c, F.lit(0.0)), 3) for c in ("lat", "lon")]
    bare = keep_first_by(bare, ["chart_id", *at], ["ord"])
    return _rows(named, "obstacles", F.trim("text"), height).unionByName(_rows(bare, "obstacles", F.format_string("Height %d ft", "n"), "n"))


def holdings(blocks: DataFrame, symbols: DataFrame) -> DataFrame:
    track = F.nullif(F.regexp_extract("text", T.HEADING, 1), F.lit("")).cast("double")
    return _rows(symbols.filter("type = 'holding'"), "holding_patterns", "label").unionByName(_rows(blocks.filter(F.col("text").rlike(T.HOLDING)), "holding_patterns", F.trim("text"), track))


def routes(blocks: DataFrame, paths: DataFrame, least: float = 100.0) -> DataFrame:
    names = blocks.select("chart_id", "ord", "lat", "lon", F.posexplode(F.regexp_extract_all("text", F.lit(T.ROUTE), 1)).alias("k", "n"))
    named = keep_first_by(names, ["chart_id", "n"], ["ord", "k"])
    long = paths.filter((F.size("points") >= 2) & (G.path_length(F.col("points")) >= least))
    a, b = F.element_at("points", 1), F.element_at("points", -1)
    drawn = long.withColumn("track", F.bround(G.bearing(b["x"] - a["x"], b["y"] - a["y"]), 1))
    return _rows(named, "routes", "n").unionByName(_rows(drawn, "routes", None, "track", F.lit("vector_path"), None, None))


def reporting_points(blocks: DataFrame, symbols: DataFrame) -> DataFrame:
    drawn = symbols.filter("type = 'nhp'").withColumn("n", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("UNKNOWN")))
    return _rows(drawn, "nhp", "n").unionByName(_rows(blocks.filter(F.col("text").rlike(T.REPORTING)), "nhp", F.trim("text")))


def heli_routes(blocks: DataFrame, symbols: DataFrame) -> DataFrame:
    label = F.coalesce("label", F.lit(""))
    drawn = symbols.filter((F.col("type") == "helipad") & T.is_helipad_label(label)).withColumn("n", label)
    words = F.split(F.upper(F.trim("text")), r"\s+")
    written = blocks.filter(F.arrays_overlap(words, F.array(*map(F.lit, T.HELI_WORDS))))
    return _rows(drawn, "heli_routes", "n", lat=None, lon=None).unionByName(_rows(written, "heli_routes", F.trim("text"), lat=None, lon=None))


def airport(blocks: DataFrame) -> DataFrame:
    """ICAO codes, elevation, runway lines and the reference point, under ``other``."""
    hits = blocks.select("chart_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(T.ICAO), 1)).alias("k", "n"))
    codes = keep_first_by(hits, ["chart_id", "n"], ["ord", "k"])
    lines = keep_first_by(blocks.filter(F.col("text").rlike(T.RUNWAY)).withColumn("n", F.trim("text")), ["chart_id", "n"], ["ord"])
    first = lambda value, name: blocks.withColumn("_v", value).groupBy("chart_id").agg(F.min(F.when(F.col("_v").isNotNull(), F.struct("ord", F.col("_v").alias("v")))).alias("m")).filter("m is not null").select("chart_id", F.col("m.ord").alias("ord"), F.col("m.v").alias(name))
    height = first(T.airport_elevation(F.col("text")), "ft")
    lat = first(T.dms_to_degrees(F.col("text"), T.LATITUDE), "lat")
    lon = first(T.dms_to_degrees(F.col("text"), T.LONGITUDE), "lon").drop("ord")
    point = lat.join(lon, "chart_id")
    none = dict(lat=None, lon=None)
    return (
        _rows(codes, "other", "n", kind=F.lit("airport_icao"), **none)
        .unionByName(_rows(height, "other", F.format_string("%d ft", "ft"), "ft", F.lit("airport_elevation_ft"), **none))
        .unionByName(_rows(lines, "other", "n", kind=F.lit("runway_info")))
        .unionByName(_rows(point, "other", F.format_string("LAT %.5f LON %.5f", "lat", "lon"), kind=F.lit("airport_reference_point")))
    )


def extract(blocks: DataFrame, symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """All entities, exact repeats dropped (position in the input aside)."""
    parts = [
        frequencies(blocks), waypoints(blocks, symbols), obstacles(blocks), holdings(blocks, symbols), routes(blocks, paths),
        reporting_points(blocks, symbols), heli_routes(blocks, symbols), airport(blocks),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return keep_first_by(every, ["chart_id", "category", "name", "value", "kind", "lat", "lon"], ["ord"])


def airport_object(entities: DataFrame) -> DataFrame:
    """(chart_id, icao, elevation_ft, lat, lon, runways): from the ``other`` rows; the last of each kind wins."""
    o = entities.filter("category = 'other'")
    last = lambda kind, c: F.max_by(c, F.when(F.col("kind") == kind, F.col("ord")))
    got = o.groupBy("chart_id").agg(
        last("airport_icao", "name").alias("icao"), last("airport_elevation_ft", "value").alias("elevation_ft"),
        last("airport_reference_point", "lat").alias("lat"), last("airport_reference_point", "lon").alias("lon"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "runway_info", F.col("name")))).alias("runways"),
    )
    return got.filter("icao is not null")


def violations(e: DataFrame, vhf=(108.0, 137.975), uhf=(225.0, 400.0), max_height: float = 99999.0) -> DataFrame:
    """(chart_id, severity, category, name, rule): a document is valid if it has no error."""
    c, v = F.col("category"), F.col("value")
    placed = c.isin("waypoints", "nhp", "holding_patterns")
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    checks = [
        ("warning", "missing_value", (c == "frequencies") & v.isNull()),
        ("error", "frequency_range", (c == "frequencies") & ~(v.between(*vhf) | v.between(*uhf))),
        ("warning", "missing_coordinates", (placed | (c == "obstacles")) & missing),
        ("error", "latitude_range", placed & ~missing & ~F.col("lat").between(-90, 90)),
        ("error", "longitude_range", placed & ~missing & ~F.col("lon").between(-180, 180)),
        ("error", "height_limit", (c == "obstacles") & (v > max_height)),
        ("error", "track_range", c.isin("holding_patterns", "routes") & ~v.between(0, 360)),
        ("warning", "altitude_range", (c == "heli_routes") & ~v.between(0, 50000)),
        ("error", "missing_name", c.isin("waypoints", "nhp") & F.col("name").isNull()),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, cond in checks]))
    return e.select("chart_id", F.explode(found).alias("f"), "category", "name").select("chart_id", "f.severity", "category", "name", "f.rule")


def category_counts(e: DataFrame) -> DataFrame:
    """(category, n), every category present."""
    every = e.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    n = e.groupBy("category").agg(F.count("*").alias("n"))
    return every.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
