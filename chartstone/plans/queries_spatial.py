"""Queries over detections: georeferencing, tiles, joins, suppression, clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chartstone.functions import geometry as G
from chartstone.functions import rules
from chartstone.operators import fit, ordering, spatial, suppression, tiles
from chartstone.operators.medians import medians
from chartstone.operators.tables import written
from chartstone.plans.registry import query
from chartstone.plans.views import DET, detections
from chartstone.session import load
from chartstone.sources import writers

#: Control points px, py, lon, lat at 150 dpi (fixed values).
GCPS = ((1512.0, 0.0, -79.0, 40.0), (8385.0, 0.0, -72.0, 40.0), (1512.0, 6173.0, -79.0, 36.0), (8385.0, 6173.0, -72.0, 36.0))
_LON = "(-79 - 1512 * (7.0::DOUBLE / 6873) + x * (7.0::DOUBLE / 6873))"
_LAT = "(40 - y * (4.0::DOUBLE / 6173))"
_TIER = "CASE WHEN {s} >= 0.90 THEN 'HIGH' WHEN {s} >= 0.75 THEN 'MEDIUM' WHEN {s} >= 0.55 THEN 'LOW' ELSE 'MARGINAL' END"
_SCORE = "(id % 100) / 100.0::DOUBLE"


def gcps(spark):
    return spark.createDataFrame(list(GCPS), "px double, py double, lon double, lat double")


def _placed(spark, sf):
    d = detections(spark, sf).withColumn("conf", (F.col("id") % 100) / F.lit(100.0))
    return fit.georeference(d, fit.fit_plane(gcps(spark))).withColumn("tier", rules.tier(F.col("conf")))


@query("georef_tier_counts", f"WITH {DET} SELECT {_TIER.format(s=_SCORE)} AS tier, count(*) AS n, round(avg({_LON}), 6) AS mean_lon, round(avg({_LAT}), 6) AS mean_lat FROM det GROUP BY 1")
def georef_tier_counts(spark, sf):
    return _placed(spark, sf).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("lon"), 6).alias("mean_lon"), F.round(F.avg("lat"), 6).alias("mean_lat"))


@query(
    "georef_points_geojson",
    f"""WITH {DET} SELECT id, 'Point' AS kind, round({_LON}, 5) AS lon, round({_LAT}, 5) AS lat, {_TIER.format(s=_SCORE)} AS tier
    FROM det WHERE {_SCORE} >= 0.75""",
)
def georef_points_geojson(spark, sf):
    """Features are built as text, then read back: the sink's own output is what is compared."""
    f = writers.geojson_features(_placed(spark, sf).select("id", "tier", "lon", "lat"))
    got = F.from_json("feature", "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<id:long,tier:string>")
    at = lambda k: F.round(F.element_at("g.geometry.coordinates", k), 5)
    return f.select(got.alias("g")).select(F.col("g.properties.id").alias("id"), F.col("g.geometry.type").alias("kind"), at(1).alias("lon"), at(2).alias("lat"), F.col("g.properties.tier").alias("tier"))


@query(
    "reprojection_error",
    """WITH n AS (SELECT n_nationkey, 1000.0::DOUBLE + 100 * n_nationkey AS px, 50.0::DOUBLE * ((n_nationkey * 7) % 25) AS py FROM nation),
    g AS (SELECT px, py, -79 + px * 0.001 + (n_nationkey % 3) * 0.0005 AS lon, 40 - py * 0.0006 - (n_nationkey % 4) * 0.0004 AS lat FROM n),
    m AS (SELECT avg(px) mx, avg(py) my, avg(lon) mo, avg(lat) ma, var_pop(px) xx, var_pop(py) yy, covar_pop(px, py) xy, covar_pop(px, lon) xo, covar_pop(py, lon) yo, covar_pop(px, lat) xa, covar_pop(py, lat) ya FROM g),
    c AS (SELECT *, (xo * yy - yo * xy) / (xx * yy - xy * xy) AS b, (yo * xx - xo * xy) / (xx * yy - xy * xy) AS c, (xa * yy - ya * xy) / (xx * yy - xy * xy) AS e, (ya * xx - xa * xy) / (xx * yy - xy * xy) AS f FROM m),
    r AS (SELECT lon, lat, mo + b * (px - mx) + c * (py - my) AS flon, ma + e * (px - mx) + f * (py - my) AS flat FROM g, c),
    k AS (SELECT sqrt(pow((flon - lon) * 111 * cos(radians(lat)), 2) + pow((flat - lat) * 111, 2)) AS e FROM r)
    SELECT round(avg(e), 6) AS mean_error_km, round(sqrt(avg(e * e)), 6) AS rms_km FROM k""",
)
def reprojection_error(spark, sf):
    n = load(spark, sf, "nation").select("n_nationkey", (F.lit(1000.0) + 100 * F.col("n_nationkey")).alias("px"), (F.lit(50.0) * ((F.col("n_nationkey") * 7) % 25)).alias("py"))
    g = n.select("px", "py", (-79 + F.col("px") * 0.001 + (F.col("n_nationkey") % 3) * 0.0005).alias("lon"), (40 - F.col("py") * 0.0006 - (F.col("n_nationkey") % 4) * 0.0004).alias("lat"))
    got = fit.reprojection(g, fit.fit_plane(g))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query("axis_affine_fit", "SELECT o_orderpriority AS axis, round(regr_slope(o_totalprice, o_orderkey::DOUBLE), 6) AS slope, round(regr_intercept(o_totalprice, o_orderkey::DOUBLE), 4) AS intercept FROM orders GROUP BY 1")
def axis_affine_fit(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("axis"), F.col("o_orderkey").cast("double").alias("p"), "o_totalprice")
    return fit.fit_axis(o, "p", "o_totalprice", ["axis"]).select("axis", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(
    "tile_assign_halo",
    f"""WITH {DET}, t AS (SELECT id, x, y, unnest(range(floor((y - 32) / 256)::BIGINT, floor((y + 32) / 256)::BIGINT + 1)) AS ty FROM det),
    u AS (SELECT *, unnest(range(floor((x - 32) / 256)::BIGINT, floor((x + 32) / 256)::BIGINT + 1)) AS tx FROM t)
    SELECT tx, ty, count(*) AS n, count(*) FILTER (ty = floor(y / 256) AND tx = floor(x / 256)) AS owned FROM u
    WHERE y < (ty + 1) * 256 + 32 AND x < (tx + 1) * 256 + 32 GROUP BY 1, 2""",
)
def tile_assign_halo(spark, sf):
    return tiles.assign(detections(spark, sf), 256, 32).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.count_if("owner").alias("owned"))


@query("tile_inner_owner", f"WITH {DET} SELECT id, floor(x / 256)::BIGINT AS tx, floor(y / 256)::BIGINT AS ty, x - (floor(x / 256) * 256)::BIGINT AS local_x, y - (floor(y / 256) * 256)::BIGINT AS local_y FROM det")
def tile_inner_owner(spark, sf):
    t = tiles.assign(detections(spark, sf), 256, 32).filter("owner")
    return t.select("id", "tx", "ty", (F.col("x") - F.col("tx") * 256).alias("local_x"), (F.col("y") - F.col("ty") * 256).alias("local_y"))


@query("cell_first_dedup", f"WITH {DET} SELECT id, x, y FROM det QUALIFY row_number() OVER (PARTITION BY floor(x / 4), floor(y / 4) ORDER BY score DESC, id) = 1")
def cell_first_dedup(spark, sf):
    return spatial.first_per_cell(detections(spark, sf), 4, [F.desc("score"), "id"]).select("id", "x", "y")


@query(
    "nms_greedy",
    f"""WITH RECURSIVE {DET}, d AS (SELECT id, x, y, row_number() OVER (ORDER BY score DESC, id) AS k FROM det WHERE type = 'error'),
    g(k, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x BIGINT, y BIGINT)[]
      UNION ALL SELECT d.k, CASE WHEN len(list_filter(g.kept, lambda p: (p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y) < 324)) > 0 THEN g.kept
        ELSE list_append(g.kept, {{'id': d.id, 'x': d.x, 'y': d.y}}) END FROM g JOIN d ON d.k = g.k + 1)
    SELECT unnest(kept).id AS id FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)""",
)
def nms_greedy(spark, sf):
    return suppression.greedy_nms(written(detections(spark, sf).filter("type = 'error'")), 18.0).select("id")


@query(
    "nms_pair_radius",
    f"""WITH RECURSIVE {DET}, d AS (SELECT id, x, y, 10 + id % 3 * 4 AS r, row_number() OVER (ORDER BY score DESC, id) AS k FROM det WHERE type = 'signup'),
    g(k, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x BIGINT, y BIGINT, r BIGINT)[]
      UNION ALL SELECT d.k, CASE WHEN len(list_filter(g.kept, lambda p: sqrt((p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y)) < (p.r + d.r) / 2.0)) > 0 THEN g.kept
        ELSE list_append(g.kept, {{'id': d.id, 'x': d.x, 'y': d.y, 'r': d.r}}) END FROM g JOIN d ON d.k = g.k + 1)
    SELECT unnest(kept).id AS id FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)""",
)
def nms_pair_radius(spark, sf):
    """Circles suppress by the mean of both radii."""
    d = detections(spark, sf).filter("type = 'signup'").withColumn("r", 10 + F.col("id") % 3 * 4)
    return suppression.greedy_nms(written(d), 18.0, (F.col("l_r") + F.col("r_r")) / 2.0).select("id")


_BEATS = "((b.score > a.score) OR (b.score = a.score AND b.id < a.id))"


@query("nms_local_max", f"WITH {DET}, e AS (SELECT * FROM det) SELECT id, x, y FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE {_BEATS} AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 225)")
def nms_local_max(spark, sf):
    return suppression.local_maxima(detections(spark, sf), 15.0).select("id", "x", "y")


@query("grid_vote_peaks", f"WITH {DET} SELECT floor(x / 24)::BIGINT AS gx, floor(y / 24)::BIGINT AS gy, count(*) AS votes FROM det GROUP BY 1, 2 HAVING count(*) >= 8")
def grid_vote_peaks(spark, sf):
    return suppression.vote_grid(detections(spark, sf), 24, 8).select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "votes")


@query(
    "grid_cluster_median",
    f"""WITH {DET}, a AS (SELECT floor(x / 24)::BIGINT AS gx, floor(y / 24)::BIGINT AS gy, x, y FROM det), v AS (SELECT gx, gy, count(*) AS n FROM a GROUP BY 1, 2),
    p AS (SELECT * FROM v WHERE n >= 8 AND NOT EXISTS (SELECT 1 FROM v o WHERE abs(o.gx - v.gx) <= 1 AND abs(o.gy - v.gy) <= 1
      AND (o.n > v.n OR (o.n = v.n AND (o.gx < v.gx OR (o.gx = v.gx AND o.gy < v.gy))))))
    SELECT p.gx AS px, p.gy AS py, count(*) AS members, median(x)::DOUBLE AS cx, median(y)::DOUBLE AS cy FROM p JOIN a ON abs(a.gx - p.gx) <= 1 AND abs(a.gy - p.gy) <= 1 GROUP BY 1, 2""",
)
def grid_cluster_median(spark, sf):
    return suppression.grid_clusters(detections(spark, sf), 24, 8)


@query(
    "argmax_radius",
    """WITH s AS (SELECT s_suppkey, unnest(range(15, 29)) AS r FROM supplier), c AS (SELECT s_suppkey, r, (s_suppkey * 31 + r * r * 7) % 101 / 101.0::DOUBLE AS coverage FROM s)
    SELECT s_suppkey, r AS radius, round(coverage, 9) AS coverage FROM c QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY coverage DESC, r) = 1""",
)
def argmax_radius(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(15).cast("long"), F.lit(28).cast("long"))).alias("r"))
    s = s.withColumn("coverage", (F.col("s_suppkey") * 31 + F.col("r") * F.col("r") * 7) % 101 / F.lit(101.0))
    best = s.groupBy("s_suppkey").agg(F.max(F.struct("coverage", (-F.col("r")).alias("n"))).alias("m"))
    return best.select("s_suppkey", (-F.col("m.n")).alias("radius"), F.round("m.coverage", 9).alias("coverage"))


@query(
    "nearest_label",
    f"""WITH {DET}, p AS (SELECT a.id, b.id AS near_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM det a JOIN det b ON a.type = 'error' AND b.type = 'click' AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 3600),
    m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, near_id) = 1)
    SELECT det.id, near_id, round(dist, 6) AS dist FROM det LEFT JOIN m USING (id) WHERE type = 'error'""",
)
def nearest_label(spark, sf):
    d = detections(spark, sf)
    return spatial.nearest_within(d.filter("type = 'error'"), d.filter("type = 'click'"), 60.0).select("id", "near_id", F.round("dist", 6).alias("dist"))


@query(
    "suppress_boxes",
    f"""WITH {DET}, b AS (SELECT x - 6 - 8 AS x0, y - 6 - 8 AS y0, x + 6 + 8 AS x1, y + 6 + 8 AS y1 FROM det WHERE type = 'purchase')
    SELECT id, x, y FROM det d WHERE type = 'click' AND NOT EXISTS (SELECT 1 FROM b WHERE d.x >= b.x0 AND d.x < b.x1 AND d.y >= b.y0 AND d.y < b.y1)""",
)
def suppress_boxes(spark, sf):
    d = detections(spark, sf)
    boxes = d.filter("type = 'purchase'").select((F.col("x") - 6).alias("x0"), (F.col("y") - 6).alias("y0"), (F.col("x") + 6).alias("x1"), (F.col("y") + 6).alias("y1"))
    return spatial.suppress_in_boxes(d.filter("type = 'click'"), boxes, 8, 32).select("id", "x", "y")


@query(
    "theta_pairs",
    f"WITH {DET}, e AS (SELECT * FROM det) SELECT a.id AS a_id, b.id AS b_id, b.x - a.x AS dx, b.y - a.y AS dy FROM e a JOIN e b ON b.x - a.x BETWEEN 20 AND 55 AND abs(b.y - a.y) <= 10",
)
def theta_pairs(spark, sf):
    return spatial.theta_pairs(detections(spark, sf), (20, 55), 10)


@query("dot_pairs_greedy")
def dot_pairs_greedy(spark, sf):
    """One-to-one pairs; tests hold them against a plain greedy pass."""
    return suppression.greedy_pairs(detections(spark, sf).filter("type = 'error'"), (20, 55), 10)


@query(
    "line_intersections",
    """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS g, (s_suppkey * 17 % 97)::DOUBLE AS x1, (s_suppkey * 29 % 89)::DOUBLE AS y1, (s_suppkey * 43 % 83 + 100)::DOUBLE AS x2, (s_suppkey * 61 % 79)::DOUBLE AS y2 FROM supplier),
    p AS (SELECT a.g, (a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2) AS det, a.x1 * a.y2 - a.y1 * a.x2 AS u, b.x1 * b.y2 - b.y1 * b.x2 AS v, a.x1 - a.x2 AS ax, a.y1 - a.y2 AS ay, b.x1 - b.x2 AS bx, b.y1 - b.y2 AS by_ FROM s a JOIN s b ON a.g = b.g AND a.id < b.id)
    SELECT g, count(*) AS n, round(median((u * bx - ax * v) / det), 6) AS mx, round(median((u * by_ - ay * v) / det), 6) AS my FROM p WHERE abs(det) > 1e-9 GROUP BY 1""",
)
def line_intersections(spark, sf):
    """Every pair of a group in tasks of bounded size, and exact medians without a group's values in memory."""
    k = F.col("s_suppkey")
    s = load(spark, sf, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("g"), (k * 17 % 97).cast("double").alias("x1"), (k * 29 % 89).cast("double").alias("y1"), (k * 43 % 83 + 100).cast("double").alias("x2"), (k * 61 % 79).cast("double").alias("y2"))
    a, b = spatial.block_pairs(s, "g", "id")
    col = lambda p: [F.col(f"{p}.{c}") for c in ("x1", "y1", "x2", "y2")]
    on = (F.col("a.g") == F.col("b.g")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id"))
    p = a.alias("a").join(b.alias("b").hint("merge"), on).select(F.col("a.g").alias("g"), G.line_intersection(*col("a"), *col("b")).alias("p")).filter("p is not null")
    got = medians(p.select("g", F.col("p.x").alias("mx"), F.col("p.y").alias("my")), "g", ["mx", "my"])
    return got.select("g", "n", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"))


@query(
    "circle_from_triplets",
    f"""WITH {DET}, t AS (SELECT id, x::DOUBLE AS x1, y::DOUBLE AS y1, (lead(x) OVER w)::DOUBLE AS x2, (lead(y) OVER w)::DOUBLE AS y2, (lead(x, 2) OVER w)::DOUBLE AS x3, (lead(y, 2) OVER w)::DOUBLE AS y3
      FROM det WINDOW w AS (PARTITION BY type, x // 8 ORDER BY id)),
    q AS (SELECT *, 2 * ((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)) AS det FROM t),
    u AS (SELECT id, x1, y1, ((y3 - y1) * ((x2 - x1) ** 2 + (y2 - y1) ** 2) - (y2 - y1) * ((x3 - x1) ** 2 + (y3 - y1) ** 2)) / det AS ux,
      ((x2 - x1) * ((x3 - x1) ** 2 + (y3 - y1) ** 2) - (x3 - x1) * ((x2 - x1) ** 2 + (y2 - y1) ** 2)) / det AS uy,
      least(abs(degrees(atan2(y2 - y1, x2 - x1)) - degrees(atan2(y3 - y1, x3 - x1))), 360 - abs(degrees(atan2(y2 - y1, x2 - x1)) - degrees(atan2(y3 - y1, x3 - x1)))) AS turn FROM q WHERE abs(det) >= 1e-8)
    SELECT id, round(x1 + ux, 4) AS cx, round(y1 + uy, 4) AS cy, round(sqrt(ux * ux + uy * uy), 4) AS r, round(turn, 4) AS turn FROM u""",
)
def circle_from_triplets(spark, sf):
    """Circles through consecutive detections of one type and one column of the grid."""
    w = Window.partitionBy("type", F.floor(F.col("x") / 8)).orderBy("id")
    d = detections(spark, sf)
    c = lambda name: F.col(name).cast("double")
    t = d.select("id", c("x").alias("x1"), c("y").alias("y1"), *[F.lead(c(a), k).over(w).alias(f"{a}{k + 1}") for k in (1, 2) for a in ("x", "y")])
    circle = G.circle_from_points(*[F.col(f"{a}{k}") for k in (1, 2, 3) for a in ("x", "y")])
    angle = lambda k: F.degrees(F.atan2(F.col(f"y{k}") - F.col("y1"), F.col(f"x{k}") - F.col("x1")))
    out = t.select("id", circle.alias("c"), G.angle_diff(angle(2), angle(3)).alias("turn")).filter("c is not null")
    return out.select("id", *[F.round(f"c.{a}", 4).alias(a) for a in ("cx", "cy", "r")], F.round("turn", 4).alias("turn"))


@query(
    "ring_coverage",
    f"""WITH {DET}, ink AS (SELECT DISTINCT x, y FROM det), ring AS (SELECT id, x, y, 17 + id % 10 AS r FROM det WHERE type = 'purchase'),
    k AS (SELECT *, greatest(36, floor(2 * pi() * r)::INT) AS n FROM ring), s AS (SELECT *, unnest(range(0, n)) AS k FROM k),
    q AS (SELECT id, round_even(x + r * cos(2 * pi() * k / n), 0)::BIGINT AS sx, round_even(y + r * sin(2 * pi() * k / n), 0)::BIGINT AS sy FROM s)
    SELECT id, round(avg((ink.x IS NOT NULL)::INT), 9) AS coverage FROM q LEFT JOIN ink ON q.sx = ink.x AND q.sy = ink.y GROUP BY 1""",
)
def ring_coverage(spark, sf):
    d = detections(spark, sf)
    rings = d.filter("type = 'purchase'").select("id", "x", "y", (17 + F.col("id") % 10).alias("r"))
    return spatial.ring_coverage(rings, d.select("x", "y")).select("id", F.round("coverage", 9).alias("coverage"))


@query(
    "box_ink_stats",
    f"""WITH {DET}, b AS (SELECT id, x - 30 AS x0, y - 30 AS y0, x + 30 AS x1, y + 30 AS y1 FROM det WHERE type = 'purchase'),
    p AS (SELECT b.id, d.x, (d.x - b.x0) / 60.0::DOUBLE AS fx, (d.y - b.y0) / 60.0::DOUBLE AS fy FROM b JOIN det d ON d.x >= b.x0 AND d.x < b.x1 AND d.y >= b.y0 AND d.y < b.y1),
    s AS (SELECT id, count(*) AS ink, max(x) FILTER (fy < 0.15) - min(x) FILTER (fy < 0.15) + 1 AS apex_spread, count(*) FILTER (fx < 0.5) AS left_ink, count(*) FILTER (fx >= 0.5) AS right_ink,
      count(*) FILTER (fy >= 0.85 AND fx >= 1 / 3.0::DOUBLE AND fx < 2 / 3.0::DOUBLE) AS base_ink, count(*) FILTER (fx < 0.5 AND fy >= 0.5) AS bl_ink, count(*) FILTER (fx >= 0.5 AND fy >= 0.5) AS br_ink, count(*) FILTER (fy < 0.5) AS top_ink FROM p GROUP BY 1)
    SELECT id, ink, apex_spread, left_ink, right_ink, base_ink, bl_ink, br_ink, top_ink,
      CASE WHEN ink = 0 THEN 'empty' WHEN base_ink / 180.0 > 0.10 THEN 'open_base' WHEN coalesce(apex_spread / 60.0 > 0.35, true) THEN 'apex'
        WHEN least(left_ink, right_ink)::DOUBLE / greatest(1, greatest(left_ink, right_ink)) < 0.40 THEN 'symmetry' ELSE 'passed' END AS gate,
      (br_ink::DOUBLE / greatest(bl_ink, 1) <= 0.83 AND top_ink / 1800.0 >= 0.15) AS letter_r FROM s""",
)
def box_ink_stats(spark, sf):
    d = detections(spark, sf)
    boxes = d.filter("type = 'purchase'").select("id", *[(F.col(a) + s * 30).alias(n) for a, s, n in (("x", -1, "x0"), ("y", -1, "y0"), ("x", 1, "x1"), ("y", 1, "y1"))])
    got = spatial.gates(spatial.box_ink(boxes, d.select("x", "y"), 64))
    return got.drop("x0", "y0", "x1", "y1")


@query(
    "match_pr",
    f"""WITH {DET}, f AS (SELECT * FROM det WHERE type = 'error'), t AS (SELECT * FROM det WHERE type = 'click'),
    n AS (SELECT (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM f WHERE EXISTS (SELECT 1 FROM t WHERE (f.x - t.x) ** 2 + (f.y - t.y) ** 2 <= 225)) AS tp,
      (SELECT count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE (f.x - t.x) ** 2 + (f.y - t.y) ** 2 <= 225)) AS fn)
    SELECT tp, nf - tp AS fp, fn, round(tp / nf::DOUBLE, 9) AS precision, round((nt - fn) / nt::DOUBLE, 9) AS recall FROM n""",
)
def match_pr(spark, sf):
    d = detections(spark, sf)
    got = spatial.match_figures(d.filter("type = 'error'"), d.filter("type = 'click'"), 15.0)
    return got.select("tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("match_pr_by_tile", f"WITH {DET}, f AS (SELECT *, floor(x / 256)::BIGINT AS tx, EXISTS (SELECT 1 FROM det t WHERE t.type = 'click' AND (det.x - t.x) ** 2 + (det.y - t.y) ** 2 <= 225) AS hit FROM det WHERE type = 'error') SELECT tx, count(*) AS found, count(*) FILTER (hit) AS tp FROM f GROUP BY ROLLUP (tx)")
def match_pr_by_tile(spark, sf):
    d = detections(spark, sf)
    found = d.filter("type = 'error'")
    hit = spatial.radius_join(found, d.filter("type = 'click'"), 15.0, inclusive=True, how="left_semi").select(F.col("id").alias("_id"))
    marked = found.join(hit, found["id"] == hit["_id"], "left").withColumn("tx", F.floor(F.col("x") / 256).cast("long"))
    return marked.rollup("tx").agg(F.count("*").alias("found"), F.count("_id").alias("tp"))


@query("order_row_major", f"WITH {DET} SELECT id, row_number() OVER (ORDER BY y, x, id) AS place FROM det")
def order_row_major(spark, sf):
    return ordering.number_rows(detections(spark, sf).select("id", "x", "y"), ["y", "x", "id"]).select("id", "place")


@query("order_col_major", f"WITH {DET} SELECT id, row_number() OVER (ORDER BY x, y, id) AS place FROM det")
def order_col_major(spark, sf):
    return ordering.number_rows(detections(spark, sf).select("id", "x", "y"), ["x", "y", "id"]).select("id", "place")


@query("top_k_per_class", f"WITH {DET} SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY score DESC, id) AS rank FROM det QUALIFY rank <= 100")
def top_k_per_class(spark, sf):
    got = suppression.top_per_group(detections(spark, sf), ["type"], 100, [F.desc("score"), "id"])
    return got.select("id", "type", F.col("rank").cast("long").alias("rank"))


@query("detector_bag_union", f"WITH {DET} SELECT type, sum(n)::BIGINT AS n FROM (SELECT type, count(*) AS n FROM det WHERE score > 50 GROUP BY 1 UNION ALL SELECT type, count(*) AS n FROM det WHERE type <> 'view' GROUP BY 1) GROUP BY 1")
def detector_bag_union(spark, sf):
    d = detections(spark, sf)
    bag = d.filter("score > 50").unionByName(d.filter("type <> 'view'").drop("score"), allowMissingColumns=True)
    return bag.groupBy("type").agg(F.count("*").alias("n"))


@query(
    "gaps_islands_runs",
    f"""WITH {DET}, c AS (SELECT DISTINCT y, x FROM det), r AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM c)
    SELECT y, min(x) AS x0, max(x) + 1 AS x1 FROM r GROUP BY y, g""",
)
def gaps_islands_runs(spark, sf):
    """Run-length encoding of occupied cells."""
    c = detections(spark, sf).select("y", "x").distinct()
    r = c.withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy("y").orderBy("x")))
    return r.groupBy("y", "g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("g")


@query(
    "component_stats",
    f"""WITH {DET}, c AS (SELECT DISTINCT y, x FROM det), r AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM c),
    runs AS (SELECT y, min(x) AS x0, max(x) + 1 AS x1 FROM r GROUP BY y, g)
    SELECT y AS label, sum(x1 - x0)::BIGINT AS area, min(x0) AS x0, max(x1) AS x1, round(sum((x1 - x0) * (x0 + x1 - 1) / 2.0::DOUBLE) / sum(x1 - x0), 6) AS cx FROM runs GROUP BY 1""",
)
def component_stats(spark, sf):
    runs = gaps_islands_runs(spark, sf).withColumn("chart_id", F.lit("c")).withColumn("label", F.col("y"))
    return tiles.component_stats(runs).select("label", "area", "x0", "x1", F.round("cx", 6).alias("cx"))
