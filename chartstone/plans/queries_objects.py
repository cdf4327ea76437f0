"""Queries over components and pixels: cascades, rules, colour, masks, aggregates, change detection, validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chartstone.functions import color, rules
from chartstone.functions import geometry as G
from chartstone.operators import changes, entities, fit, ordering, suppression
from chartstone.plans.registry import query
from chartstone.plans.views import BLOB, HSV, PIXEL, pixels, shapes
from chartstone.session import load

_CASCADE = """CASE WHEN flag = 'R' AND h < 20 THEN 'legend' WHEN NOT area BETWEEN 100 AND 400 THEN 'area' WHEN NOT w BETWEEN 12 AND 36 OR NOT h BETWEEN 14 AND 40 THEN 'size'
  WHEN NOT asp BETWEEN 0.70 AND 1.40 THEN 'aspect' WHEN NOT solidity BETWEEN 0.45 AND 0.65 THEN 'solidity' WHEN eccentricity >= 0.70 THEN 'eccentricity' ELSE 'kept' END"""
_REASONS = ["legend", "area", "size", "aspect", "solidity", "eccentricity", "kept"]


@query(
    "blob_cascade_histogram",
    f"""WITH {BLOB}, r AS (SELECT {_CASCADE} AS reason FROM (SELECT *, h::DOUBLE / w AS asp FROM shape)), c AS (SELECT reason, count(*) AS n FROM r GROUP BY 1)
    SELECT k.reason, coalesce(n, 0) AS n FROM (SELECT unnest({_REASONS}) AS reason) k LEFT JOIN c USING (reason)""",
)
def blob_cascade_histogram(spark, sf):
    s = shapes(spark, sf)
    c = F.col
    legend = (c("flag") == "R") & (c("h") < 20)
    reason = rules.first_failure(rules.obstacle_cascade(legend, c("area"), c("w"), c("h"), c("h") / c("w"), c("solidity"), c("eccentricity")))
    return rules.histogram(s.select(reason.alias("reason")), "reason", _REASONS)


@query(
    "colour_blob_cascade",
    f"""WITH {BLOB} SELECT CASE WHEN NOT area BETWEEN 65 AND 240 THEN 'area' WHEN NOT w BETWEEN 12 AND 26 OR NOT h BETWEEN 12 AND 26 THEN 'size' WHEN NOT h::DOUBLE / w BETWEEN 0.78 AND 1.25 THEN 'aspect'
      WHEN NOT solidity BETWEEN 0.50 AND 0.62 THEN 'solidity' WHEN eccentricity >= 0.85 THEN 'eccentricity' ELSE 'kept' END AS reason, count(*) AS n FROM shape GROUP BY 1""",
)
def colour_blob_cascade(spark, sf):
    c = F.col
    reason = rules.first_failure(rules.colour_obstacle_cascade(c("area"), c("w"), c("h"), c("h") / c("w"), c("solidity"), c("eccentricity")))
    return shapes(spark, sf).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_SYMBOL = """CASE WHEN area <= 3 THEN 'noise' WHEN max_dim::DOUBLE / greatest(min_dim, 1) > 50 AND max_dim > 50 THEN 'long_line' WHEN min_dim = 1 AND area < 20 THEN 'thin'
  WHEN boosted AND ((area < 100 AND density > {d}) OR (max_dim > 25 AND chord < {c} AND solidity < 0.45 AND euler >= 0)) THEN 'reinstated'
  WHEN area < 100 AND density > {d} THEN 'density' WHEN max_dim > 25 AND chord < {c} AND solidity < 0.45 AND euler >= 0 THEN 'chord'{g} ELSE 'kept' END"""


@query(
    "component_cascade_reinstated",
    f"""WITH {BLOB}, peak AS (SELECT DISTINCT p_partkey % 120 AS py, p_size % 40 AS px FROM part WHERE p_size < 25),
    b AS (SELECT *, EXISTS (SELECT 1 FROM peak WHERE py = h AND px = w) AS boosted FROM shape)
    SELECT {_SYMBOL.format(d="0.10", c="1.20", g=" WHEN max_dim > 80 AND NOT boosted THEN 'size_gate'")} AS fate, count(*) AS n, sum(area)::BIGINT AS ink FROM b GROUP BY 1""",
)
def component_cascade_reinstated(spark, sf):
    p = load(spark, sf, "part").filter("p_size < 25").select((F.col("p_partkey") % 120).alias("_y"), (F.col("p_size") % 40).cast("long").alias("_x")).distinct()
    s = shapes(spark, sf).join(p, (F.col("h") == F.col("_y")) & (F.col("w") == F.col("_x")), "left")
    c = F.col
    fate = rules.symbol_cascade(c("area"), c("max_dim"), c("min_dim"), c("chord"), c("solidity"), c("euler"), c("density"), c("_y").isNotNull())
    return s.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"), F.sum("area").alias("ink"))


@query("background_cascade", f"WITH {BLOB}, b AS (SELECT *, false AS boosted FROM shape) SELECT {_SYMBOL.format(d='0.12', c='1.30', g='')} AS fate, count(*) AS n FROM b GROUP BY 1")
def background_cascade(spark, sf):
    c = F.col
    fate = rules.symbol_cascade(c("area"), c("max_dim"), c("min_dim"), c("chord"), c("solidity"), c("euler"), c("density"), None, 0.12, 1.30, None)
    return shapes(spark, sf).groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


@query(
    "layer_decision_tree",
    f"""WITH {BLOB} SELECT CASE WHEN area <= 3 THEN 'NOISE' WHEN aspect > 50 AND max_dim > 50 THEN 'GRID' WHEN min_dim = 1 AND area < 15 THEN 'GRID' WHEN euler < -3 AND area < 400 THEN 'TEXT'
      WHEN density > 0.13 AND area < 100 THEN 'AIRSPACE' WHEN max_dim > 25 AND chord < 1.25 AND solidity < 0.45 THEN CASE WHEN aspect > 6 THEN 'AIRWAY' ELSE 'AIRSPACE' END
      WHEN max_dim > 60 AND solidity > 0.02 AND chord < 1.5 THEN 'TOPO' WHEN area > 300 AND max_dim < 80 AND solidity > 0.3 THEN 'SYMBOL' WHEN area < 200 AND max_dim < 40 AND aspect < 6 THEN 'SYMBOL' ELSE 'TEXT' END AS layer,
      count(*) AS n, sum(area)::BIGINT AS ink FROM shape GROUP BY 1""",
)
def layer_decision_tree(spark, sf):
    layer = rules.layer_tree(*[F.col(c) for c in ("area", "max_dim", "min_dim", "aspect", "chord", "solidity", "euler", "density")])
    return shapes(spark, sf).groupBy(layer.alias("layer")).agg(F.count("*").alias("n"), F.sum("area").alias("ink"))


@query(
    "layer_rules_multi",
    f"""WITH {BLOB}, r(layer, cond) AS (SELECT 1, 1), m AS (
      SELECT id, unnest(list_filter([CASE WHEN area BETWEEN 20 AND 2500 AND solidity >= 0.40 AND eccentricity <= 0.90 THEN 'airport' END, CASE WHEN area BETWEEN 2500 AND 50000 AND solidity >= 0.25 AND eccentricity <= 0.98 THEN 'airport_large' END,
        CASE WHEN area BETWEEN 200 AND 2000 AND solidity >= 0.20 AND eccentricity <= 0.80 THEN 'vor' END, CASE WHEN area BETWEEN 150 AND 800 AND solidity >= 0.10 AND eccentricity <= 0.70 THEN 'vortac' END,
        CASE WHEN area BETWEEN 30 AND 600 AND solidity >= 0.55 AND aspect BETWEEN 0.6 AND 1.6 THEN 'dme' END, CASE WHEN area >= 50 AND eccentricity >= 0.80 AND max_dim >= 40 THEN 'airspace' END,
        CASE WHEN area >= 200 AND solidity <= 0.40 THEN 'special_use' END, CASE WHEN solidity <= 0.30 AND eccentricity >= 0.95 AND max_dim >= 100 THEN 'airway' END,
        CASE WHEN area BETWEEN 4 AND 500 AND solidity >= 0.25 AND aspect BETWEEN 0.3 AND 4.0 THEN 'text' END], lambda v: v IS NOT NULL)) AS layer, area FROM shape)
    SELECT layer, count(*) AS n, sum(area)::BIGINT AS ink FROM m GROUP BY 1""",
)
def layer_rules_multi(spark, sf):
    return rules.apply_layer_rules(shapes(spark, sf)).groupBy("layer").agg(F.count("*").alias("n"), F.sum("area").alias("ink"))


@query(
    "reason_flags",
    f"""WITH {BLOB}, f AS (SELECT flag, area % 7 > 4 AS a, eccentricity >= 0.96 AS b, solidity > 0.45 AS c FROM shape)
    SELECT flag, concat_ws(' | ', CASE WHEN a THEN 'count' END, CASE WHEN b THEN 'elongated' END, CASE WHEN c THEN 'filled' END) AS reason, count(*) AS n,
      count(*) FILTER (a) AS fails_a, count(*) FILTER (b) AS fails_b, count(*) FILTER (c) AS fails_c FROM f GROUP BY 1, 2""",
)
def reason_flags(spark, sf):
    f = shapes(spark, sf).select("flag", (F.col("area") % 7 > 4).alias("a"), (F.col("eccentricity") >= 0.96).alias("b"), (F.col("solidity") > 0.45).alias("c"))
    reason = rules.failure_names([("count", F.col("a")), ("elongated", F.col("b")), ("filled", F.col("c"))])
    return f.groupBy("flag", reason.alias("reason")).agg(F.count("*").alias("n"), *[F.count_if(k).alias(f"fails_{k}") for k in "abc"])


@query(
    "residual_shape_classes",
    f"""WITH {BLOB}, k AS (SELECT w::DOUBLE / h AS asp, log10(area) AS la, (area % 97) / 97.0::DOUBLE AS circ, solidity, euler FROM shape)
    SELECT CASE WHEN circ > 0.80 AND la > 0.9 AND la < 2.1 THEN 'spot_elevation' WHEN circ > 0.30 AND circ < 0.62 AND solidity > 0.88 AND asp > 0.55 AND asp < 1.20 THEN 'waypoint'
      WHEN asp < 0.55 AND la > 1.8 AND solidity > 0.45 THEN 'parachute' WHEN asp > 1.6 AND la > 1.5 AND solidity > 0.50 THEN 'ultralight' WHEN circ > 0.65 AND circ < 0.85 AND euler < -0.5 AND la > 1.8 AND la < 2.8 THEN 'ndb' END AS kind, count(*) AS n FROM k GROUP BY 1""",
)
def residual_shape_classes(spark, sf):
    s = shapes(spark, sf)
    kind = rules.residual_class(F.col("w") / F.col("h"), F.log10("area"), (F.col("area") % 97) / F.lit(97.0), F.col("solidity"), F.col("euler"))
    return s.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "circle_classes",
    f"""WITH {BLOB}, k AS (SELECT max_dim AS r, (area % 50) / 50.0::DOUBLE AS ring, density AS inside FROM shape)
    SELECT CASE WHEN r >= 70 THEN CASE WHEN ring > 0.35 THEN 'vor' ELSE 'class_d' END WHEN inside > 0.08 THEN 'airport_civil' ELSE 'ndb' END AS kind, count(*) AS n FROM k GROUP BY 1""",
)
def circle_classes(spark, sf):
    kind = rules.circle_class(F.col("max_dim"), (F.col("area") % 50) / F.lit(50.0), F.col("density"))
    return shapes(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "hsv_range_mask",
    f"""WITH {PIXEL}, {HSV}, f AS (SELECT band, unnest(list_filter([CASE WHEN (h BETWEEN 0.78 AND 1.0 OR h BETWEEN 0.0 AND 0.08) AND s BETWEEN 0.15 AND 1 AND v BETWEEN 0.25 AND 1 THEN 'magenta' END,
      CASE WHEN h BETWEEN 0.55 AND 0.72 AND s BETWEEN 0.15 AND 1 AND v BETWEEN 0.20 AND 1 THEN 'blue' END, CASE WHEN v <= 0.45 THEN 'black' END, CASE WHEN s <= 0.15 AND v BETWEEN 0.45 AND 0.70 THEN 'grey' END,
      CASE WHEN h BETWEEN 0.05 AND 0.15 AND s BETWEEN 0.08 AND 0.55 AND v BETWEEN 0.55 AND 1 THEN 'terrain' END], lambda x: x IS NOT NULL)) AS family FROM colour)
    SELECT band, family, count(*) AS n FROM f GROUP BY 1, 2""",
)
def hsv_range_mask(spark, sf):
    p = pixels(spark, sf).select("band", color.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    return p.select("band", F.explode(color.family_flags(F.col("c"))).alias("family")).groupBy("band", "family").agg(F.count("*").alias("n"))


def _class_sql() -> str:
    def test(k):
        hue = f"h BETWEEN {k.h[0]} AND {k.h[1]}" + (f" OR h BETWEEN {k.h2[0]} AND {k.h2[1]}" if k.h2 else "")
        return f"({hue}) AND s BETWEEN {k.s[0]} AND {k.s[1]} AND v BETWEEN {k.v[0]} AND {k.v[1]}"

    counts = ", ".join(f"count(*) FILTER ({test(k)}) AS {k.name}" for k in color.CLASSES)
    names = [k.name for k in color.CLASSES]
    rows = " UNION ALL ".join([f"SELECT band, '{n}' AS class, {n} AS n, total FROM t" for n in names] + [f"SELECT band, 'unclassified', greatest(total - ({' + '.join(names)}), 0), total FROM t"])
    return f"WITH {PIXEL}, {HSV}, t AS (SELECT band, count(*) AS total, {counts} FROM colour GROUP BY band), e AS ({rows}) SELECT band, class, n::BIGINT AS n, round(100.0::DOUBLE * n / total, 6) AS share FROM e"


@query("colour_class_shares", _class_sql())
def colour_class_shares(spark, sf):
    """All eight classes and the unclassified share, by band."""
    p = pixels(spark, sf).select("band", color.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    return color.class_shares(p, "c", ["band"]).withColumn("share", F.round("share", 6))


@query(
    "window_gates",
    f"""WITH {BLOB}, c AS (SELECT id, (id % 50 + 50) / 100.0::DOUBLE AS score, (id * 7 % 1000) AS x, density AS blue, eccentricity AS overlap FROM shape)
    SELECT CASE WHEN score < 0.65 THEN 'score' WHEN x < floor(1000 * 0.18) THEN 'legend' WHEN blue < 0.08 THEN 'colour' WHEN overlap < 0.5 THEN 'overlap' ELSE 'kept' END AS fate, count(*) AS n FROM c GROUP BY 1""",
)
def window_gates(spark, sf):
    """Candidates of a sliding window through score, legend strip, blue share and template overlap."""
    c = shapes(spark, sf).select(((F.col("id") % 50 + 50) / 100.0).alias("score"), (F.col("id") * 7 % 1000).alias("x"), "density", "eccentricity")
    gates = rules.window_gates(F.col("score"), F.col("x"), F.lit(1000), F.col("density"), F.col("eccentricity"))
    return c.groupBy(rules.first_failure(gates).alias("fate")).agg(F.count("*").alias("n"))


@query(
    "interior_tests",
    f"""WITH {BLOB}, c AS (SELECT id, id % 6 AS cc, eccentricity AS ecc, area, (max_dim * max_dim)::DOUBLE AS disk FROM shape),
    t AS (SELECT *, cc > 0 AND cc <= 3 AS a, cc > 0 AND ecc < 0.96 AS b, cc > 0 AND area / disk <= 0.45 AS c FROM c)
    SELECT id, a AS passes_a, b AS passes_b, c AS passes_c, concat_ws(' | ', CASE WHEN NOT a THEN 'cc=' || cc END, CASE WHEN NOT b THEN printf('ecc=%.2f', ecc) END) AS reason FROM t""",
)
def interior_tests(spark, sf):
    """Blobs inside a ring: how many, how long the largest, how much of the disk it fills."""
    c = shapes(spark, sf).select("id", (F.col("id") % 6).alias("cc"), "eccentricity", "area", (F.col("max_dim") * F.col("max_dim")).cast("double").alias("disk"))
    tests = rules.interior_tests(F.col("cc"), F.col("eccentricity"), F.col("area"), F.col("disk"))
    reason = F.regexp_replace(rules.interior_reason(F.col("cc"), F.col("eccentricity"), F.col("area"), F.col("disk")), r"( \| )?bf=[0-9.]+$", "")
    return c.select("id", *[t.alias(n) for n, t in tests.items()], reason.alias("reason"))


@query(
    "change_report_nulls",
    """WITH o AS (SELECT o_custkey AS k, nullif(o_orderkey % 3, 0) AS a, nullif(o_orderkey % 5, 0) AS b FROM orders),
    n AS (SELECT nullif(k, 7) AS k, CASE WHEN k % 4 = 0 THEN b ELSE a END AS a, CASE WHEN k % 4 = 0 THEN a ELSE b END AS b FROM o WHERE k % 10 <> 3),
    u AS (SELECT k, count(*) AS c, list_sort(list(coalesce(a::VARCHAR, '-') || '/' || coalesce(b::VARCHAR, '-'))) AS w FROM o GROUP BY k),
    x AS (SELECT k, count(*) AS c, list_sort(list(coalesce(a::VARCHAR, '-') || '/' || coalesce(b::VARCHAR, '-'))) AS w FROM n GROUP BY k)
    SELECT coalesce(u.k, x.k) AS k, CASE WHEN u.c IS NULL THEN 'added' WHEN x.c IS NULL THEN 'removed' WHEN u.w <> x.w THEN 'modified' ELSE 'unchanged' END AS change
    FROM u FULL JOIN x ON u.k IS NOT DISTINCT FROM x.k""",
)
def change_report_nulls(spark, sf):
    """Two columns whose nulls change places are a change; a null key is a key."""
    key = F.col("o_orderkey")
    old = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.nullif(key % 3, F.lit(0)).alias("a"), F.nullif(key % 5, F.lit(0)).alias("b"))
    swap = F.col("k") % 4 == 0
    a, b = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    new = old.filter("k % 10 <> 3").select(F.nullif(F.col("k"), F.lit(7)).alias("k"), a.alias("a"), b.alias("b"))
    return changes.change_report(old, new, ["k"], ["a", "b"])


@query(
    "hue_wrap_coverage",
    f"""WITH {PIXEL}, {HSV} SELECT band, round(avg(((h BETWEEN 0.78 AND 1.0 OR h BETWEEN 0.0 AND 0.08) AND s >= 0.15 AND v >= 0.25)::INT) * 100, 6) AS wrapped,
      round(avg((h BETWEEN 0.78 AND 1.0 AND s >= 0.15 AND v >= 0.25)::INT) * 100, 6) AS upper_only FROM colour GROUP BY 1""",
)
def hue_wrap_coverage(spark, sf):
    c = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    family = color.FAMILIES[0]
    upper = color.HsvRange("upper", family.h, family.s, family.v)
    p = pixels(spark, sf).withColumn("c", c)
    pct = lambda f: F.round(F.avg(f.matches(F.col("c")).cast("int")) * 100, 6)
    return p.groupBy("band").agg(pct(family).alias("wrapped"), pct(upper).alias("upper_only"))


@query(
    "coverage_bounds_notes",
    """WITH c AS (SELECT o_orderstatus AS layer, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders) AS percent FROM orders GROUP BY 1), b(layer, low, high) AS (VALUES ('F', 0.5::DOUBLE, 8.0::DOUBLE), ('O', 1.0, 50.0), ('P', 40.0, 90.0), ('X', 1.0, 2.0))
    SELECT b.layer, round(coalesce(percent, 0), 6) AS percent, CASE WHEN coalesce(percent, 0) < low THEN 'below' WHEN percent > high THEN 'above' ELSE 'ok' END AS note FROM b LEFT JOIN c USING (layer)""",
)
def coverage_bounds_notes(spark, sf):
    o = load(spark, sf, "orders")
    bounds = spark.createDataFrame([("F", 0.5, 8.0), ("O", 1.0, 50.0), ("P", 40.0, 90.0), ("X", 1.0, 2.0)], "layer string, low double, high double")
    total = o.count()
    c = o.groupBy(F.col("o_orderstatus").alias("layer")).agg((F.lit(100.0) * F.count("*") / F.lit(total)).alias("percent"))
    j = bounds.join(c, "layer", "left").withColumn("percent", F.coalesce("percent", F.lit(0.0)))
    note = F.when(F.col("percent") < F.col("low"), "below").when(F.col("percent") > F.col("high"), "above").otherwise("ok")
    return j.select("layer", F.round("percent", 6).alias("percent"), note.alias("note"))


@query(
    "scale_threshold_override",
    """WITH t(size, thr) AS (VALUES (24, 0.65::DOUBLE), (28, 0.62), (32, 0.60)), p AS (SELECT p_partkey, p_size, (p_partkey % 100) / 100.0::DOUBLE AS score, 100 + p_partkey % 4 * 50 AS dpi FROM part)
    SELECT p_partkey, coalesce(thr, 0.62) AS threshold, score >= coalesce(thr, 0.62) AS kept, greatest(1, round_even(p_size * dpi / 150.0::DOUBLE, 0)) AS length_px, greatest(1, round_even(p_size * (dpi / 150.0::DOUBLE) * (dpi / 150.0::DOUBLE), 0)) AS area_px FROM p LEFT JOIN t ON t.size = p.p_size""",
)
def scale_threshold_override(spark, sf):
    t = spark.createDataFrame([(24, 0.65), (28, 0.62), (32, 0.60)], "size int, thr double")
    k = F.col("p_partkey")
    p = load(spark, sf, "part").select("p_partkey", "p_size", ((k % 100) / F.lit(100.0)).alias("score"), (100 + k % 4 * 50).alias("dpi"))
    j = p.join(F.broadcast(t), F.col("p_size") == F.col("size"), "left").withColumn("threshold", F.coalesce("thr", F.lit(0.62)))
    return j.select("p_partkey", "threshold", (F.col("score") >= F.col("threshold")).alias("kept"), G.scaled_length(F.col("p_size"), F.col("dpi")).alias("length_px"), G.scaled_area(F.col("p_size"), F.col("dpi")).alias("area_px"))


@query("dedup_ids", "WITH d AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS detection_id FROM d")
def dedup_ids(spark, sf):
    first = changes.keep_first_by(load(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
    return ordering.number_rows(first, ["o_orderkey"], "detection_id")


_OLD = "SELECT o_custkey AS name, o_orderkey AS ord, o_totalprice / 1000 AS lat, (o_orderkey % 360)::DOUBLE / 2 AS lon FROM orders WHERE o_orderkey % 2 = 0"
_NEW = "SELECT o_custkey AS name, o_orderkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 1000 END AS lat, ((o_orderkey - 1) % 360)::DOUBLE / 2 AS lon FROM orders WHERE o_orderkey % 2 = 1"


@query(
    "waypoint_drift",
    f"""WITH a AS (SELECT * FROM ({_OLD}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC) = 1), b AS (SELECT * FROM ({_NEW}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC) = 1),
    m AS (SELECT name, abs(coalesce(b.lat, 0) - coalesce(a.lat, 0)) AS d_lat, abs(coalesce(b.lon, 0) - coalesce(a.lon, 0)) AS d_lon, (a.lat IS NULL OR b.lat IS NULL) AS null_involved FROM a JOIN b USING (name))
    SELECT name, round(d_lat, 6) AS d_lat, round(d_lon, 6) AS d_lon, null_involved FROM m WHERE d_lat > 0.01 OR d_lon > 0.01""",
)
def waypoint_drift(spark, sf):
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    lat = F.col("o_totalprice") / 1000
    old = o.filter(k % 2 == 0).select(F.col("o_custkey").alias("name"), k.alias("ord"), lat.alias("lat"), ((k % 360).cast("double") / 2).alias("lon"))
    new = o.filter(k % 2 == 1).select(F.col("o_custkey").alias("name"), k.alias("ord"), F.when(k % 11 != 0, lat).alias("lat"), (((k - 1) % 360).cast("double") / 2).alias("lon"))
    d = changes.drifts(old, new)
    return d.select("name", F.round("d_lat", 6).alias("d_lat"), F.round("d_lon", 6).alias("d_lon"), "null_involved")


@query(
    "keyed_change_report",
    """WITH o AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 10 <> 3), n AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 5)
    SELECT coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' WHEN o.c_acctbal <> n.c_acctbal THEN 'modified' ELSE 'unchanged' END AS change, count(*) AS n
    FROM o FULL JOIN n ON o.c_custkey = n.c_custkey GROUP BY 1, 2""",
)
def keyed_change_report(spark, sf):
    c, k = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_custkey")
    new = c.filter(k % 10 != 5).withColumn("c_acctbal", F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    report = changes.change_report(c.filter(k % 10 != 3), new, ["c_mktsegment", "c_custkey"], ["c_acctbal"])
    return report.groupBy("c_mktsegment", "change").agg(F.count("*").alias("n"))


@query("known_verify", "SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) AS verified FROM customer")
def known_verify(spark, sf):
    known = load(spark, sf, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return changes.flag_known(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), known, "c_nationkey").select("c_custkey", "verified")


@query("verified_only", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def verified_only(spark, sf):
    known = load(spark, sf, "nation").filter("n_regionkey < 2").select("n_nationkey")
    c = load(spark, sf, "customer")
    return c.join(known, c["c_nationkey"] == known["n_nationkey"], "left_semi").select("c_custkey")


@query("verified_ratio", "SELECT c_mktsegment, count(*) AS n, round(avg((c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2))::INT), 9) AS ratio FROM customer GROUP BY 1")
def verified_ratio(spark, sf):
    known = load(spark, sf, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"))
    c = changes.flag_known(load(spark, sf, "customer").select("c_mktsegment", "c_nationkey"), known, "c_nationkey")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg(F.col("verified").cast("int")), 9).alias("ratio"))


@query("unmatched_anti", "SELECT p_partkey, p_size FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def unmatched_anti(spark, sf):
    used = load(spark, sf, "lineitem").filter("l_quantity > 45").select("l_partkey")
    p = load(spark, sf, "part").select("p_partkey", "p_size")
    return p.join(used, p["p_partkey"] == used["l_partkey"], "left_anti")


def _masks(spark, sf):
    l = load(spark, sf, "lineitem")
    return l.filter("l_quantity > 30").select(F.col("l_orderkey").alias("k")).distinct(), l.filter("l_discount > 0.05").select(F.col("l_orderkey").alias("k")).distinct()


_A, _B = "SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 30", "SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount > 0.05"


@query("mask_union", f"{_A} UNION {_B}")
def mask_union(spark, sf):
    a, b = _masks(spark, sf)
    return a.union(b).distinct()


@query("mask_intersect", f"({_A}) INTERSECT ({_B})")
def mask_intersect(spark, sf):
    a, b = _masks(spark, sf)
    return a.intersect(b)


@query("mask_diff", f"({_A}) EXCEPT ({_B})")
def mask_diff(spark, sf):
    a, b = _masks(spark, sf)
    return a.exceptAll(b)


@query("canonical_dedup", "SELECT l_returnflag, l_linestatus, l_quantity, min(l_orderkey * 10 + l_linenumber) AS source FROM lineitem GROUP BY 1, 2, 3")
def canonical_dedup(spark, sf):
    l = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source"))
    return changes.dedup_canonical(l, ["source"], ["source"])


@query("composite_max", f"WITH {PIXEL} SELECT id % 1000 AS place, max(r) AS r, max(g) AS g, max(b) AS b, max({{'id': id, 'band': band}}).band AS top FROM pixel GROUP BY 1")
def composite_max(spark, sf):
    p = pixels(spark, sf)
    return p.groupBy((F.col("id") % 1000).alias("place")).agg(F.max("r").alias("r"), F.max("g").alias("g"), F.max("b").alias("b"), F.max(F.struct("id", "band")).alias("m")).select("place", "r", "g", "b", F.col("m.band").alias("top"))


@query(
    "local_mean_threshold",
    """WITH w AS (SELECT event_id, value, avg(value) OVER n AS m, stddev_pop(value) OVER n AS s FROM events WINDOW n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))
    SELECT event_id, round(m, 6) AS m, round(s, 5) AS s, value < m * (1 + 0.2 * (s / 128 - 1)) AS ink FROM w""",
)
def local_mean_threshold(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-12, 12)
    e = load(spark, sf, "events").select("event_id", "value", F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s"))
    ink = F.col("value") < F.col("m") * (1 + F.lit(0.2) * (F.col("s") / 128 - 1))
    return e.select("event_id", F.round("m", 6).alias("m"), F.round("s", 5).alias("s"), ink.alias("ink"))


@query(
    "ncc_pairs",
    """WITH t AS (SELECT vec_id AS t_id, embedding AS t FROM embeddings WHERE vec_id < 8), e AS (SELECT vec_id, embedding AS v FROM embeddings),
    p AS (SELECT vec_id, t_id, unnest(v)::DOUBLE AS a, unnest(t)::DOUBLE AS b FROM e, t), c AS (SELECT vec_id, t_id, corr(a, b) AS score FROM p GROUP BY 1, 2)
    SELECT vec_id, round(max(score), 6) AS best, arg_max(t_id, score) AS template FROM c GROUP BY 1""",
)
def ncc_pairs(spark, sf):
    """Best of a small template library (8 vectors, sent as literals) for every vector: correlation of arrays, then the maximum."""
    e = load(spark, sf, "embeddings")
    library = e.filter("vec_id < 8").orderBy("vec_id").collect()
    v = F.transform("embedding", lambda x: x.cast("double"))

    def score(t):
        n, mean = len(t), sum(t) / len(t)
        centred = [x - mean for x in t]
        norm = sum(x * x for x in centred) ** 0.5
        total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
        squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, centred)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return dot / (F.lit(norm) * F.sqrt(squares - total * total / n))

    scored = e.select("vec_id", v.alias("v")).select("vec_id", F.array(*[F.struct(score([float(x) for x in r["embedding"]]).alias("s"), F.lit(r["vec_id"]).alias("t")) for r in library]).alias("all"))
    best = F.array_max("all")
    return scored.select("vec_id", F.round(best["s"], 6).alias("best"), best["t"].alias("template"))


@query(
    "path_length_track",
    """WITH p AS (SELECT o_custkey, o_orderkey, (o_orderkey % 1000)::DOUBLE AS x, floor(o_totalprice / 100)::DOUBLE AS y FROM orders),
    l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    s AS (SELECT o_custkey, count(*) AS points, sum(coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0)) AS length, arg_max(x, o_orderkey) - arg_min(x, o_orderkey) AS dx, arg_max(y, o_orderkey) - arg_min(y, o_orderkey) AS dy FROM l GROUP BY 1)
    SELECT o_custkey, points, round(length, 5) AS length, round(((degrees(atan2(dx, -dy)) % 360) + 360) % 360, 4) AS track FROM s WHERE points >= 2 AND length >= 100""",
)
def path_length_track(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 1000).cast("double").alias("x"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("y"))
    # orders without a key stand last; an end of the track is the first or last order that has its key and that coordinate
    paths = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").isNull().alias("unkeyed"), "o_orderkey", "x", "y"))).alias("p"))

    def span(c):
        known = F.filter("p", lambda r: r["o_orderkey"].isNotNull() & r[c].isNotNull())
        return F.try_element_at(known, F.lit(-1))[c] - F.try_element_at(known, F.lit(1))[c]

    got = paths.select("o_custkey", F.size("p").cast("long").alias("points"), G.path_length(F.col("p")).alias("length"), G.bearing(span("x"), span("y")).alias("track"))
    return got.filter("points >= 2 and length >= 100").select("o_custkey", "points", F.round("length", 5).alias("length"), F.round("track", 4).alias("track"))


@query(
    "validate_ranges",
    """WITH e AS (SELECT 'frequencies' AS category, c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 100 + c_custkey % 350 END::DOUBLE AS value, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon FROM customer
      UNION ALL SELECT 'waypoints', p_partkey, NULL, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 200 - 95 END, p_partkey % 400 - 190 FROM part
      UNION ALL SELECT 'routes', o_orderkey, o_orderkey % 400 - 20, NULL, NULL FROM orders UNION ALL SELECT 'obstacles', l_orderkey, l_extendedprice * 2, l_quantity, l_quantity FROM lineitem),
    v AS (SELECT category, CASE WHEN category = 'frequencies' THEN CASE WHEN value IS NULL THEN 'missing_value' WHEN NOT (value BETWEEN 108 AND 137.975 OR value BETWEEN 225 AND 400) THEN 'frequency_range' END
        WHEN category = 'waypoints' AND lat IS NULL THEN 'missing_coordinates' WHEN category = 'routes' AND NOT value BETWEEN 0 AND 360 THEN 'track_range' WHEN category = 'obstacles' AND value > 99999 THEN 'height_limit' END AS rule FROM e
      UNION ALL SELECT category, CASE WHEN NOT lat BETWEEN -90 AND 90 THEN 'latitude_range' END FROM e WHERE category = 'waypoints' AND lat IS NOT NULL
      UNION ALL SELECT category, CASE WHEN NOT lon BETWEEN -180 AND 180 THEN 'longitude_range' END FROM e WHERE category = 'waypoints' AND lat IS NOT NULL)
    SELECT category, rule, CASE WHEN rule LIKE 'missing%' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1, 2, 3""",
)
def validate_ranges(spark, sf):
    def rows(table, category, key, value, lat, lon):
        d = lambda e: (F.lit(None) if e is None else e).cast("double")
        return load(spark, sf, table).select(F.lit("c").alias("chart_id"), F.lit(category).alias("category"), F.col(key).cast("string").alias("name"), d(value).alias("value"), d(lat).alias("lat"), d(lon).alias("lon"))

    c, p, o, q = F.col("c_custkey"), F.col("p_partkey"), F.col("o_orderkey"), F.col("l_quantity")
    e = rows("customer", "frequencies", "c_custkey", F.when(c % 13 != 0, 100 + c % 350), None, None)
    e = e.unionByName(rows("part", "waypoints", "p_partkey", None, F.when(p % 17 != 0, p % 200 - 95), p % 400 - 190))
    e = e.unionByName(rows("orders", "routes", "o_orderkey", o % 400 - 20, None, None)).unionByName(rows("lineitem", "obstacles", "l_orderkey", F.col("l_extendedprice") * 2, q, q))
    return entities.violations(e).groupBy("category", "rule", "severity").agg(F.count("*").alias("n"))


@query(
    "transform_ladder",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'inset' WHEN n_nationkey % 3 = 0 THEN 'known_bounds' WHEN n_nationkey % 2 = 0 THEN 'header' ELSE 'identity' END AS source,
      round(CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey * 1.0::DOUBLE WHEN n_nationkey % 3 = 0 THEN 22.0 WHEN n_nationkey % 2 = 0 THEN n_nationkey - 0.05::DOUBLE ELSE 0 END, 9) AS a,
      round(CASE WHEN n_nationkey % 5 = 0 THEN 1 / 1000.0::DOUBLE WHEN n_nationkey % 3 = 0 THEN 3.5::DOUBLE / 2000 WHEN n_nationkey % 2 = 0 THEN 0.1::DOUBLE / 2000 ELSE 1 END, 9) AS b FROM nation""",
)
def transform_ladder(spark, sf):
    k = F.col("n_nationkey")
    pages = load(spark, sf, "nation").select(
        "n_nationkey",
        F.when(k % 5 == 0, G.bounds_transform(k + 1.0, k.cast("double"), k.cast("double"), k + 1.0, 1000, 1000)).alias("inset"),
        F.when(k % 3 == 0, G.bounds_transform(38.5, 37.0, 22.0, 25.5, 2000, 1500)).alias("known_bounds"),
        F.when(k % 2 == 0, G.header_transform(k.cast("double"), k.cast("double"), 2000, 2000)).alias("header"),
        G.identity_transform().alias("identity"),
    )
    got = fit.transform_ladder(pages, ["inset", "known_bounds", "header", "identity"])
    return got.select("n_nationkey", "source", F.round("transform.a", 9).alias("a"), F.round("transform.b", 9).alias("b"))


@query(
    "stage_funnel",
    f"""WITH {BLOB}, s AS (SELECT area >= 50 AS a, area >= 50 AND solidity >= 0.3 AS b, area >= 50 AND solidity >= 0.3 AND aspect <= 4 AS c FROM shape)
    SELECT count(*) AS candidates, count(*) FILTER (a) AS after_area, count(*) FILTER (b) AS after_solidity, count(*) FILTER (c) AS after_aspect FROM s""",
)
def stage_funnel(spark, sf):
    a = F.col("area") >= 50
    b = a & (F.col("solidity") >= 0.3)
    c = b & (F.col("aspect") <= 4)
    return shapes(spark, sf).agg(F.count("*").alias("candidates"), F.count_if(a).alias("after_area"), F.count_if(b).alias("after_solidity"), F.count_if(c).alias("after_aspect"))


@query(
    "summary_stats",
    f"WITH {BLOB} SELECT 'area' AS \"column\", count(area) AS n, min(area)::DOUBLE AS min, max(area)::DOUBLE AS max, round(avg(area), 6) AS mean FROM shape UNION ALL SELECT 'max_dim', count(max_dim), min(max_dim), max(max_dim), round(avg(max_dim), 6) FROM shape",
)
def summary_stats(spark, sf):
    from chartstone.sources.writers import summary

    return summary(shapes(spark, sf), ["area", "max_dim"]).withColumn("mean", F.round("mean", 6))


@query("top_shapes_per_flag", f"WITH {BLOB} SELECT flag, id, area FROM shape QUALIFY row_number() OVER (PARTITION BY flag ORDER BY area DESC, id) <= 50")
def top_shapes_per_flag(spark, sf):
    return suppression.top_per_group(shapes(spark, sf), ["flag"], 50, [F.desc("area"), "id"]).select("flag", "id", "area")


@query(
    "inset_transforms",
    """WITH p AS (SELECT r_regionkey AS chart_id, 1000.0::DOUBLE + 100 * r_regionkey AS pw, 800.0::DOUBLE AS ph, 20.0::DOUBLE + r_regionkey AS a, 0.002::DOUBLE AS b, 40.0::DOUBLE AS d, -0.0015::DOUBLE AS f FROM region),
    i AS (SELECT n_nationkey, n_regionkey AS chart_id, 10 * n_nationkey AS x0, 7 * n_nationkey AS y0, 100.0::DOUBLE + n_nationkey AS w, 90.0::DOUBLE + 2 * n_nationkey AS h FROM nation)
    SELECT n_nationkey, round(a + b * x0, 9) AS a, round(b / (w / pw), 9) AS b, round(d + f * y0, 9) AS d, round(f / (h / ph), 9) AS f FROM i JOIN p USING (chart_id)""",
)
def inset_transforms(spark, sf):
    from chartstone.operators.detectors import inset_transform

    r, k = F.col("r_regionkey"), F.col("n_nationkey")
    zero = F.lit(0.0)
    parents = load(spark, sf, "region").select(
        r.alias("chart_id"), (1000.0 + 100 * r).alias("page_width"), F.lit(800.0).alias("page_height"), (20.0 + r).alias("a"), F.lit(0.002).alias("b"), zero.alias("c"), F.lit(40.0).alias("d"), zero.alias("e"), F.lit(-0.0015).alias("f")
    )
    insets = load(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("chart_id"), (10 * k).alias("x0"), (7 * k).alias("y0"), (100.0 + k).alias("width"), (90.0 + 2 * k).alias("height"))
    return inset_transform(insets, parents).select("n_nationkey", *[F.round(c, 9).alias(c) for c in "abdf"])


@query(
    "dot_candidates",
    f"WITH {BLOB} SELECT id, area, round(least(1, 4 * pi() * area / (greatest(2.0 * (h + w), 1) ** 2)), 9) AS circularity FROM shape WHERE area BETWEEN 6 AND 140 AND least(1, 4 * pi() * area / (greatest(2.0 * (h + w), 1) ** 2)) >= 0.68",
)
def dot_candidates(spark, sf):
    from chartstone.operators.detectors import circularity_of

    c = circularity_of(F.col("area"), 2.0 * (F.col("h") + F.col("w")))
    return shapes(spark, sf).filter(F.col("area").between(6, 140) & (c >= 0.68)).select("id", "area", F.round(c, 9).alias("circularity"))


@query(
    "payload_blocks",
    """WITH b AS (SELECT c_nationkey AS chart_id, c_custkey AS ord, c_name AS text, c_custkey % 900 AS x0, c_custkey % 700 AS y0, (c_custkey % 37) / 3.0::DOUBLE AS size FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 40)
    SELECT chart_id, ord, text, round(40 - 0.0015 * (y0 + 5.0::DOUBLE), 5) AS approx_lat, round(20 + 0.002 * (x0 + 15.0::DOUBLE), 5) AS approx_lon, round(size, 1) AS font_size FROM b""",
)
def payload_blocks(spark, sf):
    from chartstone.operators.detectors import text_payload

    k, zero = F.col("c_custkey"), F.lit(0.0)
    b = load(spark, sf, "customer").select(F.col("c_nationkey").alias("chart_id"), k.alias("ord"), F.col("c_name").alias("text"), (k % 900).alias("x0"), (k % 700).alias("y0"), (k % 900 + 30).alias("x1"), (k % 700 + 10).alias("y1"), ((k % 37) / F.lit(3.0)).alias("size"))
    t = load(spark, sf, "nation").select(F.col("n_nationkey").alias("chart_id"), F.lit(20.0).alias("a"), F.lit(0.002).alias("b"), zero.alias("c"), F.lit(40.0).alias("d"), zero.alias("e"), F.lit(-0.0015).alias("f"))
    return text_payload(b, t, 40)
