"""Queries over texts, names, JSON and entity documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartstone.functions import text as T
from chartstone.operators import changes, entities, spatial
from chartstone.plans.registry import query
from chartstone.plans.views import DET, detections
from chartstone.session import load
from chartstone.sources import readers, writers

_TOKENS = "tok AS (SELECT doc_id, upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS t FROM documents)"


def _tokens(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("t")).withColumn("t", F.upper("t"))


_LINES = "line AS (SELECT l_orderkey, l_linenumber, 'X ' || (100 + l_partkey % 250) || '.' || (l_suppkey % 1000) || CASE WHEN l_linenumber % 2 = 0 THEN ' TWR' ELSE '' END || ' ' || (l_partkey % 40) || '.5' AS text FROM lineitem)"


def _lines(spark, sf):
    c = F.col
    tail = F.when(c("l_linenumber") % 2 == 0, " TWR").otherwise("")
    text = F.concat(F.lit("X "), (100 + c("l_partkey") % 250).cast("string"), F.lit("."), (c("l_suppkey") % 1000).cast("string"), tail, F.lit(" "), (c("l_partkey") % 40).cast("string"), F.lit(".5"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))


@query(
    "freq_extract",
    f"""WITH {_LINES}, f AS (SELECT l_orderkey, l_linenumber, unnest(regexp_extract_all(text, '\\b(1[0-3]\\d\\.\\d{{1,3}}|2\\d{{2}}\\.\\d{{1,3}})(?:[^\\d]|$)', 1))::DOUBLE AS mhz FROM line)
    SELECT l_orderkey, mhz, min(l_linenumber)::INT AS first_line FROM f GROUP BY 1, 2""",
)
def freq_extract(spark, sf):
    f = _lines(spark, sf).select("l_orderkey", "l_linenumber", F.explode(T.frequencies(F.col("text"))).alias("mhz")).withColumn("mhz", F.col("mhz").cast("double"))
    return f.groupBy("l_orderkey", "mhz").agg(F.min("l_linenumber").alias("first_line"))


_BLOCKS = """blk AS (SELECT c_nationkey AS chart, c_custkey AS ord, (c_custkey % 50) * 0.0015::DOUBLE AS lat, CASE c_custkey % 5 WHEN 0 THEN 'TOWER' WHEN 1 THEN (118 + c_custkey % 18) || '.' || (c_custkey % 4 * 25 + 100) WHEN 2 THEN 'ATIS' WHEN 3 THEN 'Some words' ELSE 'GERMI' END AS text FROM customer)"""


def _blocks(spark, sf):
    k = F.col("c_custkey")
    freq = F.concat((118 + k % 18).cast("string"), F.lit("."), (k % 4 * 25 + 100).cast("string"))
    text = F.when(k % 5 == 0, "TOWER").when(k % 5 == 1, freq).when(k % 5 == 2, "ATIS").when(k % 5 == 3, "Some words").otherwise("GERMI")
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("chart_id"), k.alias("ord"), text.alias("text"), ((k % 50) * F.lit(0.0015)).alias("lat"), F.lit(None).cast("double").alias("lon"))


@query(
    "row_band_service",
    f"""WITH {_BLOCKS}, f AS (SELECT chart, ord, lat, text::DOUBLE AS mhz FROM blk WHERE text ~ '^[0-9]' QUALIFY row_number() OVER (PARTITION BY chart, text::DOUBLE ORDER BY ord) = 1),
    m AS (SELECT f.chart, f.ord, any_value(f.mhz) AS mhz, bool_or(b.text = 'TOWER') AS tower, bool_or(b.text = 'ATIS') AS atis,
      arg_min(CASE WHEN b.text IN ('TOWER', 'ATIS', 'GERMI') THEN b.text END, b.ord) FILTER (b.text IN ('TOWER', 'ATIS', 'GERMI')) AS sign FROM f JOIN blk b ON b.chart = f.chart AND abs(b.lat - f.lat) < 0.002 GROUP BY 1, 2)
    SELECT chart AS chart_id, sign AS name, mhz AS value, CASE WHEN tower THEN 'TWR' WHEN atis THEN 'ATIS' ELSE 'other' END AS kind, ord FROM m""",
)
def row_band_service(spark, sf):
    return entities.frequencies(_blocks(spark, sf)).select("chart_id", "name", "value", "kind", "ord")


@query(
    "row_band_first",
    f"WITH {DET}, a AS (SELECT * FROM det WHERE type = 'signup'), b AS (SELECT * FROM det WHERE type = 'purchase') SELECT a.id, min(b.id) AS first_id, count(*) AS mates FROM a JOIN b ON abs(a.y - b.y) < 3 GROUP BY 1",
)
def row_band_first(spark, sf):
    d = detections(spark, sf).select("id", "y", "type")
    pairs = spatial.band_join(d.filter("type = 'signup'"), d.filter("type = 'purchase'"), "y", 3.0)
    return pairs.groupBy(F.col("l_id").alias("id")).agg(F.min("r_id").alias("first_id"), F.count("*").alias("mates"))


@query("icao_names", f"WITH {_TOKENS}, n AS (SELECT doc_id, 'L' || (CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'G' END) || substr(t, 1, 2) AS t FROM tok WHERE length(t) >= 2) SELECT t AS code, count(DISTINCT doc_id) AS docs FROM n GROUP BY 1")
def icao_names(spark, sf):
    names = _tokens(spark, sf).filter(F.length("t") >= 2).select("doc_id", F.concat(F.lit("L"), F.when(F.col("doc_id") % 2 == 0, "F").otherwise("G"), F.substring("t", 1, 2)).alias("t"))
    codes = names.select("doc_id", F.explode(T.icao_codes(F.col("t"))).alias("code"))
    return codes.groupBy("code").agg(F.countDistinct("doc_id").alias("docs"))


_BLACK = ", ".join(f"'{w}'" for w in T.NOT_WAYPOINTS)


@query("waypoint_names", f"WITH {_TOKENS} SELECT t AS name, min(doc_id) AS first_doc, count(*) AS n FROM tok WHERE regexp_matches(t, '^[A-Z]{{3,5}}$') AND t NOT IN ({_BLACK}) GROUP BY 1")
def waypoint_names(spark, sf):
    return _tokens(spark, sf).filter(T.is_waypoint(F.col("t"))).groupBy(F.col("t").alias("name")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query(
    "dms_to_dd",
    """WITH t AS (SELECT o_orderkey, o_orderkey % 90 AS d, o_custkey % 60 AS m, (o_orderkey * 7) % 60 AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 's' END AS ns, CASE WHEN o_orderkey % 3 = 0 THEN 'W' ELSE 'E' END AS ew FROM orders)
    SELECT o_orderkey, round((CASE WHEN upper(ns) = 'S' THEN -1 ELSE 1 END) * (d + m / 60.0::DOUBLE + s / 3600.0::DOUBLE), 8) + 0.0 AS lat, round((CASE WHEN ew = 'W' THEN -1 ELSE 1 END) * (d + 10 + m / 60.0::DOUBLE + s / 3600.0::DOUBLE), 8) + 0.0 AS lon FROM t""",
)
def dms_to_dd(spark, sf):
    k, m = F.col("o_orderkey"), F.col("o_custkey") % 60
    part = lambda extra, h: F.concat_ws(" ", (k % 90 + extra).cast("string"), m.cast("string"), ((k * 7) % 60).cast("string"), h)
    text = F.concat_ws(" / ", part(0, F.when(k % 2 == 0, "N").otherwise("s")), part(10, F.when(k % 3 == 0, "W").otherwise("E")))
    t = load(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    at = lambda p: F.round(T.dms_to_degrees(F.col("t"), p), 8) + 0.0
    return t.select("o_orderkey", at(T.LATITUDE).alias("lat"), at(T.LONGITUDE).alias("lon"))


@query(
    "parse_elevation",
    """WITH t AS (SELECT o_orderkey, o_orderkey || '/' || o_custkey || ' x7' AS t FROM orders), g AS (SELECT o_orderkey, list_filter(regexp_extract_all(t, '\\d+'), lambda v: length(v) >= 2) AS g FROM t)
    SELECT o_orderkey, coalesce(g[1], '') AS msl, coalesce(g[2], '') AS agl FROM g""",
)
def parse_elevation(spark, sf):
    t = load(spark, sf, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), F.col("o_custkey").cast("string"), F.lit(" x7")).alias("t"))
    return t.select("o_orderkey", T.elevations(F.col("t")).alias("e")).select("o_orderkey", "e.msl", "e.agl")


@query(
    "obstacle_numbers",
    """WITH t AS (SELECT p_partkey, (p_partkey * 7 % 2600)::VARCHAR AS t, (p_size * 0.0004)::DOUBLE AS lat FROM part), n AS (SELECT p_partkey, t::INT AS height, round_even(lat, 3) AS lat FROM t WHERE regexp_matches(t, '^\\d{3,4}$') AND t::INT BETWEEN 50 AND 2000)
    SELECT lat, arg_min(height, p_partkey) AS height, min(p_partkey) AS p_partkey FROM n GROUP BY 1""",
)
def obstacle_numbers(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 7 % 2600).cast("string").alias("t"), F.bround(F.col("p_size") * F.lit(0.0004), 3).alias("lat"))
    n = p.withColumn("height", T.obstacle_number(F.col("t"))).filter("height is not null")
    return changes.keep_first_by(n, ["lat"], ["p_partkey"]).select("lat", "height", "p_partkey")


_WORDS = ["THE", "THAT", "WITH", "LICENSE", "TOWER"]


@query(
    "keyword_overlap",
    f"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(upper(text), '[A-Z0-9]+')) AS w FROM documents)
    SELECT doc_id, array_to_string(list_filter({_WORDS}, lambda k: list_contains(w, k)), ',') AS hits FROM w WHERE list_has_any(w, {_WORDS})""",
)
def keyword_overlap(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", T.keyword_hits(F.col("text"), _WORDS).alias("h"))
    return d.filter(F.size("h") > 0).select("doc_id", F.array_join("h", ",").alias("hits"))


@query(
    "printable_spans",
    """WITH p AS (SELECT source AS page_id, doc_id, text FROM documents WHERE length(regexp_replace(text, '[^ -~]', '', 'g')) / length(text)::DOUBLE >= 0.95),
    e AS (SELECT page_id FROM p GROUP BY 1 HAVING count(*) >= 20) SELECT page_id, doc_id FROM p WHERE page_id IN (SELECT page_id FROM e)""",
)
def printable_spans(spark, sf):
    d = load(spark, sf, "documents").select(F.col("source").alias("page_id"), "doc_id", "text")
    return readers.keep_readable_pages(d, 0.95, 20).select("page_id", "doc_id")


@query(
    "edge_markers",
    f"""WITH {DET}, t AS (SELECT id, x, y, (id % 50)::VARCHAR AS t FROM det), k AS (SELECT id, t, CASE WHEN length(t) = 2 AND t::INT BETWEEN 34 AND 45 AND (x < 1200 * 0.08 OR x > 1200 * 0.92) THEN 'lat'
      WHEN length(t) = 2 AND t::INT BETWEEN 20 AND 30 AND (y < 5000 * 0.08 OR y > 5000 * 0.92) THEN 'lon' END AS axis FROM t) SELECT id, t AS degrees, axis FROM k WHERE axis IS NOT NULL""",
)
def edge_markers(spark, sf):
    d = detections(spark, sf).withColumn("t", (F.col("id") % 50).cast("string"))
    return d.select("id", F.col("t").alias("degrees"), T.edge_marker(F.col("t"), F.col("x"), F.col("y"), 1200, 5000).alias("axis")).filter("axis is not null")


@query("json_props", "SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, sf):
    """Fenced JSON texts are unwrapped and parsed by schema."""
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    e = load(spark, sf, "events").select("event_type", F.from_json(T.strip_fence(fenced), "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query(
    "json_key_fallback",
    """WITH e AS (SELECT event_id, event_id % 4 AS m, user_id FROM events WHERE event_type = 'purchase')
    SELECT event_id AS doc, user_id AS pixel_x, event_id % 97 AS pixel_y FROM e WHERE m <> 2""",
)
def json_key_fallback(spark, sf):
    """Lists under a known key, an unknown one, none at all, or a known key that is present and empty (which wins)."""
    m = F.col("event_id") % 4
    one = F.format_string('[{"pixel_x": %d, "pixel_y": %d}]', F.col("user_id"), F.col("event_id") % 97)
    doc = (
        F.when(m == 0, F.concat(F.lit('{"widths": [24, 28], "detections": '), one, F.lit("}")))
        .when(m == 1, F.concat(F.lit('{"n": 1, "widths": [24], "found": '), one, F.lit("}")))
        .when(m == 2, F.concat(F.lit('{"obstacles": [], "other": '), one, F.lit("}")))
        .otherwise(one)
    )
    e = load(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("doc"), doc.alias("json"))
    return readers.explode_detections(e, "json", "pixel_x long, pixel_y long")


@query(
    "entity_document",
    """WITH e AS (SELECT r_name AS chart_id, 'waypoints' AS category, n_name AS name, n_nationkey::DOUBLE AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
      UNION ALL SELECT r_name, 'nhp', n_name, n_nationkey::DOUBLE FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)
    SELECT chart_id, count(*) FILTER (category = 'waypoints') AS waypoints, count(*) FILTER (category = 'nhp') AS nhp, 0::BIGINT AS routes, round(sum(value), 6) AS total FROM e GROUP BY 1""",
)
def entity_document(spark, sf):
    """Documents are assembled as JSON with every category, then flattened again for the comparison."""
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda c: [F.col("r_name").alias("chart_id"), F.lit(c).alias("category"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("value"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")]
    e = n.filter("n_nationkey % 2 = 0").select(*row("waypoints")).unionByName(n.filter("n_nationkey % 3 = 0").select(*row("nhp")))
    doc = writers.entity_document(e, ["waypoints", "nhp", "routes"])
    item = "array<struct<name:string,value:double>>"
    d = doc.select("chart_id", F.from_json("doc", f"waypoints {item}, nhp {item}, routes {item}").alias("d"))
    total = F.aggregate(F.concat("d.waypoints", "d.nhp"), F.lit(0.0), lambda a, x: a + x["value"])
    return d.select("chart_id", *[F.size(f"d.{c}").cast("long").alias(c) for c in ("waypoints", "nhp", "routes")], F.round(total, 6).alias("total"))


@query(
    "ocr_filter",
    """SELECT event_type, count(*) AS n, count(*) FILTER (conf >= 0.4) AS kept, (100 * count(*) FILTER (conf >= 0.4)) // greatest(count(*), 1) AS percent FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN event_id % 101 / 100.0::DOUBLE ELSE (event_id % 101)::DOUBLE / 100 END AS conf FROM events) GROUP BY 1""",
)
def ocr_filter(spark, sf):
    """Confidences of two engines (0..1 and 0..100) brought to one scale."""
    k = F.col("event_id")
    engine = F.when(k % 2 == 0, "unit").otherwise("percent")
    raw = F.when(k % 2 == 0, (k % 101) / F.lit(100.0)).otherwise((k % 101).cast("double"))
    e = load(spark, sf, "events").select("event_type", engine.alias("engine"), raw.alias("raw"))
    e = e.withColumn("conf", F.when(F.col("engine") == "percent", F.col("raw") / 100).otherwise(F.col("raw")))
    kept = F.count_if(F.col("conf") >= 0.4)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), kept.alias("kept"), F.expr("(100 * count_if(conf >= 0.4)) div greatest(count(*), 1)").alias("percent"))


@query(
    "category_counts",
    """WITH e AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'waypoints' WHEN p_size % 3 = 1 THEN 'routes' ELSE 'obstacles' END AS category FROM part), c AS (SELECT category, count(*) AS n FROM e GROUP BY 1)
    SELECT k.category, coalesce(n, 0) AS n FROM (SELECT unnest(['waypoints', 'frequencies', 'holding_patterns', 'routes', 'nhp', 'obstacles', 'heli_routes', 'other']) AS category) k LEFT JOIN c USING (category)""",
)
def category_counts(spark, sf):
    s = F.col("p_size") % 3
    e = load(spark, sf, "part").select(F.when(s == 0, "waypoints").when(s == 1, "routes").otherwise("obstacles").alias("category"))
    return entities.category_counts(e)


@query("visible_items", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 5 = 0 THEN 9.5::DOUBLE ELSE n_nationkey % 3 END AS lat, CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 5 = 0 THEN 8.5::DOUBLE ELSE n_nationkey % 5 END AS lon FROM nation")
def visible_items(spark, sf):
    """Items without a position (null or zero) fall back to the reference point."""
    k = F.col("n_nationkey")
    n = load(spark, sf, "nation").select("n_nationkey", F.nullif((k % 3).cast("double"), F.lit(0.0)).alias("a"), F.nullif((k % 5).cast("double"), F.lit(0.0)).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return n.select("n_nationkey", F.when(both, F.col("a")).otherwise(9.5).alias("lat"), F.when(both, F.col("b")).otherwise(8.5).alias("lon"))
