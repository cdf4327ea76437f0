"""Tiles, seams, sources, sinks, entities and whole chains on drawn scenes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartstone.functions import color, rules
from chartstone.functions import text as T
from chartstone.operators import changes, entities, fit, kernels as K, ordering, suppression, tiles
from chartstone.plans import pipelines as P
from chartstone.sources import readers, writers
from chartstone.streaming import ingest

IMAGE = "chart_id string, height int, width int, channels int, data binary"


def as_images(spark, **charts):
    rows = [(name, a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], bytearray(np.ascontiguousarray(a).tobytes())) for name, a in charts.items()]
    return spark.createDataFrame(rows, IMAGE)


def mask_image(m):
    return m.astype(np.uint8) * 255


def ring_at(m, cy, cx, r=20, stroke=3):
    yy, xx = np.mgrid[: m.shape[0], : m.shape[1]]
    d = np.hypot(yy - cy, xx - cx)
    m |= (d >= r - stroke / 2) & (d <= r + stroke / 2)


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(3)
    m = rng.random((150, 170)) < 0.08
    ring_at(m, 64, 64)  # across four tiles of 64
    m[10:30, 100:160] = True
    m[63:66, 5:60] = True
    return m


def test_grid_and_ownership(spark):
    charts = spark.createDataFrame([("a", 150, 170), ("b", 64, 64)], "chart_id string, height int, width int")
    g = tiles.grid(charts, 64, 8).collect()
    assert len(g) == 9 + 1
    assert sum((r.y1 - r.y0) * (r.x1 - r.x0) for r in g if r.chart_id == "a") == 150 * 170
    pts = spark.range(500).selectExpr("id", "id * 7 % 150 as y", "id * 13 % 170 as x")
    t = tiles.assign(pts, 64, 8)
    assert t.filter("owner").count() == 500 and t.groupBy("id").count().agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("tile", [32, 64, 200])
def test_components_do_not_depend_on_tiles(spark, scene, tile):
    t = tiles.cut(spark, as_images(spark, c=mask_image(scene)), tile)
    runs = tiles.components_across(t, tile)
    got = sorted((r.area, r.y0, r.x0, r.y1, r.x1, round(r.cy, 6), round(r.cx, 6)) for r in tiles.component_stats(runs).collect())
    want = sorted((g["area"], g["y0"], g["x0"], g["y1"], g["x1"], round(g["cy"], 6), round(g["cx"], 6)) for g in K.region_table(*K.label(scene)))
    assert got == want
    charts = spark.createDataFrame([("c", *scene.shape), ("empty", 10, 10)], "chart_id string, height int, width int")
    cover = {r.chart_id: r.percent for r in tiles.coverage(runs, charts).collect()}
    assert cover["c"] == pytest.approx(100 * scene.mean()) and cover["empty"] == 0


def test_measured_components(spark, scene):
    _, table = P.components(tiles.cut(spark, as_images(spark, c=mask_image(scene)), 64), 64)
    got = sorted((r.area, r.y0, r.x0, round(r.perimeter, 6), round(r.solidity, 6), round(r.eccentricity, 6), r.euler) for r in table.collect())
    want = sorted((g["area"], g["y0"], g["x0"], round(g["perimeter"], 6), round(g["solidity"], 6), round(g["eccentricity"], 6), g["euler"]) for g in K.region_table(*K.label(scene)))
    assert got == want


def test_large_components_are_measured(spark):
    m = np.zeros((60, 4300), bool)
    m[10, 3:4290] = m[10:50, 4000] = m[49, 2000:4001] = True
    m[20:30, 4000:4020] = True
    m[23:26, 4005:4010] = False
    _, table = P.components(tiles.cut(spark, as_images(spark, c=mask_image(m)), 512), 512)
    (want,) = K.region_table(*K.label(m))
    (got,) = table.collect()
    names = ("perimeter", "solidity", "eccentricity", "euler")
    assert [round(got[n], 6) for n in names] == [round(want[n], 6) for n in names]
    y, x = np.nonzero(m)
    for cells in (1, 20_000, 1 << 20):  # bands of one row, of some, and one band
        part = K.run_measures(y, x, x + 1, cells)
        assert [round(part[n], 6) for n in names] == [round(want[n], 6) for n in names]


def test_binarise_equals_whole_chart(spark):
    rng = np.random.default_rng(0)
    grey = np.clip(200 + rng.normal(0, 8, (120, 140)), 0, 255)
    grey[30:34, 20:120] = 20
    grey[50:110, 60:63] = 30
    a = np.repeat(grey.astype(np.uint8)[..., None], 3, 2)
    t = P.binarise(tiles.cut(spark, as_images(spark, c=a), 64, 13))
    whole = K.sauvola(K.to_grey(a))
    for r in t.collect():
        got = tiles.pixels(r)[r.y0 - r.py : r.y1 - r.py, r.x0 - r.px : r.x1 - r.px] > 128
        assert (got == whole[r.y0 : r.y1, r.x0 : r.x1]).all()


def test_skew_and_deskew(spark):
    m = np.zeros((220, 300), bool)
    m[30:190:25] = True
    tilted = K.rotate(m, 1.5)
    images = as_images(spark, level=mask_image(m), tilted=mask_image(tilted), empty=np.zeros((50, 50), np.uint8))
    angles = {r.chart_id: r.angle for r in P.skew(tiles.cut(spark, images, 128)).collect()}
    assert abs(angles["level"]) <= 0.2 and abs(abs(angles["tilted"]) - 1.5) <= 0.3 and angles["empty"] == 0
    turned = P.deskew(images, P.skew(tiles.cut(spark, images, 128)))
    assert turned.count() == 3


def test_rings_and_georeference(spark):
    m = np.zeros((260, 260), bool)
    for cy, cx in ((60, 70), (128, 128), (200, 190)):
        ring_at(m, cy, cx)
    t = tiles.cut(spark, as_images(spark, c=mask_image(m)), 128, 40)
    found = P.rings(t).orderBy("y").collect()
    assert [(abs(r.y - y) <= 1, abs(r.x - x) <= 1) for r, (y, x) in zip(found, ((60, 70), (128, 128), (200, 190)))] == [(True, True)] * 3 and len(found) == 3
    assert not any(r.r_verified for r in found)
    gcps = spark.createDataFrame([(1512.0, 0.0, -79.0, 40.0), (8385.0, 0.0, -72.0, 40.0), (1512.0, 6173.0, -79.0, 36.0), (8385.0, 6173.0, -72.0, 36.0)], "px double, py double, lon double, lat double")
    model = fit.fit_plane(gcps).first()
    assert model.a == pytest.approx(-80.53993889, abs=1e-7) and model.b == pytest.approx(0.0010184781, abs=1e-9) and model.f == pytest.approx(-0.00064798315, abs=1e-9)
    assert fit.reprojection(gcps, fit.fit_plane(gcps)).first().mean_error_km < 1e-9
    g = P.georeferenced(P.rings(t), gcps).collect()
    assert all(r.tier in ("HIGH", "MEDIUM", "LOW") for r in g)
    empty = tiles.cut(spark, as_images(spark, c=np.zeros((64, 64), np.uint8)), 64)
    assert P.rings(empty).count() == 0


def test_obstacles(spark):
    v = K.open_v(24)
    m = np.zeros((200, 220), bool)
    for y, x in ((20, 30), (110, 115), (120, 30)):  # one across the seams at 128
        m[y : y + v.shape[0], x : x + 24] |= v
    m[20 + v.shape[0] + 3 : 20 + v.shape[0] + 6, 41:44] = True
    t = tiles.cut(spark, as_images(spark, c=mask_image(m)), 128, 64)
    runs = tiles.components_across(tiles.cut(spark, as_images(spark, c=mask_image(m)), 128), 128)
    found = P.obstacles(t, runs, widths=(24,)).collect()
    assert sorted((r.y - v.shape[0] // 2, r.x - 12) for r in found) == [(20, 30), (110, 115), (120, 30)]
    assert [r.dot_found for r in sorted(found, key=lambda r: r.y)] == [True, False, False]


def test_colour_layers(spark):
    a = np.zeros((40, 60, 3), np.uint8)
    a[:, :30] = (255, 0, 120)
    a[:, 30:] = (10, 80, 200)
    t = tiles.cut(spark, as_images(spark, c=a), 32)
    got = {r.family: r.percent for r in P.layers(t).collect()}
    assert got == {"magenta": 50.0, "blue": 50.0}
    blue = next(f for f in color.FAMILIES if f.name == "blue")
    assert sum(int((tiles.pixels(r) > 128).sum()) for r in P.family_mask(t, blue).collect()) == 40 * 30
    px = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 255)], "r int, g int, b int")
    import colorsys

    for r in px.select("*", color.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect():
        assert tuple(r.c) == pytest.approx(colorsys.rgb_to_hsv(r.r / 255, r.g / 255, r.b / 255))


def test_bisector_circles(spark):
    m = np.zeros((120, 120), bool)
    ring_at(m, 60, 58, 21, 2)
    runs, table = P.components(tiles.cut(spark, as_images(spark, c=mask_image(m)), 64), 64)
    best = P.bisector_circles(table, runs, least=40).orderBy(F.desc("members")).first()
    assert abs(best.cx - 58) <= 2 and abs(best.cy - 60) <= 2


def test_nms_does_not_depend_on_order_or_chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(rng.integers(0, 200, 400), rng.integers(0, 200, 400), rng.integers(0, 30, 400)))]
    kept: list = []
    for i, x, y, s in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 18**2 for _, a, b in kept):
            kept.append((i, x, y))
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], "id long, x double, y double, score double").repartition(parts)
        assert {r.id for r in suppression.greedy_nms(df, 18.0).collect()} == {i for i, _, _ in kept}
    assert suppression.greedy_nms(spark.createDataFrame([], "id long, x double, y double, score double"), 18.0).count() == 0
    n = ordering.number_rows(spark.createDataFrame(rows, "id long, x double, y double, score double").repartition(5), ["score", "id"]).collect()
    assert [r.place for r in sorted(n, key=lambda r: (r.score, r.id))] == list(range(1, 401))


def test_pictures(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (12, 15, 3)).astype(np.uint8)
    (tmp_path / "chart one.png").write_bytes(writers.encode_png(rgb))
    (tmp_path / "mask.png").write_bytes(writers.encode_png(rgb[..., 0] > 128))
    assert (readers.decode_png(writers.encode_png(rgb)) == rgb).all()
    got = {r.chart_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in readers.read_pictures(spark, str(tmp_path)).collect()}
    assert (got["chart one"] == rgb).all() and ((got["mask"][..., 0] > 128) == (rgb[..., 0] > 128)).all()
    assert readers.read_templates(spark, str(tmp_path / "mask.png"))["mask"].shape == (12, 15)
    small = readers.fit_pictures(readers.read_pictures(spark, str(tmp_path)), 6, 5).collect()
    assert {(r.height, r.width) for r in small} == {(6, 5)}
    t = tiles.cut(spark, as_images(spark, c=mask_image(rgb[..., 0] > 128)), 8, 2)
    pngs = {(r.ty, r.tx): readers.decode_png(r.png)[..., 0] for r in writers.tiles_as_png(t).collect()}
    assert (np.block([[pngs[0, 0], pngs[0, 1]], [pngs[1, 0], pngs[1, 1]]]) > 128).tolist() == (rgb[..., 0] > 128).tolist()
    with pytest.raises(NotImplementedError):
        readers.read_pdf(spark, str(tmp_path))
    df = spark.createDataFrame([("a.PNG",), ("b.tiff",), ("c.pdf",)], "p string")
    assert [r[0] for r in df.select(readers.file_kind(F.col("p"))).collect()] == ["image", "image", "pdf"]
    with pytest.raises(Exception, match="unsupported"):
        spark.createDataFrame([("d.txt",)], "p string").select(readers.file_kind(F.col("p"))).collect()


def test_json_and_csv(spark, tmp_path):
    for name, doc in (("a", {"widths": [24], "obstacles": [{"pixel_x": 1, "pixel_y": 2}]}), ("b", {"n": 3, "odd": [{"pixel_x": 5}]}), ("c", {"detections": [], "other": [{"pixel_x": 9}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    got = readers.read_detections(spark, str(tmp_path / "*.json")).collect()
    assert sorted((r.pixel_x, r.pixel_y) for r in got if r.pixel_y) == [(1, 2)] and {r.pixel_x for r in got} == {1, 5}
    (tmp_path / "bad.json").write_text('{"n": 1}')
    with pytest.raises(Exception, match="no list"):
        readers.read_detections(spark, str(tmp_path / "bad.json")).collect()
    empty = spark.createDataFrame([], "id long, tier string, lon double, lat double")
    writers.write_csv(empty, str(tmp_path / "csv"))
    writers.write_features(writers.geojson_features(empty), str(tmp_path / "geo"))
    assert writers.feature_collection(writers.geojson_features(empty)) == '{"type": "FeatureCollection", "features": []}'
    one = spark.createDataFrame([(1, "HIGH", -77.5, 39.0), (2, "LOW", 1.0, 2.0)], "id long, tier string, lon double, lat double")
    doc = json.loads(writers.feature_collection(writers.geojson_features(one)))
    assert doc["features"] == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [-77.5, 39.0]}, "properties": {"id": 1, "tier": "HIGH"}}]
    writers.write_csv(one, str(tmp_path / "csv"))
    assert readers.read_detections_csv(spark, str(tmp_path / "csv")).count() == 2
    log = writers.run_log(spark, "binarise", {"k": 0.2}, {"ink": 3}, [], 0.0).first()
    assert log.params == {"k": "0.2"} and log.elapsed_sec > 0
    assert writers.summary(one, ["lat"]).first().mean == 20.5


BLOCKS = "chart_id string, ord long, text string, lat double, lon double"
SYMBOLS = "chart_id string, ord long, type string, label string, lat double, lon double"
PATHS = "chart_id string, ord long, points array<struct<x:double,y:double>>"


def test_entities(spark):
    texts = [
        ("118.125", 1.0), ("TOWER WEST", 1.0015), ("LGAV", 2.0), ("38 30 00 N", 3.0), ("23 15 30 E", 3.0), ("GERMI", 4.0), ("GERMI", 4.5), ("VOR", 5.0), ("CRANE 350 ft", 6.0), ("1234", 7.0),
        ("1235", 7.0), ("7", 8.0), ("", 9.0), ("NHP ALPHA", 10.0), ("HOLDING 270", 11.0), ("ALT AD : 308", 12.0), ("HELIPORT X", 13.0), ("UL607 B1", 14.0), ("RWY 03", 15.0), ("39.9 300.10", 16.0), ("118.125", 17.0),
    ]
    blocks = spark.createDataFrame([("c", i, t, lat, 20.0) for i, (t, lat) in enumerate(texts)] + [("d", 0, "121.5", None, None)], BLOCKS)
    symbols = spark.createDataFrame([("c", 0, "waypoint", None, 1.0, 2.0), ("c", 1, "waypoint", "VOR", 1.0, 2.0), ("c", 2, "helipad", "H12", 1.0, 2.0), ("c", 3, "helipad", "X", 1.0, 2.0), ("c", 4, "nhp", "", 1.0, 2.0)], SYMBOLS)
    paths = spark.createDataFrame([("c", 0, [(0.0, 0.0), (0.0, -150.0)]), ("c", 1, [(0.0, 0.0), (3.0, 4.0)]), ("c", 2, [])], PATHS)
    found, bad = P.document_chain(blocks, symbols, paths, spark.createDataFrame([("GERMI",)], "name string"))
    by: dict = {}
    for r in found.collect():
        by.setdefault((r.chart_id, r.category), []).append((r.name, r.value, r.kind))
    assert by["c", "frequencies"] == [("TOWER WEST", 118.125, "TWR")] and by["d", "frequencies"] == [(None, 121.5, "other")]
    assert sorted(n for n, _, _ in by["c", "waypoints"]) == ["GERMI", "LGAV", "UNKNOWN"]
    assert sorted(by["c", "obstacles"]) == [("CRANE 350 ft", 350.0, None), ("Height 1234 ft", 1234.0, None), ("TOWER WEST", None, None)]
    assert by["c", "holding_patterns"] == [("HOLDING 270", 270.0, None)]
    assert sorted(by["c", "routes"], key=str) == sorted([("UL607", None, None), ("B1", None, None), (None, 0.0, "vector_path")], key=str)
    assert sorted(n for n, _, _ in by["c", "nhp"]) == ["NHP ALPHA", "UNKNOWN"] and sorted(n for n, _, _ in by["c", "heli_routes"]) == ["H12", "HELIPORT X"]
    port = entities.airport_object(found).first()
    assert (port.icao, port.elevation_ft, port.lat, port.runways) == ("LGAV", 308.0, 38.5, ["RWY 03"]) and port.lon == pytest.approx(23.2583333)
    assert {r.name for r in found.filter("verified").collect()} == {"GERMI"}
    assert {(r.category, r.rule) for r in bad.collect()} <= {("obstacles", "missing_coordinates"), ("waypoints", "missing_coordinates"), ("frequencies", "missing_value")}
    assert entities.category_counts(found.limit(0)).agg(F.sum("n")).first()[0] == 0
    none = entities.extract(blocks.limit(0), symbols.limit(0), paths.limit(0))
    assert none.count() == 0


def test_changes(spark):
    s = "name string, lat double, lon double, ord long"
    old = spark.createDataFrame([("A", 1.0, 1.0, 0), ("B", 1.0, 1.0, 1), ("C", None, 1.0, 2), ("A", 2.0, 1.0, 3)], s)
    new = spark.createDataFrame([("A", 2.009, 1.0, 0), ("B", 1.011, 1.0, 1), ("C", 38.0, 1.0, 2), ("D", 1.0, 1.0, 3)], s)
    assert {(r.name, r.null_involved) for r in changes.drifts(old, new).collect()} == {("B", False), ("C", True)}
    got = {r.name: r.change for r in changes.change_report(old, new, ["name"], ["lat", "lon"]).collect()}
    assert got == {"A": "modified", "B": "modified", "C": "modified", "D": "added"}


def test_labels_and_elevations(spark):
    symbols = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "id long, x double, y double")
    blocks = spark.createDataFrame([(7, 30.0, 0.0, "far"), (8, 0.0, 20.0, "near"), (9, 560.0, 0.0, "edge")], "id long, x double, y double, text string")
    assert {r.id: r.label for r in P.label_symbols(symbols, blocks).collect()} == {1: "near", 2: None}
    g = spark.createDataFrame([("c", 1, 60, 70, "HIGH"), ("c", 2, 10, 10, "LOW")], "chart_id string, id long, x long, y long, tier string")
    t = tiles.cut(spark, as_images(spark, c=np.full((128, 128), 200, np.uint8)), 64, 60)
    got = P.elevations(g, t, lambda patch: f"1234/456 {patch.shape[0] * 0 + 7}").collect()
    assert [(r.id, r.elevation_msl_ft, r.elevation_agl_ft) for r in got] == [(1, "1234", "456")]
    parts = {"circle": spark.createDataFrame([(1, 10.0, 10.0, 0.9)], "id long, x double, y double, score double"), "dot": spark.createDataFrame([(2, 15.0, 10.0, 0.99), (3, 90.0, 90.0, 0.5)], "id long, x double, y double, score double")}
    assert {(r.id, r.type) for r in P.all_detections(parts).collect()} == {(1, "circle"), (3, "spot_elevation")}


def test_tiers_and_text(spark):
    df = spark.createDataFrame([(0.90,), (0.8999,), (0.75,), (0.55,), (0.5499,), (0.0,), (None,)], "s double")
    assert [r[0] for r in df.select(rules.tier(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "MARGINAL", "MARGINAL", "MARGINAL"]
    t = spark.createDataFrame([("```json\n{}\n```",), ("{}",)], "t string")
    assert [r[0] for r in t.select(T.strip_fence(F.col("t"))).collect()] == ["{}", "{}"]
    p = spark.createDataFrame([("1", "abc"), ("1", "\u0001\u0002x")] * 5, "page_id string, text string")
    assert readers.keep_readable_pages(p).count() == 5 and readers.keep_readable_pages(p, 0.5, 6).count() == 0


def test_classifier_falls_back(spark):
    payload = spark.createDataFrame([("c", "x")], "chart_id string, payload string")
    assert P.classify(spark, payload) is None
    got = P.classify(spark, payload, lambda _: '```json\n[{"category": "nhp", "name": "A"}]\n```').collect()
    assert [(r.chart_id, r.category, r.name) for r in got] == [("c", "nhp", "A")]


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"12345")
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b.select("chart_id", F.length("content").alias("n")))
    ingest.ingest(spark, *args)
    (tmp_path / "in" / "b.png").write_bytes(b"1")
    ingest.ingest(spark, *args)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 5), ("b", 1)]
