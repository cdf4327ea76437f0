"""Every registered query against its DuckDB oracle on the driver's small tables."""

import math

import duckdb
import pandas as pd
import pytest

from chartstone.plans import registry
from chartstone.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list:
    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, str):
            return x
        return round(float(x), 5) + 0.0

    return sorted((tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dot_pairs_are_greedy(spark):
    from chartstone.operators.spatial import theta_pairs
    from chartstone.plans.views import detections

    d = detections(spark, SF).filter("type = 'error'")
    pairs = sorted((r.dx, abs(r.dy), r.a_id, r.b_id) for r in theta_pairs(d, (20, 55), 10).collect())
    used, want = set(), set()
    for _, _, a, b in pairs:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a_id, r.b_id) for r in registry.QUERIES["dot_pairs_greedy"](spark, SF).collect()} == want


def test_change_report_sees_nulls(spark):
    from chartstone.operators.changes import change_report

    old = spark.createDataFrame([(1, 1, None, "x"), (2, 1, 2, "x"), (None, 5, 5, "x"), (3, None, None, "x")], "k int, a int, b int, `_ok0` string")
    new = spark.createDataFrame([(1, None, 1, "y"), (2, 1, 2, "y"), (None, 5, 5, "y"), (4, None, None, "y")], "k int, a int, b int, `_ok0` string")
    got = {r.k: r.change for r in change_report(old, new, ["k"], ["a", "b"]).collect()}
    assert got == {1: "modified", 2: "unchanged", None: "unchanged", 3: "removed", 4: "added"}


def test_medians_are_exact_and_bounded(spark, monkeypatch):
    """Even and odd counts, ties, nulls, wide ranges; a bracket that misses the middle changes nothing."""
    import random
    import statistics

    from chartstone.operators import medians

    rng = random.Random(3)
    rows = [(g, rng.choice((rng.gauss(0, 1), rng.gauss(0, 1) * 1e9, 1.5)), None if g == 2 and i % 3 else float(i)) for g in (1, 2, 3, None) for i in range(700 + (g or 0))] + [(4, 1.0, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    of = lambda g, k: [r[k] for r in rows if r[0] == g and r[k] is not None]
    want = {g: (sum(r[0] == g for r in rows), *(pytest.approx(statistics.median(of(g, k))) if of(g, k) else None for k in (1, 2))) for g in (1, 2, 3, 4, None)}
    for margin in (medians.MARGIN, -0.2):
        monkeypatch.setattr(medians, "MARGIN", margin)
        assert {r.g: (r.n, r.x, r.y) for r in medians.medians(df, "g", ["x", "y"]).collect()} == want


def test_line_intersections_hold_no_group(spark):
    """No aggregate that keeps all values of a group, and no task with all its pairs."""
    from chartstone.operators import spatial

    df = spark.createDataFrame([(i % 2, i) for i in range(3000)], "g int, id int")
    a, b = spatial.block_pairs(df, "g", "id", 100)
    most = b.groupBy("g", "block").count().agg({"count": "max"}).first()[0]
    assert most < 200 and a.count() == 3000 * 15
    plan = registry.QUERIES["line_intersections"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_path_length_follows_its_sql(spark, tmp_path):
    """Lengths to the last bit before rounding, and rows without a price, a key or a customer."""
    from pyspark.sql import functions as F

    from chartstone.functions import geometry as G

    legs = [(a, b) for a in range(1, 60) for b in range(1, 4000, 37)]
    df = spark.createDataFrame([(a, b, [(0.0, 0.0), (float(a), float(b))]) for a, b in legs], "a int, b int, p array<struct<x double, y double>>")
    assert {(r.a, r.b): r.n for r in df.select("a", "b", G.path_length(F.col("p")).alias("n")).collect()} == {(a, b): math.sqrt(a * a + b * b) for a, b in legs}
    orders = [(i if i % 11 else None, i % 40 if i % 40 < 39 else None, None if i % 7 == 3 else i * 7919 % 300_000 + 0.5) for i in range(400)]
    # one order without a key at most for each customer, since the SQL leaves the order of several open
    kept = {}
    for r in orders:
        kept.setdefault((r[1], r[0]), r)
    spark.createDataFrame(list(kept.values()), "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = registry.QUERIES["path_length_track"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.execute(registry.ORACLES["path_length_track"]).df())
