"""Suppression, pairing and clustering of detections.

Greedy suppression looks sequential, yet its outcome inside one connected component of the conflict graph
does not depend on other components. So conflicts are found by a radius join, components by
union-find inside large cells, then by hooking and contraction of what crosses them, and the greedy pass runs per component with the total order (score desc, id asc). Rows without a conflict
never leave the JVM. A component that grows past one task's memory would need a chart whose detections overlap
without a gap.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartstone.operators.spatial import radius_join, theta_pairs
from chartstone.operators.tables import written


#: Side of the cells in which conflicts are merged before the graph is contracted, in radii.
CELL_RADII = 64
#: Rows with conflicts that one greedy pass takes, about.
BUCKET_ROWS = 20_000


def _follow(table: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    p = pointers.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
    return table.join(p, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_to", column)).drop("_id", "_to")


def components(edges: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """edges (u, v) -> (id, to): the smallest vertex of each vertex's component.

    A round hooks vertices to their smallest neighbour, follows the hooks three deep and contracts the edges.
    ``local`` (id, to) may merge what is near beforehand; it must name every vertex.
    """
    order = lambda df: df.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    contract = lambda df, to: order(_follow(_follow(df, "u", to), "v", to))
    maps = [] if local is None else [local]
    live = written(order(edges) if local is None else contract(edges, local))
    while not live.isEmpty():
        both = live.select(F.col("u").alias("id"), F.col("v").alias("n")).unionByName(live.select(F.col("v").alias("id"), F.col("u").alias("n")))
        hook = written(both.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("to")))
        jump = written(_follow(_follow(hook, "to", hook), "to", hook))
        maps.append(jump)
        live = written(contract(live, jump))
    if not maps:
        return edges.sparkSession.createDataFrame([], "id long, to long")
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        out = written(_follow(earlier, "to", out))
    return out


def merged_in_cells(pairs: DataFrame) -> DataFrame:
    """(id, to) for every vertex of pairs (u, v, cu, cv): components of the edges inside each cell, by union-find in one task a cell."""
    inside = pairs.filter("cu = cv").select(F.col("cu").alias("cell"), "u", "v")
    across = pairs.filter("cu <> cv")
    alone = lambda c, i: across.select(F.col(c).alias("cell"), F.col(i).alias("u"), F.col(i).alias("v")).distinct()

    def join(g: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for u, v in zip(g["u"].tolist(), g["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        return pd.DataFrame([(i, find(i)) for i in list(parent)], columns=["id", "to"])

    every = inside.unionByName(alone("cu", "u")).unionByName(alone("cv", "v"))
    return written(every.groupBy("cell").applyInPandas(join, "id long, to long"))


def greedy_nms(df: DataFrame, radius: float, pair_radius: Column | None = None) -> DataFrame:
    """The rows that greedy suppression keeps: by falling score (ties by id), a row goes if a kept one is strictly closer than the limit.

    df has id, x, y, score; ``radius`` bounds all limits. ``pair_radius`` is a limit of the pair over l_ and r_ columns
    (default: radius), for limits such as the mean width of both.
    """
    near = None if pair_radius is None else F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")) < pair_radius
    first = F.col("l_id") < F.col("r_id")
    pairs = radius_join(df, df, radius, extra=first if near is None else first & near)
    cell = lambda p: F.struct(F.floor(F.col(f"{p}_x") / (CELL_RADII * radius)).alias("cx"), F.floor(F.col(f"{p}_y") / (CELL_RADII * radius)).alias("cy"))
    edges = written(pairs.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"), cell("l").alias("cu"), cell("r").alias("cv")).distinct())
    roots = components(edges.select("u", "v"), merged_in_cells(edges))
    # components are independent, so a task takes many at once
    buckets = max(1, roots.count() // BUCKET_ROWS)
    group = lambda name: roots.select(F.col("id").alias("_id"), F.pmod(F.xxhash64("to"), buckets).alias(name))
    scored = df.select("id", "score").join(group("a"), F.col("id") == F.col("_id")).select("id", "score", "a")
    links = edges.join(group("b"), F.col("u") == F.col("_id")).select("u", "v", "b")

    def choose(key, nodes: pd.DataFrame, conflicts: pd.DataFrame) -> pd.DataFrame:
        against: dict[int, list[int]] = {}
        for u, v in zip(conflicts["u"].tolist(), conflicts["v"].tolist()):
            against.setdefault(u, []).append(v)
            against.setdefault(v, []).append(u)
        kept: set[int] = set()
        for i in nodes.sort_values(["score", "id"], ascending=[False, True])["id"].tolist():
            if kept.isdisjoint(against.get(i, ())):
                kept.add(i)
        gone = [i for i in nodes["id"] if i not in kept]
        return pd.DataFrame({"gone": pd.Series(gone, dtype="int64")})

    gone = scored.groupBy("a").cogroup(links.groupBy("b")).applyInPandas(choose, "gone long")
    return df.join(gone, df["id"] == gone["gone"], "left_anti")


def local_maxima(df: DataFrame, radius: float) -> DataFrame:
    """Rows with no higher-scored row (ties: smaller id) strictly within radius: one pass, order-free."""
    higher = (F.col("r_score") > F.col("l_score")) | ((F.col("r_score") == F.col("l_score")) & (F.col("r_id") < F.col("l_id")))
    beaten = radius_join(df, df, radius, extra=higher).select(F.col("l_id").alias("_b")).distinct()
    return df.join(beaten, df["id"] == beaten["_b"], "left_anti")


def top_per_group(df: DataFrame, group: list[str], n: int, order: list) -> DataFrame:
    """First n rows of each group; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def greedy_pairs(points: DataFrame, dx: tuple[float, float], dy: float) -> DataFrame:
    """One-to-one dot pairs: theta pairs taken greedily by (dx, |dy|, ids), each dot once."""
    pairs = written(theta_pairs(points, dx, dy))
    roots = components(pairs.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    grouped = pairs.join(roots, pairs["a_id"] == roots["id"]).select("a_id", "b_id", "dx", "dy", "to")

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        g = g.assign(ady=g["dy"].abs()).sort_values(["dx", "ady", "a_id", "b_id"])
        for a, b in zip(g["a_id"], g["b_id"]):
            if a not in used and b not in used:
                used.update((a, b))
                out.append((a, b))
        return pd.DataFrame(out, columns=["a_id", "b_id"])

    return grouped.groupBy("to").applyInPandas(choose, "a_id long, b_id long")


def vote_grid(points: DataFrame, cell: int, least: int) -> DataFrame:
    """Cells (gx, gy) with at least ``least`` votes."""
    grid = points.groupBy(F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).agg(F.count("*").alias("votes"))
    return grid.filter(F.col("votes") >= least)


def grid_clusters(points: DataFrame, cell: int, least: int) -> DataFrame:
    """Order-free grid clusters: a cell with the most votes among its 8 neighbours (ties: smaller cell) takes the 3x3 block's median centre."""
    at = points.select(F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"), "x", "y")
    votes = at.groupBy("gx", "gy").agg(F.count("*").alias("n"))
    offsets = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = votes.withColumn("ox", offsets).withColumn("oy", offsets).select((F.col("gx") + F.col("ox")).alias("_gx"), (F.col("gy") + F.col("oy")).alias("_gy"), F.col("n").alias("_n"), F.col("gx").alias("hx"), F.col("gy").alias("hy"))
    joined = votes.join(spread, (F.col("gx") == F.col("_gx")) & (F.col("gy") == F.col("_gy")))
    best = F.max(F.struct("_n", (-F.col("hx")).alias("a"), (-F.col("hy")).alias("b")))
    peaks = joined.groupBy("gx", "gy", "n").agg(best.alias("m")).filter((F.col("m.a") == -F.col("gx")) & (F.col("m.b") == -F.col("gy")) & (F.col("n") >= least))
    block = peaks.select("gx", "gy").withColumn("ox", offsets).withColumn("oy", offsets)
    block = block.select(F.col("gx").alias("px"), F.col("gy").alias("py"), (F.col("gx") + F.col("ox")).alias("bx"), (F.col("gy") + F.col("oy")).alias("by"))
    members = block.join(at, (F.col("bx") == F.col("gx")) & (F.col("by") == F.col("gy")))
    return members.groupBy("px", "py").agg(F.count("*").alias("members"), F.median("x").alias("cx"), F.median("y").alias("cy"))
