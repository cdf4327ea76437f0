"""Joins by distance, bands and boxes, as equi-joins on grid cells.

A non-equi join would be planned as a nested loop. Here the right side is keyed by its cell of size
``radius``, the left side goes to the cells around it, and the exact condition is checked inside the join.
So data meet by key: sort-merge or hash joins with adaptive skew handling, and nothing is broadcast
unless Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartstone.functions.rules import first_failure


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{p}{c}") for c in df.columns])


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def _around(c: Column) -> Column:
    return F.explode(F.sequence(c - 1, c + 1))


def radius_join(left: DataFrame, right: DataFrame, radius: float, inclusive: bool = False, how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Pairs of points (x, y) closer than ``radius``; columns are prefixed l_ and r_, with ``dist``.

    ``how`` may be inner, left_semi or left_anti; the latter two return left's own columns. left needs a
    unique ``id`` for those.
    """
    lhs = _prefixed(left, "l_").withColumns({"cx": _cell(F.col("l_x"), radius), "cy": _cell(F.col("l_y"), radius)})
    lhs = lhs.withColumn("cx", _around(F.col("cx"))).withColumn("cy", _around(F.col("cy")))
    rhs = _prefixed(right, "r_").withColumns({"_cx": _cell(F.col("r_x"), radius), "_cy": _cell(F.col("r_y"), radius)})
    dist = F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y"))
    near = (dist <= radius) if inclusive else (dist < radius)
    on = (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & near
    if extra is not None:
        on = on & extra
    if how == "inner":
        return lhs.join(rhs, on).withColumn("dist", dist).drop("cx", "cy", "_cx", "_cy")
    found = lhs.join(rhs, on, "left_semi").select(F.col("l_id").alias("_found")).distinct()
    return left.join(found, left["id"] == found["_found"], how)


def block_pairs(df: DataFrame, group: str, key: str, size: int = 512) -> tuple[DataFrame, DataFrame]:
    """Two sides, dealt by (group, block): joined on both, every row meets every row of its group, about ``size`` of them in each block."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.groupBy(F.col(group).alias("_of")).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    placed = df.join(sizes, F.col(group) == F.col("_of")).drop("_of")
    left = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    right = placed.withColumn("block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    return left.drop("_blocks").repartition(n, group, "block"), right.drop("_blocks").repartition(n, group, "block")


def nearest_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """left with right's nearest ``id`` strictly within radius (``near_id``, ``dist``), null if none; ties go to the smaller id."""
    pairs = radius_join(left.select("id", "x", "y"), right.select("id", "x", "y"), radius)
    best = pairs.groupBy(F.col("l_id").alias("_id")).agg(F.min(F.struct("dist", F.col("r_id").alias("id"))).alias("m"))
    return left.join(best, left["id"] == best["_id"], "left").select(*left.columns, F.col("m.id").alias("near_id"), F.col("m.dist").alias("dist"))


def band_join(left: DataFrame, right: DataFrame, column: str, width: float) -> DataFrame:
    """Pairs with |left.column - right.column| < width, prefixed l_ and r_."""
    lhs = _prefixed(left, "l_").withColumn("c", _around(_cell(F.col(f"l_{column}"), width)))
    rhs = _prefixed(right, "r_").withColumn("_c", _cell(F.col(f"r_{column}"), width))
    on = (F.col("c") == F.col("_c")) & (F.abs(F.col(f"l_{column}") - F.col(f"r_{column}")) < width)
    return lhs.join(rhs, on).drop("c", "_c")


def boxes_to_cells(boxes: DataFrame, size: float) -> DataFrame:
    """boxes (x0, y0, x1, y1; half open) with a row for each cell (cx, cy) they touch. Choose ``size`` near the boxes' own."""
    at = lambda c: _cell(F.col(c), size)
    return boxes.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs point (p_...) inside box (b_...), half open."""
    b = _prefixed(boxes_to_cells(boxes, size), "b_")
    p = _prefixed(points, "p_").withColumns({"p_cx": _cell(F.col("p_x"), size), "p_cy": _cell(F.col("p_y"), size)})
    inside = (F.col("p_x") >= F.col("b_x0")) & (F.col("p_x") < F.col("b_x1")) & (F.col("p_y") >= F.col("b_y0")) & (F.col("p_y") < F.col("b_y1"))
    return p.join(b, (F.col("p_cx") == F.col("b_cx")) & (F.col("p_cy") == F.col("b_cy")) & inside).drop("p_cx", "p_cy", "b_cx", "b_cy")


def suppress_in_boxes(points: DataFrame, boxes: DataFrame, margin: float, size: float) -> DataFrame:
    """points (with a unique id) outside all boxes grown by ``margin``."""
    grown = boxes.select((F.col("x0") - margin).alias("x0"), (F.col("y0") - margin).alias("y0"), (F.col("x1") + margin).alias("x1"), (F.col("y1") + margin).alias("y1"))
    hit = points_in_boxes(points.select("id", "x", "y"), grown, size).select(F.col("p_id").alias("_hit")).distinct()
    return points.join(hit, points["id"] == hit["_hit"], "left_anti")


def theta_pairs(points: DataFrame, dx: tuple[float, float], dy: float) -> DataFrame:
    """Pairs a left of b with dx[0] <= x_b - x_a <= dx[1] and |y_b - y_a| <= dy: (a_id, b_id)."""
    sx, sy = float(dx[1]), max(float(dy), 1.0)
    a = points.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    a = a.withColumn("cx", F.explode(F.sequence(_cell(F.col("ax"), sx), _cell(F.col("ax"), sx) + 1))).withColumn("cy", _around(_cell(F.col("ay"), sy)))
    b = points.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by")).withColumns({"_cx": _cell(F.col("bx"), sx), "_cy": _cell(F.col("by"), sy)})
    gap = F.col("bx") - F.col("ax")
    on = (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & gap.between(*dx) & (F.abs(F.col("by") - F.col("ay")) <= dy)
    return a.join(b, on).select("a_id", "b_id", gap.alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))


def ring_samples(rings: DataFrame, least: int = 36) -> DataFrame:
    """rings (id, x, y, r) with a row (sx, sy) for each of max(least, int(2 pi r)) places on the circumference."""
    n = F.greatest(F.lit(least), F.floor(2 * F.pi() * F.col("r")).cast("int"))
    k = rings.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    angle = 2 * F.pi() * F.col("k") / F.col("n")
    at = lambda c, f: F.rint(F.col(c) + F.col("r") * f(angle)).cast("long")
    return k.withColumns({"sx": at("x", F.cos), "sy": at("y", F.sin)})


def ring_coverage(rings: DataFrame, ink: DataFrame, least: int = 36) -> DataFrame:
    """(id, coverage): the share of a ring's places that hold ink (x, y); places outside the image count as misses."""
    pixels = ink.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    s = ring_samples(rings, least)
    hit = s.join(pixels, (F.col("sx") == F.col("_x")) & (F.col("sy") == F.col("_y")), "left")
    return hit.groupBy("id").agg(F.avg(F.col("_x").isNotNull().cast("double")).alias("coverage"))


def box_ink(boxes: DataFrame, ink: DataFrame, size: float) -> DataFrame:
    """Per box (id): ink, top-15%-rows column spread, half inks, bottom-middle ink: the figures of the structural gates."""
    got = points_in_boxes(ink, boxes.select("id", "x0", "y0", "x1", "y1"), size)
    w, h = F.col("b_x1") - F.col("b_x0"), F.col("b_y1") - F.col("b_y0")
    fx, fy = (F.col("p_x") - F.col("b_x0")) / w, (F.col("p_y") - F.col("b_y0")) / h
    top, bottom, middle = fy < 0.15, fy >= 0.85, (fx >= 1 / 3) & (fx < 2 / 3)
    stats = got.groupBy(F.col("b_id").alias("_id")).agg(
        F.count("*").alias("ink"),
        (F.max(F.when(top, F.col("p_x"))) - F.min(F.when(top, F.col("p_x"))) + 1).alias("apex_spread"),
        F.count_if(fx < 0.5).alias("left_ink"),
        F.count_if(fx >= 0.5).alias("right_ink"),
        F.count_if(bottom & middle).alias("base_ink"),
        F.count_if((fx < 0.5) & (fy >= 0.5)).alias("bl_ink"),
        F.count_if((fx >= 0.5) & (fy >= 0.5)).alias("br_ink"),
        F.count_if(fy < 0.5).alias("top_ink"),
    )
    names = [c for c in stats.columns if c != "_id"]
    joined = boxes.join(stats, boxes["id"] == stats["_id"], "left")
    return joined.select(*[boxes[c] for c in boxes.columns], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) if c != "apex_spread" else F.col(c) for c in names])


def gates(stats: DataFrame) -> DataFrame:
    """Open base, apex, symmetry and the quadrant test on the figures of ``box_ink``, and the first that fails."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    base = F.col("base_ink") / F.greatest(F.lit(1.0), w / 3.0 * h * 0.15)
    halves = F.least("left_ink", "right_ink") / F.greatest(F.lit(1), F.greatest("left_ink", "right_ink"))
    reason = first_failure(
        [
            ("empty", F.col("ink") == 0),
            ("open_base", base > 0.10),
            ("apex", F.coalesce(F.col("apex_spread") / w > 0.35, F.lit(True))),
            ("symmetry", halves < 0.40),
        ],
        passed="passed",
    )
    quadrant = (F.col("br_ink") / F.greatest(F.col("bl_ink"), F.lit(1)) <= 0.83) & (F.col("top_ink") / F.greatest(F.lit(1.0), w * h / 2.0) >= 0.15)
    return stats.withColumns({"gate": reason, "letter_r": quadrant})


def match_figures(found: DataFrame, truth: DataFrame, radius: float) -> DataFrame:
    """One row: tp, fp, fn, precision, recall of found against truth (EXISTS within radius, inclusive)."""
    count = lambda df, k: df.agg(F.count("*").alias("n")).withColumn("k", F.lit(k))
    hit = radius_join(found, truth, radius, inclusive=True, how="left_semi")
    missed = radius_join(truth, found, radius, inclusive=True, how="left_anti")
    rows = count(found, "nf").unionByName(count(truth, "nt")).unionByName(count(hit, "tp")).unionByName(count(missed, "fn"))
    total = rows.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("nf", "nt", "tp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return total.select(
        "tp",
        (F.col("nf") - F.col("tp")).alias("fp"),
        "fn",
        ratio(F.col("tp"), F.col("nf")).alias("precision"),
        ratio(F.col("nt") - F.col("fn"), F.col("nt")).alias("recall"),
    )


def first_per_cell(df: DataFrame, cell: int, order: list, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each coarse cell in an explicit order."""
    w = Window.partitionBy(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")
