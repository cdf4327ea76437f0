"""Exact medians of groups of any size: no task holds the values of a group.

A sketch of bounded size brackets each median, rows are counted by value inside the bracket and by side outside it, and the middle is read
from the running count. A group whose middle is not inside its bracket is counted by value throughout, so the sketch moves work, not
results. The rows are computed anew in each pass instead of being written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartstone.operators.tables import written

#: The sketch's accuracy (an error of 1/ACCURACY of the ranks) and the share of ranks to each side of the middle that the bracket aims at.
ACCURACY, MARGIN = 2000, 0.002


def _counted(df: DataFrame, group: str, columns: list[str], bounds: DataFrame) -> DataFrame:
    """(_g, k, side, v, c): rows by value inside the bounds of column k (null bounds: everywhere), by side and no value outside."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v"), F.col(f"_b{k}").alias("b")) for k, c in enumerate(columns)]))
    joined = df.join(bounds, df[group].eqNullSafe(bounds["_g"])).select("_g", each.alias("e")).select("_g", "e.*").filter("v is not null")
    side = F.when(F.col("v") < F.get("b", 0), -1).when(F.col("v") > F.get("b", 1), 1).otherwise(0)
    placed = joined.select("_g", "k", side.alias("side"), F.when(side == 0, F.col("v")).alias("v"))
    return placed.groupBy("_g", "k", "side", "v").agg(F.count("*").alias("c"))


def _middles(counts: DataFrame) -> DataFrame:
    """(_g, k, median, inside) from a table of ``_counted``."""
    total = counts.groupBy(F.col("_g").alias("_t"), F.col("k").alias("_k")).agg(F.sum("c").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("_g", "k").orderBy("side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = counts.withColumn("upto", upto).join(total, F.col("_g").eqNullSafe(F.col("_t")) & (F.col("k") == F.col("_k")))
    holds = lambda rank: (F.col("upto") - F.col("c") < rank) & (F.col("upto") >= rank)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    ends = [F.max(F.when(holds(rank), F.struct("side", "v"))).alias(name) for rank, name in ((low, "lo"), (high, "hi"))]
    a, b = F.col("lo.v"), F.col("hi.v")
    inside = (F.col("lo.side") == 0) & (F.col("hi.side") == 0)
    return run.groupBy("_g", "k").agg(*ends).select("_g", "k", (a + (b - a) * 0.5).alias("median"), inside.alias("inside"))


def medians(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, n, columns): rows and exact medians; of an even number of values the mean of the middle two, nulls aside."""
    quantiles = F.array(F.lit(0.5 - MARGIN), F.lit(0.5 + MARGIN))
    sketch = [F.percentile_approx(F.col(c).cast("double"), quantiles, ACCURACY).alias(f"_b{k}") for k, c in enumerate(columns)]
    bounds = written(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"), *sketch))
    found = written(_middles(written(_counted(df, group, columns, bounds))))
    missed = found.filter(~F.col("inside")).select("_g").distinct()
    again = written(missed.select("_g", *[F.lit(None).cast("array<double>").alias(f"_b{k}") for k in range(len(columns))]))
    if not again.isEmpty():
        rest = _middles(written(_counted(df, group, columns, again)))
        found = written(found.join(again.select(F.col("_g").alias("_m")), F.col("_g").eqNullSafe(F.col("_m")), "left_anti").unionByName(rest))
    wide = found.groupBy(F.col("_g").alias("_f")).agg(*[F.max(F.when(F.col("k") == k, F.col("median"))).alias(c) for k, c in enumerate(columns)])
    return bounds.select("_g", "n").join(wide, F.col("_g").eqNullSafe(F.col("_f")), "left").select(F.col("_g").alias(group), "n", *columns)
