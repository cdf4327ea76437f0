"""Connected components of a graph too large for one machine, by hooking and contraction.

Each round hooks every vertex to the smallest of its neighbours and itself, doubles those pointers
twice, maps the edges through them and keeps the distinct ones between different ends. Stars
collapse in one round and paths shrink at least fourfold. A round is a written table, so lost executors cost
one round at most. Nothing but row counts reaches the driver: the pointers are joined by shuffle at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartstone.llm.common import growing, remove, written


def _follow(table: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """table with ``column`` replaced by where ``pointers`` (id, to) lead it."""
    p = pointers.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
    joined = table.join(growing(p), F.col(column) == F.col("_id"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_id", "_to")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (id, to): for each vertex with an edge the smallest vertex of its component.

    Loops, repeated edges and null ends are allowed and say nothing.
    """
    spark = edges.sparkSession
    live = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live = written(live, "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.col("u").alias("id"), F.col("v").alias("n")).unionByName(live.select(F.col("v").alias("id"), F.col("u").alias("n")))
        hook = written(both.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("to")), "hook")
        jump = written(_follow(hook, "to", hook), "jump")
        jump = written(_follow(jump, "to", jump), "jump")
        maps.append(jump)
        mapped = _follow(_follow(live, "u", jump), "v", jump).filter("u <> v")
        after = written(mapped.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        remove(spark, live.written_to)
        remove(spark, hook.written_to)
        live = after
    if not maps:
        return spark.createDataFrame([], "id long, to long")
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        out = written(_follow(earlier, "to", out), "roots")
    return out
