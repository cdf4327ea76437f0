"""Two releases of the same objects: drift and keyed change report; known and verified objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def drifts(old: DataFrame, new: DataFrame, limit: float = 0.01) -> DataFrame:
    """(name, d_lat, d_lon, null_involved) where a position moved by more than ``limit``; the last of repeated names counts, null reads as 0.

    Both have name, lat, lon and an order column ``ord``.
    """
    a = last_by(old, "name", "ord").select("name", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    b = last_by(new, "name", "ord").select("name", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    moved = a.join(b, "name").withColumns({"d_lat": F.abs(zero("lat1") - zero("lat0")), "d_lon": F.abs(zero("lon1") - zero("lon0"))})
    nulls = F.col("lat0").isNull() | F.col("lon0").isNull() | F.col("lat1").isNull() | F.col("lon1").isNull()
    return moved.filter((F.col("d_lat") > limit) | (F.col("d_lon") > limit)).select("name", "d_lat", "d_lon", nulls.alias("null_involved"))


def change_report(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, removed, modified or unchanged, by a full outer join on the business key.

    Rows equal in key are compared as multisets: their values, each with its place and whether it is null, are hashed into a sum and a
    count. Keys equal nulls to nulls. The work columns take names that neither side uses.
    """
    taken = {c.lower() for c in (*old.columns, *new.columns)}
    prefix = next(p for p in ("_" * i for i in range(1, 1000)) if not any(c.startswith(p) for c in taken))

    def digest(df: DataFrame, p: str) -> DataFrame:
        # a hash skips nulls, so (1, null) and (null, 1) would be equal without the flags
        hashed = F.xxhash64(*[x for v in values for x in (F.col(v), F.col(v).isNull())])
        renamed = [F.col(k).alias(f"{p}k{i}") for i, k in enumerate(keys)]
        return df.groupBy(*renamed).agg(F.count("*").alias(f"{p}n"), F.sum(hashed.cast("decimal(38,0)")).alias(f"{p}h"))

    o, n = f"{prefix}o", f"{prefix}n"
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"{o}k{i}").eqNullSafe(F.col(f"{n}k{i}"))
    both = digest(old, o).join(digest(new, n), same, "full_outer")
    on, nn, oh, nh = (F.col(c) for c in (f"{o}n", f"{n}n", f"{o}h", f"{n}h"))
    kind = F.when(on.isNull(), "added").when(nn.isNull(), "removed").when((on != nn) | (oh != nh), "modified").otherwise("unchanged")
    named = [F.when(on.isNull(), F.col(f"{n}k{i}")).otherwise(F.col(f"{o}k{i}")).alias(k) for i, k in enumerate(keys)]
    return both.select(*named, kind.alias("change"))


def flag_known(df: DataFrame, known: DataFrame, key: str, flag: str = "verified") -> DataFrame:
    """df with a boolean: whether its key is among the known ones."""
    k = known.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return df.join(k, F.col(key) == F.col("_k"), "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def dedup_canonical(df: DataFrame, ignore: list[str], order: list[Column]) -> DataFrame:
    """The first of rows equal in all columns but ``ignore`` (nulls equal nulls)."""
    return keep_first_by(df, [c for c in df.columns if c not in ignore], order)
