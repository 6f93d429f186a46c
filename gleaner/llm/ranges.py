"""Rows in order of a key without a window over the whole table: ranges between quantile bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending bounds of an integer key; only these come to the driver."""
    if parts < 2:
        return []
    cuts = df.select(F.col(key).cast("double").alias("k")).where("k is not null").approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts)
    return sorted({int(c) for c in cuts})


def range_of(key: str, bounds: list[int]) -> Column:
    """The place of the key's range: how many bounds don't exceed it; a null key is in the last."""
    if not bounds:
        return F.lit(0)
    within = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key)))
    return F.coalesce(F.when(F.col(key).isNotNull(), within), F.lit(len(bounds))).cast("int")


def deal_ranges(df: DataFrame, key: str, tie: str, guests: bool = False, bounds: list[int] | None = None) -> DataFrame:
    """df with `part` (its range), each range a partition of its own and sorted by key (nulls last), then tie.

    With guests, each range ends in a copy, marked `guest`, of the first row of the next range that
    has rows (after the last: of the first). Only a range's first key is gathered on the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if bounds is None:
        bounds = range_bounds(df, key, n)
    rows = df.withColumn("part", range_of(key, bounds)).withColumn("guest", F.lit(False))
    if guests:
        first = sorted((r.part, r.k) for r in rows.groupBy("part").agg(F.min(key).alias("k")).collect())
        keys = [k for _, k in first if k is not None]
        is_first = F.col(key).isin(keys) if keys else F.lit(False)
        if any(k is None for _, k in first):
            is_first = is_first | F.col(key).isNull()
        heads = rows.where(is_first).groupBy("part").agg(F.min_by(F.struct(*df.columns), F.struct(F.col(key).isNull(), F.col(key), F.col(tie))).alias("row"))
        before = {p: first[i - 1][0] for i, (p, _) in enumerate(first)}
        if before:
            move = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
            rows = rows.unionByName(heads.select("row.*", move[F.col("part")].cast("int").alias("part"), F.lit(True).alias("guest")))
    return rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.col(key).asc_nulls_last(), tie)
