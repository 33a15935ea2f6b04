"""Ranks in large groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a hash that make a bucket: 4096 buckets a group.
PREFIX = 3


def with_place(df: DataFrame, *, by: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's 0-based place in its group's order.

    ``bucket`` must never fall along the order. Rows are counted by group and bucket, the counts are summed up,
    and only the rows of a bucket are sorted together; so one group may hold most of the rows.
    """
    rows = df.withColumn("place_bucket", bucket)
    sizes = rows.groupBy(*by, "place_bucket").agg(F.count(F.lit(1)).alias("place_size"))
    earlier = Window.partitionBy(*by).orderBy("place_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("place_before", F.coalesce(F.sum("place_size").over(earlier), F.lit(0))).drop("place_size")
    keys = [*by, "place_bucket"]
    before = before.select(*[F.col(k).alias(f"at_{k}") for k in keys], "place_before")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"at_{k}"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    joined = rows.join(before, same).withColumn(name, (F.col("place_before") + within).cast("long"))
    return joined.drop("place_bucket", "place_before", *[f"at_{k}" for k in keys])


def hash_bucket(hashed: Column) -> Column:
    return F.substring(hashed, 1, PREFIX)


def range_bucket(number: Column, width: int = 4096) -> Column:
    return F.floor(number / width)
