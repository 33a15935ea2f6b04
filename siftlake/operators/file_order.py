"""Rows of files in the order of the files: ordinals and first rows from counts by block, without sorting rows.

A task reads a block of a file from front to back. So a row's place is the number of rows in blocks before its own, which
sums of counts give, and its place within the block, which its number within the task gives. Only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = ("at_file", "at_block")


def located(df: DataFrame) -> DataFrame:
    """``df``, as a file reader gives it, with each row's file and the start of its block in it."""
    return df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]))


def _placed(rows: DataFrame, by: Sequence[str], name: str, most: int | None = None) -> DataFrame:
    keys = [*by, *PLACE]
    rows = rows.withColumn("at_row", F.monotonically_increasing_id())
    blocks = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("block_rows"), F.min("at_row").alias("block_first"))
    earlier = Window.partitionBy(*by).orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("block_rows").over(earlier), F.lit(0))
    blocks = blocks.select(*[F.col(k).alias(f"block_of_{k}") for k in keys], "block_first", before.alias("block_before"))
    if most is not None:
        blocks = blocks.filter(F.col("block_before") < most)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"block_of_{k}"))
    placed = rows.join(blocks, same).withColumn(name, F.col("block_before") + F.col("at_row") - F.col("block_first"))
    placed = placed if most is None else placed.filter(F.col(name) < most)
    return placed.drop("at_row", "block_first", "block_before", *[f"block_of_{k}" for k in keys], *PLACE)


def ordinals(rows: DataFrame, *, by: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """``rows`` with their 0-based place: files by path, and rows as they stand in a file.

    ``rows`` come from ``located`` by filters and projections alone. ``by`` are columns that do not change within a file;
    each of their values is counted by itself.
    """
    return _placed(rows, by, name)


def first_rows(rows: DataFrame, n: int, *, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """The first ``n`` rows, of each value of ``by``, in the order that ``ordinals`` states; all, if there are fewer."""
    if n < 1:
        raise ValueError("the number of rows must be positive")
    found = _placed(rows, by, name or "at_ordinal", most=n)
    return found if name else found.drop("at_ordinal")
