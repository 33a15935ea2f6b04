"""All pairs of rows of a group in cells, so that a row is shuffled a fixed number of times however many rows there are.

The rows of a group are dealt by a hash into a fixed number of blocks, more only where a block would hold more rows than a task should.
A cell is two blocks of one group; one task reads its rows and compares them tile by tile. The cells of a group are numbered and go to the
partitions in turn, so that none gets two where another gets none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship

#: Rows up to which a group is one block, blocks of a larger one, and rows that a block should hold at most.
ONE, BLOCKS, HELD = 2048, 6, 1 << 17


@dataclass
class Cell:
    """``a`` and ``b``: the columns of the two sides, sorted by id. In a cell of one block with itself they are the same rows."""

    g: str | None
    same: bool
    a: dict[str, np.ndarray]
    b: dict[str, np.ndarray]


def cells(left: DataFrame, right: DataFrame | None, columns: Sequence[str], *, one: int = ONE, held: int = HELD) -> DataFrame:
    """``g, a_block, b_block, side, id, columns...`` for ``compared``: rows ``g, id, columns...`` of the left with those of the right of
    their group, or, without a right, each two rows of the left once. Null is a group."""
    ship(left.sparkSession)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [df.select("g", "id", *columns) for df in ((left,) if right is None else (left, right))]
    sizes = [df.groupBy("g").agg(F.count(F.lit(1)).alias("n")) for df in sides]
    n = F.max("n")
    blocks = F.when(n > one, F.greatest(F.lit(BLOCKS), F.ceil(n / held))).otherwise(1).cast("int")
    sizes = sizes[0] if right is None else sizes[0].unionByName(sizes[1])
    counts = materialise(sizes.groupBy(F.col("g").alias("of_g")).agg(blocks.alias("blocks")), "cell-blocks")  # Spark sees the size and need not shuffle the rows

    def dealt(df: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        rows = df.join(counts, F.col("g").eqNullSafe(F.col("of_g"))).withColumn("own", block)
        return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def placed(df: DataFrame, a: str, b: str, side: int) -> DataFrame:
        return df.select("g", F.col(a).alias("a_block"), F.col(b).alias("b_block"), F.lit(side).alias("side"), "id", *columns, "blocks")

    if right is None:
        rows = dealt(left)
        mine, theirs = placed(rows.filter("other >= own"), "own", "other", 0), placed(rows.filter("other < own"), "other", "own", 1)
    else:
        mine, theirs = placed(dealt(left), "own", "other", 0), placed(dealt(right), "other", "own", 1)
    keys = ["g", "a_block", "b_block"]
    x, y, size = (F.col(c).cast("long") for c in ("a_block", "b_block", "blocks"))
    number = x * size + y if right is not None else x * size - (x * (x + 1) / 2).cast("long") + y
    rows = mine.unionByName(theirs).withColumn("part", F.pmod(F.pmod(F.xxhash64("g"), F.lit(parts)) + number, F.lit(parts)).cast("int"))
    return rows.repartitionById(parts, "part").drop("blocks", "part").sortWithinPartitions(*keys, "side", "id")


def _side(parts: list[pa.RecordBatch], columns: Sequence[str]) -> dict[str, np.ndarray]:
    out = {}
    for c in ("id", *columns):
        values = [p.column(c) for p in parts]
        flat = [v.flatten() if pa.types.is_list(v.type) else v for v in values]
        found = np.concatenate([f.to_numpy(zero_copy_only=False) for f in flat])
        out[c] = found.reshape(sum(len(v) for v in values), -1) if pa.types.is_list(values[0].type) else found
    return out


def compared(batches: Iterator[pa.RecordBatch], columns: Sequence[str], *, both: bool) -> Iterator[Cell]:
    """The cells of a task's sorted rows; ``both`` if ``cells`` had a right side."""
    key, sides = None, ([], [])

    def close() -> Iterator[Cell]:
        if sides[0] and (sides[1] or not both and key[1] == key[2]):
            a = _side(sides[0], columns)
            yield Cell(key[0], not sides[1], a, _side(sides[1], columns) if sides[1] else a)

    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("g").dictionary_encode()
        codes = group.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        marks = np.stack([codes, *[batch.column(c).to_numpy() for c in ("a_block", "b_block", "side")]])
        starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for at, to in zip(starts, starts[1:]):
            here = (batch.column("g")[at].as_py(), int(marks[1, at]), int(marks[2, at]))
            if here != key:
                yield from close()
                key, sides = here, ([], [])
            sides[int(marks[3, at])].append(batch.slice(at, to - at))
    if key is not None:
        yield from close()
