"""Best-two-fit packing of token pieces into sequences.

Lengths are small integers, so how many pieces there are of each length decides the packing. The counts (at most
``capacity`` numbers) come to the driver, where best-two-fit runs on them and yields bin patterns with their
multiplicities; the pieces themselves never leave the executors. A piece finds its sequence and its place there
from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.llm.tokens import encoder

CAPACITY = 2048


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin patterns ``(times, [(length, copies), ...])`` that use up ``counts`` of pieces by length.

    A bin is filled greedily, always with the longest piece that fits. Then, if a gap is left, its smallest piece
    is taken out and the two unpacked pieces that fit the expanded gap most tightly take its place, if they fill
    more than it did. The same bin is repeated while there are pieces for it.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    some = sum(1 << k for k in left)  # bit k: pieces of length k are left
    mirror = sum(1 << (capacity - k) for k in left)  # bit capacity - k
    patterns = []
    while some:
        used: dict[int, int] = {}
        gap, free = capacity, some
        while fit := (free & ((1 << (gap + 1)) - 1)).bit_length() - 1 if free & ((1 << (gap + 1)) - 1) else 0:
            n = min(left[fit] - used.get(fit, 0), gap // fit)
            used[fit] = used.get(fit, 0) + n
            gap -= n * fit
            free &= ~(1 << fit)
        if gap:
            smallest = min(used)
            if pair := _tightest_pair(left, used, some, mirror, gap + smallest, smallest, capacity):
                used[smallest] -= 1
                for length in pair:
                    used[length] = used.get(length, 0) + 1
        used = {k: n for k, n in used.items() if n}
        times = min(left[k] // n for k, n in used.items())
        patterns.append((times, sorted(used.items(), reverse=True)))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                some &= ~(1 << k)
                mirror &= ~(1 << (capacity - k))
    return patterns


def _tightest_pair(left, used, some, mirror, room, least, capacity) -> tuple[int, int] | None:
    """Two pieces outside the bin with the largest sum in ``(least, room]``."""
    spent = [k for k, n in used.items() if left[k] == n]
    for k in spent:
        some &= ~(1 << k)
        mirror &= ~(1 << (capacity - k))
    for total in range(min(room, capacity), least, -1):
        both = some & (mirror >> (capacity - total))  # bit k: lengths k and total - k are left
        while both:
            x = both.bit_length() - 1
            if 2 * x < total:
                break
            if 2 * x != total or left[x] - used.get(x, 0) >= 2:
                return x, total - x
            both &= ~(1 << x)
    return None


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool):
    """Cut documents; ``nth`` counts a task's pieces of the same length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = {c: [] for c in ("part", "nth", "doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([encode(text).astype("<u4"), np.array([end_id], "<u4")])
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for i, (start, stop) in enumerate(zip(edges, edges[1:])):
                    raw, length = ids[start:stop].tobytes(), stop - start
                    row = (part, seen[length], doc_id, i, start, length, zlib.crc32(raw), raw if keep_ids else None)
                    seen[length] += 1
                    for column, value in zip(out.values(), row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), PIECES.types)], schema=PIECES)

    return cut


PIECES_SQL = "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PIECES = pa.schema(
    [("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64())]
    + [("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
)


class Plan:
    """Where the r-th piece of a length goes. Sequences are numbered pattern by pattern."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]) -> None:
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for times, bin_ in patterns:
            offset = 0
            for length, copies in bin_:
                rank = taken.get(length, 0)
                rows.append((length, rank, copies, sequence, offset))
                taken[length] = rank + copies * times
                offset += length * copies
            sequence += times
        rows.sort()
        self.table = np.array(rows, np.int64).reshape(-1, 5)
        self.keys = (self.table[:, 0] << 48) + self.table[:, 1]
        self.sequences = sequence

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, copies, sequence, offset = self.table[np.searchsorted(self.keys, (lengths << 48) + ranks, "right") - 1].T
        nth = ranks - first
        return sequence + nth // copies, offset + nth % copies * lengths


def _place(plan):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = plan.value.place(lengths, ranks)
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"]
            )

    return place


def pack(
    docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``.

    A document is the ids of its text (null: empty) and the end id. Longer ones are cut into pieces of
    ``capacity`` tokens, the first of which may be shorter. ``ids`` (little-endian unsigned 32-bit) are null
    unless ``keep_ids``. Repeated rows are packed each; an empty table gives an empty result. Only doc_id and text
    are read; a null doc_id is handed on.

    Each text is encoded once, in the scan. Ranks come from the tasks' own counts and a running sum over tasks
    of each length, so no length, however common, is gathered anywhere.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer, end_id, capacity, keep_ids), PIECES_SQL), "packing-pieces")
    by_part = materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(best_two_fit(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # The bases grow with lengths x tasks, so they are never broadcast; a part of a length is a key of its own.
    ranked = pieces.join(bases.hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(_place(plan), schema)


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text of ``documents`` with its place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=0).drop("ids")
