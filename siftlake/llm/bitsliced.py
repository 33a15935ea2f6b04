"""Exact top-k inner products with a bit-sliced index.

Each component x of a vector is quantised to an integer. Within a block of rows the i-th bits of one component
form a bitmap, a slice. The scores of a query against all rows of a block are themselves added up as slices with
bitmap arithmetic: the slices of each component, shifted by the set bits of the query's weight, go through full
adders (carry-save) until every power of two has one slice. The top rows are then selected from the most
significant slice downward; rows that tie at the boundary are resolved by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship

SCALE = 256
#: Rows of a block of the index, and queries of a block of queries at most: both are some MB, so that a block of the
#: index is sent once for thousands of queries. With few rows there are more, smaller blocks of queries.
ROWS, QUERIES = 1 << 16, 4096
#: Sums of 2**10 products of larger integers might not fit in 64 bits.
LARGEST = 1 << 26


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component as double; null where the vector or a component is null or not finite.

    Beyond ``LARGEST`` a component is an error, raised when the result is read.
    """

    def whole(x: Column) -> Column:
        scaled = F.floor(F.lit(float(SCALE)) * x.cast("double"))
        return F.when(F.abs(x.cast("double")) * SCALE < LARGEST, scaled).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long"))

    values = F.transform(vector, whole)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite & (F.size(vector) > 0), values)


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (components x bits x words) of ``values - low``, and ``low`` for each component."""
    low = values.min(axis=0)
    shifted = (values - low).astype(np.uint64)
    bits = max(1, int(shifted.max()).bit_length())
    planes = ((shifted.T[:, None, :] >> np.arange(bits, dtype=np.uint64)[None, :, None]) & np.uint64(1)).astype(np.uint8)
    padded = np.zeros((*planes.shape[:2], -(-len(values) // 64) * 64), np.uint8)
    padded[:, :, : len(values)] = planes
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64), low


def _full_add(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray | None]:
    """One slice for each power of two. ``columns``: for each power, stacks of slices to be added."""
    out: list[np.ndarray | None] = []
    power = 0
    while power <= max(columns, default=-1):
        stack = np.concatenate(columns.pop(power)) if power in columns else np.zeros((0, 0), np.uint64)
        while len(stack) > 1:
            if len(stack) == 2:
                carry, stack = (stack[:1] & stack[1:]), stack[:1] ^ stack[1:]
            else:
                n = len(stack) // 3
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                carry, stack = (a & b) | (half & c), np.concatenate([half ^ c, stack[3 * n :]])
            columns.setdefault(power + 1, []).append(carry)
        out.append(stack[0] if len(stack) else None)
        power += 1
    return out


def score_slices(index: np.ndarray, low: np.ndarray, weights: np.ndarray, everyone: np.ndarray) -> tuple[list[np.ndarray | None], int]:
    """Slices of the scores of all rows, and the constant to be added to them.

    A negative weight takes the complement of a component's slices: -w * v = w * (all ones - v) - w * all ones.
    """
    bits = index.shape[1]
    ones = (1 << bits) - 1
    constant = int(weights @ low)
    columns: dict[int, list[np.ndarray]] = {}
    positive, negative = weights > 0, weights < 0
    constant += int(weights[negative].sum()) * ones
    source = np.concatenate([index[positive], ~index[negative] & everyone]) if negative.any() else index[positive]
    size = np.concatenate([weights[positive], -weights[negative]])
    for k in range(int(size.max(initial=0)).bit_length()):
        chosen = source[(size >> k) & 1 == 1]
        if len(chosen):
            for j in range(bits):
                columns.setdefault(j + k, []).append(chosen[:, j])
    return _full_add(columns), constant


def select_top(sums: list[np.ndarray | None], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the top ``k`` and of those that tie at the boundary."""
    sure, open_ = np.zeros_like(allowed), allowed
    if int(np.bitwise_count(allowed).sum()) <= k:
        return allowed, np.zeros_like(allowed)
    for plane in reversed(sums):
        if plane is None:
            continue
        high = open_ & plane
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            open_ = high
        else:
            sure, open_ = sure | high, open_ & ~plane
            if n == k:
                return sure, np.zeros_like(allowed)
    return sure, open_


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_of_block(index: np.ndarray, low: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best ``(score, id)`` of a block whose rows are in ascending order of id, but for the query's own rows."""
    n = index.shape[2] * 64
    flags = np.zeros(n, np.uint8)
    flags[: len(ids)] = 1
    everyone = np.packbits(flags, bitorder="little").view(np.uint64)
    first, last = np.searchsorted(ids, [own, own], "left")[0], np.searchsorted(ids, own, "right")
    flags[first:last] = 0
    allowed = np.packbits(flags, bitorder="little").view(np.uint64)
    sums, constant = score_slices(index, low, query, everyone)
    sure, ties = select_top(sums, allowed, k)
    chosen = _rows(sure)
    chosen = np.concatenate([chosen, _rows(ties)[: k - len(chosen)]])
    scores = np.full(len(chosen), constant, np.int64)
    for power, plane in enumerate(sums):
        if plane is not None:
            scores += ((plane[chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << power
    return list(zip(scores.tolist(), ids[chosen].tolist()))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of the index. Rows of other lengths than the block's most common one make blocks of their own."""
    rows = rows.sort_values("vec_id", kind="stable")
    out = []
    for size, part in rows.groupby(rows["v"].map(len)):
        index, low = slices(np.stack(part["v"].to_numpy()).astype(np.int64))
        ids = part["vec_id"].to_numpy(np.int64)
        out.append((int(rows["block"].iloc[0]), int(size), index.shape[1], index.tobytes(), low.astype(np.int64).tobytes(), ids.tobytes()))
    return pd.DataFrame(out, columns=["block", "size", "bits", "planes", "low", "ids"])


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of queries of one length."""
    values = np.stack(rows["v"].to_numpy()).astype(np.int64)
    head = [int(rows["group"].iloc[0]), int(rows["size"].iloc[0])]
    return pd.DataFrame([[*head, values.tobytes(), rows["query_id"].to_numpy(np.int64).tobytes()]], columns=["group", "size", "weights", "query_ids"])


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = row["size"]
                index = np.frombuffer(row["planes"], np.uint64).reshape(size, row["bits"], -1)
                low, ids = np.frombuffer(row["low"], np.int64), np.frombuffer(row["ids"], np.int64)
                weights = np.frombuffer(row["weights"], np.int64).reshape(-1, size)
                query_ids = np.frombuffer(row["query_ids"], np.int64)
                found = [(q, i, s) for q, w in zip(query_ids.tolist(), weights) for s, i in top_of_block(index, low, ids, w, q, k)]
                columns = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows by inner product, ties to the smaller vec_id.

    ``vectors`` has ``vec_id`` and ``embedding``; ``queries`` likewise. Null ids and vectors that are null, empty or
    hold a null or non-finite component take no part, and a query is compared with rows of its own length only.
    Rows with the query's own vec_id are no candidates. Of query rows that repeat a vec_id the smallest vector
    counts; repeated candidates count each. Empty tables give an empty result. Other columns are not read.

    Rows are dealt to blocks by a hash, each block is indexed once, and every block of queries meets every block
    of the index, so work is shared evenly whatever the vectors. A block returns k rows a query.
    """
    spark = vectors.sparkSession
    ship(spark)
    values = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    values = values.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), quantised(F.col("embedding")).alias("v"))
    asked = asked.filter(F.col("query_id").isNotNull() & F.col("v").isNotNull()).groupBy("query_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-vectors.count() // ROWS))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_queries = queries.count()
    groups = max(1, -(-n_queries // QUERIES), min(n_queries // 16, -(-2 * parallel // blocks)))
    dealt = values.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    index = dealt.groupBy("block").applyInPandas(_build, "block int, size int, bits int, planes binary, low binary, ids binary")
    index = materialise(index, "bitsliced-index")
    asked = asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("size", F.size("v"))
    asked = asked.groupBy("group", "size").applyInPandas(_gather, "group int, size int, weights binary, query_ids binary")
    asked = materialise(asked, "bitsliced-queries").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = max(parallel, blocks * groups // 4)
    met = asked.join(index, ["block", "size"]).repartition(parts, "block", "group", "size")
    found = met.select("size", "bits", "planes", "low", "ids", "weights", "query_ids").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector, against all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
