"""Embedding comparisons: nearest and mutual neighbours, kernel and Fréchet distances, reference calibration.

All-pairs work runs on pairs of blocks: rows are dealt by a hash into blocks of bounded size, blocks of one group
meet by an equi-join, and a pair of blocks is one matrix product that returns a row per vector, or one row. No
side is broadcast and no pair of vectors becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.functions.scalars import dot, unit
from siftlake.operators.kernels import LARGEST, PARTIALS, SUM_SQL, added, taken
from siftlake.operators.quantiles import group_quantiles, with_quantiles

BLOCK = 2048


def blocks(df: DataFrame, by: str, id_col: str, vector: str, side: str, size: int = BLOCK) -> DataFrame:
    """Rows ``g, <side>_block, <side>_ids, <side>_vectors`` of at most about ``size`` vectors of one group."""
    rows = df.select(F.col(by).alias("g"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    counts = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n_blocks"))
    dealt = rows.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    packed = dealt.groupBy("g", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))
    return packed.select(
        "g", F.col("block").alias(f"{side}_block"), F.col("rows.id").alias(f"{side}_ids"), F.flatten("rows.v").alias(f"{side}_vectors")
    )


def _matrix(row: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one side of a row, read from the batch's own buffers."""
    ids = row.column(f"{side}_ids").flatten().to_numpy()
    return ids, row.column(f"{side}_vectors").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _nearest(skip_self: bool):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                (a, x), (b, y) = _matrix(row, "a"), _matrix(row, "b")
                similarity = x @ y.T
                if skip_self:
                    similarity[a[:, None] == b[None, :]] = -np.inf
                best = similarity.argmax(axis=1)  # the first of equals, the smallest id
                top = similarity[np.arange(len(a)), best]
                keep = np.isfinite(top)
                columns = [pa.array([row.column("g")[0].as_py()] * int(keep.sum()), pa.string()), pa.array(a[keep]), pa.array(b[best[keep]]), pa.array(top[keep])]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "id", "neighbour", "similarity"])

    return nearest


def nearest_neighbours(left: DataFrame, right: DataFrame, *, by: str, id_col: str = "id", vector: str = "v", skip_self: bool = False) -> DataFrame:
    """``g, id, neighbour, similarity``: each left row's most cosine-similar right row of its group, ties to the smaller id.

    ``skip_self`` leaves out rows of the same id (leave one out). Groups without right rows give nothing.
    """
    spark = left.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = blocks(left.select(F.col(by).cast("string").alias(by), id_col, unit(F.col(vector)).alias(vector)), by, id_col, vector, "a")
    b = blocks(right.select(F.col(by).cast("string").alias(by), id_col, unit(F.col(vector)).alias(vector)), by, id_col, vector, "b")
    met = a.join(b, "g").repartition(parts, "g", "a_block", "b_block")
    found = met.mapInArrow(_nearest(skip_self), "g string, id long, neighbour long, similarity double")
    best = found.groupBy("g", "id").agg(F.max(F.struct("similarity", (-F.col("neighbour")).alias("minus"))).alias("best"))
    return best.select("g", "id", (-F.col("best.minus")).alias("neighbour"), F.col("best.similarity").alias("similarity"))


def mutual_share(generated: DataFrame, real: DataFrame, *, by: str, id_col: str = "id", vector: str = "v") -> DataFrame:
    """``g, n_real, mutual``: the share of real rows whose nearest generated row has them as its nearest real row."""
    forth = nearest_neighbours(real, generated, by=by, id_col=id_col, vector=vector).select("g", F.col("id").alias("r"), F.col("neighbour").alias("x"))
    back = nearest_neighbours(generated, real, by=by, id_col=id_col, vector=vector).select("g", F.col("id").alias("x"), F.col("neighbour").alias("r"))
    met = forth.join(back, ["g", "x", "r"]).groupBy("g").agg(F.count(F.lit(1)).alias("met"))
    total = real.groupBy(F.col(by).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n_real"))
    return total.join(met, "g", "left").select("g", "n_real", (F.coalesce("met", F.lit(0)) / F.col("n_real")).alias("mutual"))


def _kernel_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            (a, x), (b, y) = _matrix(row, "a"), _matrix(row, "b")
            kernel = (x @ y.T / x.shape[1] + 1) ** 3
            diagonal = kernel[a[:, None] == b[None, :]].sum()
            columns = [row.column("g"), pa.array([kernel.sum()]), pa.array([float(diagonal)])]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "total", "diagonal"])


def kernel_distance(real: DataFrame, generated: DataFrame, *, by: str, id_col: str = "id", vector: str = "v", biased: bool = False) -> DataFrame:
    """``g, n_real, n_generated, kid``: squared MMD with the kernel (x.y / d + 1)^3.

    The unbiased form leaves out each row's kernel with itself and is null with fewer than two rows on a side; the biased
    form takes plain means. Up to 128 dimensions the work is in proportion to the rows, see ``kernels``; vectors of more
    meet in pairs of blocks. Null vectors and groups, and groups of one side only, take no part; all vectors have one length.
    """
    ship(real.sparkSession)
    sides = {s: df.select(F.col(by).cast("string").alias("g"), F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna() for s, df in (("r", real), ("x", generated))}
    some = sides["r"].select(F.size("v")).first()
    sums = _sums_of_features if some is None or some[0] <= LARGEST else _sums_of_blocks
    rows = sums(sides)
    n, m = F.col("n_r").cast("double"), F.col("n_x").cast("double")
    if biased:
        kid = F.col("rr") / (n * n) + F.col("xx") / (m * m) - 2 * F.col("rx") / (n * m)
    else:
        within = lambda total, own, k: F.when((n > 1) & (m > 1), (F.col(total) - F.col(own)) / (k * (k - 1)))
        kid = within("rr", "rr_diagonal", n) + within("xx", "xx_diagonal", m) - 2 * F.col("rx") / (n * m)
    return rows.select("g", F.col("n_r").alias("n_real"), F.col("n_x").alias("n_generated"), kid.alias("kid"))


def _sums_of_features(sides: dict[str, DataFrame]) -> DataFrame:
    """``g, n_r, n_x``, sums of kernels ``rr, xx, rx`` over all pairs and those of rows with themselves."""
    spark = sides["r"].sparkSession
    parts, keys = int(spark.conf.get("spark.sql.shuffle.partitions")), ("side", "g")
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(s).alias("side"), "g", "v") for s, df in sides.items()])
    held = rows.mapInArrow(taken(keys), f"side string, g string, {SUM_SQL}")
    salted = added(held, keys, "side string, g string", parts, F.spark_partition_id() % PARTIALS)
    sums = materialise(added(salted, keys, "side string, g string", parts), "kernel-sums")
    r, x = (sums.filter(F.col("side") == s).select("g", "piece", F.col("diagonal").alias(f"{s}{s}_diagonal"), F.col("features").alias(f"of_{s}")) for s in "rx")
    products = {f"{p}{q}": F.sum(dot(F.col(f"of_{p}"), F.col(f"of_{q}"))) for p, q in ("rr", "xx", "rx")}
    counts = {f"n_{s}": F.sum(F.when(F.col("piece") == 0, F.get(f"of_{s}", F.lit(0)))).cast("long") for s in "rx"}
    diagonals = {f"{s}{s}_diagonal": F.sum(f"{s}{s}_diagonal") for s in "rx"}
    return r.join(x, ["g", "piece"]).groupBy("g").agg(*[c.alias(name) for name, c in (products | counts | diagonals).items()])


def _sums_of_blocks(sides: dict[str, DataFrame]) -> DataFrame:
    """As ``_sums_of_features``, from all pairs of blocks."""
    parts = int(sides["r"].sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sums(p: str, q: str) -> DataFrame:
        a, b = blocks(sides[p], "g", "id", "v", "a"), blocks(sides[q], "g", "id", "v", "b")
        met = a.join(b, "g").repartition(parts, "g", "a_block", "b_block")
        rows = met.mapInArrow(_kernel_sums, "g string, total double, diagonal double")
        return rows.groupBy("g").agg(F.sum("total").alias(f"{p}{q}"), F.sum("diagonal").alias(f"{p}{q}_diagonal"))

    counts = [df.groupBy("g").agg(F.count(F.lit(1)).alias(f"n_{s}")) for s, df in sides.items()]
    return counts[0].join(counts[1], "g").join(sums("r", "r"), "g").join(sums("x", "x"), "g").join(sums("r", "x"), "g")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count, sum and sum of outer products for each group and side."""
    held: dict[tuple, list] = {}
    for batch in batches:
        frame = batch.to_pandas()
        for key, part in frame.groupby(["g", "side"]):
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            entry = held.setdefault(key, [0, 0.0, 0.0])
            entry[0] += len(x)
            entry[1] = entry[1] + x.sum(axis=0)
            entry[2] = entry[2] + x.T @ x
    if held:
        rows = [(g, side, n, s.tolist(), o.ravel().tolist()) for (g, side), (n, s, o) in held.items()]
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["g", "side", "n", "s", "o"])


def _frechet(rows: pd.DataFrame) -> pd.DataFrame:
    found = {}
    for side, part in rows.groupby("side"):
        n, s = part["n"].sum(), np.sum(np.stack(part["s"].to_numpy()), axis=0)
        o = np.sum(np.stack(part["o"].to_numpy()), axis=0).reshape(len(s), len(s))
        if n > 1:
            found[side] = (n, s / n, (o - np.outer(s, s) / n) / (n - 1))
    g = rows["g"].iloc[0]
    if len(found) < 2:
        return pd.DataFrame([[g, None]], columns=["g", "fid"])
    (_, m1, c1), (_, m2, c2) = found["real"], found["generated"]
    values, vectors = np.linalg.eigh(c1)
    root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ c2 @ root), 0, None)).sum()
    fid = float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross)
    return pd.DataFrame([[g, max(fid, 0.0) if fid > -1e-6 else fid]], columns=["g", "fid"])


def frechet_distance(real: DataFrame, generated: DataFrame, *, by: str, vector: str = "v") -> DataFrame:
    """``g, fid`` from means and covariances; tasks hand on moments only. Null with fewer than two rows on a side."""
    ship(real.sparkSession)
    sides = [df.select(F.col(by).cast("string").alias("g"), F.lit(s).alias("side"), F.col(vector).cast("array<double>").alias("v")) for s, df in (("real", real), ("generated", generated))]
    moments = sides[0].unionByName(sides[1]).mapInArrow(_moments, "g string, side string, n long, s array<double>, o array<double>")
    return moments.groupBy("g").applyInPandas(_frechet, "g string, fid double")


def neighbour_summary(nearest: DataFrame) -> DataFrame:
    """Mean, median, p05 and p95 of similarities by group."""
    means = nearest.groupBy("g").agg(F.avg("similarity").alias("nn_mean"))
    return with_quantiles(means, nearest, by=["g"], values={"nn": F.col("similarity")}, at={"median": 0.5, "p05": 0.05, "p95": 0.95})


def centroids(df: DataFrame, *, by: str, vector: str = "v") -> DataFrame:
    """``g, centroid``: unit vectors of the mean direction of each group."""
    rows = df.select(F.col(by).cast("string").alias("g"), F.posexplode(unit(F.col(vector))).alias("i", "x"))
    means = rows.groupBy("g", "i").agg(F.avg("x").alias("m")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("e"))
    return means.select("g", unit(F.col("e.m")).alias("centroid"))


def calibrate(reference: DataFrame, *, by: str, id_col: str = "id", vector: str = "v", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``g, n, tau_low, tau_outlier`` of a reference set of at least three rows a group.

    ``tau_low`` is a low quantile of leave-one-out nearest similarities, ``tau_outlier`` a high quantile of
    1 - cosine to the centroid.
    """
    nearest = nearest_neighbours(reference, reference, by=by, id_col=id_col, vector=vector, skip_self=True)
    nearest = materialise(nearest.select("g", "similarity"), "calibration-nearest")
    counts = nearest.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    lows = with_quantiles(counts, nearest, by=["g"], values={"tau": F.col("similarity")}, at={"low": low})
    center = materialise(centroids(reference, by=by, vector=vector), "centroids")
    rows = reference.select(F.col(by).cast("string").alias("g"), unit(F.col(vector)).alias("v")).join(center, "g")
    highs = group_quantiles(rows, by=["g"], values={"tau": 1 - dot(F.col("v"), F.col("centroid"))}, at={"outlier": high})
    return lows.filter("n >= 3").join(highs, "g")
