"""The quality bundle: neighbours, mutual neighbours, kernel and Fréchet distances of many groups from one pass each.

Groups overlap (a type and all types, all rows and the accepted ones, a type's references and all of an object), so nothing
is computed by group. Rows are cut into segments that no group divides: generated ones by object, input, type and whether they
passed, references by object and type. Pairs of blocks of segments are one matrix product and give best neighbours both ways;
and of every segment sums of features are taken, whose inner products are sums of the kernel. Groups then only add up or take
the best of what their segments have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.functions.scalars import unit
from siftlake.operators.kernels import PARTIALS, SUM_SQL, added, places, taken
from siftlake.operators.quantiles import with_quantiles
from siftlake.operators.vectors import BLOCK

VIEWS, ALL, OBJECT_ALL = ("unfiltered", "filtered"), "__all__", "object_all"
SEGMENT = ("object", "input_name", "type", "passed")
GROUP = ("view", "input_name", "object", "defect_type")
KEY = ("side", *SEGMENT)
KEY_SQL = "side string, object string, input_name string, type string, passed boolean"


def _fid(x: np.ndarray, r: np.ndarray) -> float | None:
    """Of two sums of features up to the second degree."""
    d = round(math.sqrt(2 * len(x) + 0.25) - 1.5)
    i2, j2, *_, weight = places(d)
    found = []
    for f in (x / weight[: len(x)], r / weight[: len(r)]):
        n, mean, second = f[0], f[1 : d + 1] / f[0], np.zeros((d, d))
        second[i2, j2] = second[j2, i2] = f[d + 1 :]
        found.append((n, mean, (second - n * np.outer(mean, mean)) / max(n - 1, 1)))
    (n, m1, c1), (m, m2, c2) = found
    if min(n, m) < 2:
        return None
    values, axes = np.linalg.eigh(c1)
    first, rank = (min(d, round(k) - 1) for k in (n, min(n, m)))  # further eigenvalues are rounding errors
    root = axes[:, -first:] * np.sqrt(np.clip(values[-first:], 0, None))
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root.T @ c2 @ root)[-rank:], 0, None)).sum()
    return max(0.0, float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross))


PRODUCTS = ("xx", "rr", "xr", "n", "m", "fid")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pieces of a group and of its references have in sums of kernels, counts and the Fréchet distance."""
    for batch in batches:
        out = [[] for _ in PRODUCTS]
        for i, piece in enumerate(batch.column("piece").to_pylist()):
            x, r = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("features", "r_features"))
            for own, value in zip(out, (x @ x, r @ r, x @ r, *((x[0], r[0], _fid(x, r)) if piece == 0 else (0.0, 0.0, None)))):
                own.append(value)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*GROUP, "diagonal", "r_diagonal")], *[pa.array(c, pa.float64()) for c in out]], names=[*GROUP, "diagonal", "r_diagonal", *PRODUCTS])


def _both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of blocks, each row's best one of the other block; ties go to the smaller id, blocks come sorted by it."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids = [row.column(f"{s}_ids").flatten().to_numpy() for s in ("x", "r")]
            x, r = (row.column(f"{s}_vectors").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) for s, own in zip(("x", "r"), ids))
            similarity = x @ r.T
            keys = [row.column(c)[0] for c in ("object", "input_name", "type", "passed", "real_type")]
            for side, own, other, found in (("x", ids[0], ids[1], similarity), ("r", ids[1], ids[0], similarity.T)):
                best = found.argmax(axis=1)
                columns = [pa.array([side] * len(own)), *[pa.array([k.as_py()] * len(own), k.type) for k in keys], pa.array(own), pa.array(other[best]), pa.array(found[np.arange(len(own)), best])]
                yield pa.RecordBatch.from_arrays(columns, names=["side", "object", "input_name", "type", "passed", "real_type", "id", "neighbour", "similarity"])


def _packed(rows: DataFrame, keys: Sequence[str], side: str, block: int) -> DataFrame:
    """Blocks of unit vectors of one segment, sorted by id."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    dealt = rows.join(counts, list(keys)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")))
    packed = dealt.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("id", unit(F.col("v")).alias("u")))).alias("rows"))
    return packed.select(*keys, F.col("rows.id").alias(f"{side}_ids"), F.flatten("rows.u").alias(f"{side}_vectors"))


def quality_bundle(generated: DataFrame, real: DataFrame, *, inputs: Sequence[str], views: Sequence[str] = VIEWS, biased: bool = False, block: int = BLOCK) -> DataFrame:
    """A row for every view, input, object of ``real`` and type of the generated rows there, and one for all its types.

    ``generated`` has ``object, input_name, type, passed, id, v``, ``real`` has ``object, type, id, v``; ids are whole numbers, unique on a side
    and input. Out come ``view, input_name, object, defect_type, real_scope, n_real, n_generated, status``, the mean, least,
    median, p05 and p95 of the generated rows' greatest cosines, the share of references in a mutual pair ``mnn_score``, ``kid`` and
    ``fid``. A type without references is held against all of the object's. A group without rows is ``empty`` and has
    null metrics; ``kid`` (unless biased) and ``fid`` are null with fewer than two rows on a side. Rows with a null key, id or vector,
    and those of other inputs or objects, take no part; other columns are not read.
    """
    spark = real.sparkSession
    if unknown := set(views) - set(VIEWS):
        raise ValueError(f"unknown views: {sorted(unknown)}")
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = generated.select(*SEGMENT, F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).dropna().filter(F.col("input_name").isin(list(inputs)))
    r = real.select("object", "type", F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).dropna()

    met = _packed(x, SEGMENT, "x", block).join(_packed(r.withColumnRenamed("type", "real_type"), ("object", "real_type"), "r", block), "object")
    dealt = met.repartition(parts, *SEGMENT, "real_type", F.xxhash64("x_ids"), F.xxhash64("r_ids"))
    found = dealt.mapInArrow(_both_ways, "side string, object string, input_name string, type string, passed boolean, real_type string, id long, neighbour long, similarity double")
    nearest = F.max(F.struct("similarity", (-F.col("neighbour")).alias("minus"))).alias("best")
    near = materialise(found.groupBy("side", *SEGMENT, "real_type", "id").agg(nearest), "bundle-nearest")

    none = [F.lit("").alias("input_name"), "type", F.lit(True).alias("passed")]
    vectors = x.select(F.lit("x").alias("side"), *SEGMENT, "v").unionByName(r.select(F.lit("r").alias("side"), "object", *none, "v"))
    sums = added(vectors.mapInArrow(taken(KEY), f"{KEY_SQL}, {SUM_SQL}"), KEY, KEY_SQL, parts, F.spark_partition_id() % PARTIALS)
    sums = materialise(sums, "bundle-sums")

    known = materialise(sums.filter("piece = 0").select(*KEY).distinct(), "bundle-segments")
    segments = known.filter("side = 'x'").drop("side")
    real_types = known.filter("side = 'r'").select("object", F.col("type").alias("real_type"))
    labels = lambda t: F.explode(F.array(t, F.lit(ALL)))
    objects = real_types.select("object").distinct()
    spine = objects.select("object", F.explode(F.array(*[F.lit(n) for n in inputs])).alias("input_name"))
    typed = segments.select("input_name", "object", F.col("type").alias("defect_type")).distinct().join(objects, "object", "left_semi")
    spine = typed.unionByName(spine.withColumn("defect_type", F.lit(ALL)), allowMissingColumns=False)
    scoped = spine.join(real_types.select("object", F.col("real_type").alias("defect_type"), F.lit(True).alias("own")), ["object", "defect_type"], "left")
    scope = F.when(F.col("own"), F.concat(F.lit("type:"), F.col("defect_type"))).otherwise(OBJECT_ALL)
    spine = scoped.select("input_name", "object", "defect_type", scope.alias("real_scope"), F.explode(F.array(*[F.lit(v) for v in views])).alias("view"))
    spine = materialise(spine, "bundle-spine")

    members = segments.withColumn("defect_type", labels(F.col("type"))).withColumn("view", F.explode(F.when(F.col("passed"), F.array(*map(F.lit, VIEWS))).otherwise(F.array(F.lit(VIEWS[0])))))
    members = members.join(spine, [*GROUP])  # segment to group
    scopes = real_types.withColumn("real_scope", F.explode(F.array(F.concat(F.lit("type:"), F.col("real_type")), F.lit(OBJECT_ALL))))
    pairs = materialise(members.join(scopes, ["object", "real_scope"]).select(*GROUP, "type", "passed", "real_type"), "bundle-pairs")

    by_group = near.join(pairs, ["object", "input_name", "type", "passed", "real_type"]).groupBy("side", *GROUP, "id").agg(F.max("best").alias("best"))
    by_group = materialise(by_group.select("side", *GROUP, "id", (-F.col("best.minus")).alias("neighbour"), F.col("best.similarity").alias("similarity")), "bundle-near")
    mine = by_group.filter("side = 'x'")
    neighbours = mine.groupBy(*GROUP).agg(F.avg("similarity").alias("nn_mean"), F.min("similarity").alias("nn_min"))
    neighbours = with_quantiles(neighbours, mine, by=GROUP, values={"nn": F.col("similarity")}, at={"median": 0.5, "p05": 0.05, "p95": 0.95})
    back = by_group.filter("side = 'r'").select(*GROUP, F.col("id").alias("neighbour"), F.col("neighbour").alias("id"))
    mutual = mine.join(back, [*GROUP, "id", "neighbour"]).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("mutual"))

    x_sums = added(sums.filter("side = 'x'").join(members, list(SEGMENT)), (*GROUP, "real_scope"), "view string, input_name string, object string, defect_type string, real_scope string", parts)
    r_sums = sums.filter("side = 'r'").withColumnRenamed("type", "real_type").join(scopes, ["object", "real_type"])
    r_sums = materialise(added(r_sums, ("object", "real_scope"), "object string, real_scope string", parts), "bundle-references")
    r_sums = r_sums.withColumnsRenamed({"diagonal": "r_diagonal", "features": "r_features"})
    products = x_sums.join(r_sums, ["object", "real_scope", "piece"]).mapInArrow(_products, "view string, input_name string, object string, defect_type string, diagonal double, r_diagonal double, " + ", ".join(f"{c} double" for c in PRODUCTS))
    kernels = products.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("diagonal", "r_diagonal", *PRODUCTS[:-1])], F.max("fid").alias("fid"))
    references = r_sums.filter("piece = 0").select("object", "real_scope", F.round(F.get("r_features", F.lit(0))).cast("long").alias("n_real"))

    out = reduce(lambda a, b: a.join(b, list(GROUP), "left"), [neighbours, mutual, kernels], spine.join(references, ["object", "real_scope"]))
    n, m = F.col("n"), F.col("m")
    within = lambda total, diagonal, k: (F.col(total) - F.col(diagonal)) / (k * (k - 1))
    unbiased = F.when((n > 1) & (m > 1), within("xx", "diagonal", n) + within("rr", "r_diagonal", m) - 2 * F.col("xr") / (n * m))
    kid = F.col("xx") / (n * n) + F.col("rr") / (m * m) - 2 * F.col("xr") / (n * m) if biased else unbiased
    there = n.isNotNull()
    return out.select(
        *GROUP, "real_scope", "n_real", F.coalesce(F.round(n).cast("long"), F.lit(0)).alias("n_generated"), F.when(there, "ok").otherwise("empty").alias("status"),
        "nn_mean", "nn_min", "nn_median", "nn_p05", "nn_p95", F.when(there, F.coalesce("mutual", F.lit(0)) / F.col("n_real")).alias("mnn_score"), kid.alias("kid"), "fid",
    )


def sanity_checks(
    real: DataFrame, noise: DataFrame, tau_low: DataFrame, *, self_nn: float = 1 - 1e-6, self_mnn: float = 1.0, self_kid: float = 1e-9, self_fid: float = 1e-6, nn_margin: float = 0.0, kid_gap: float = 0.0
) -> DataFrame:
    """A row for every object and type: references held against themselves, and noise against them, pass if all limits hold.

    ``real`` and ``noise`` have ``object, type, id, v``, ``tau_low`` has ``object, tau_low``. The kernel distance is the biased one, which
    is zero for a set and itself. A type without noise, or an object without ``tau_low``, does not pass.
    """
    rows = lambda df, name: df.select("object", F.lit(name).alias("input_name"), "type", F.lit(True).alias("passed"), "id", "v")
    found = quality_bundle(rows(real, "self").unionByName(rows(noise, "noise")), real, inputs=["self", "noise"], views=VIEWS[:1], biased=True)
    found = materialise(found.filter(F.col("defect_type") != ALL), "bundle-sanity")
    own, other = (found.filter(F.col("input_name") == n).select("object", "defect_type", *[F.col(c).alias(f"{n}_{c}") for c in ("n_generated", "nn_min", "nn_mean", "mnn_score", "kid", "fid")]) for n in ("self", "noise"))
    both = own.join(other, ["object", "defect_type"], "left").join(tau_low.select("object", "tau_low"), "object", "left")
    passed = (
        (F.col("self_nn_min") >= self_nn)
        & (F.col("self_mnn_score") >= self_mnn)
        & (F.col("self_fid") <= self_fid)
        & (F.abs("self_kid") <= self_kid)
        & (F.col("noise_nn_mean") <= F.col("tau_low") - nn_margin)
        & (F.col("noise_kid") >= F.col("self_kid") + kid_gap)
        & (F.col("noise_fid") > F.col("self_fid"))
    )
    columns = [F.col("self_n_generated").alias("n"), "self_nn_min", F.col("self_mnn_score").alias("self_mnn"), "self_kid", "self_fid", "noise_nn_mean", "tau_low", "noise_kid", "noise_fid"]
    return both.select("object", "defect_type", *columns, F.coalesce(passed, F.lit(False)).alias("passed"))
