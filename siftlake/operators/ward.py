"""Ward clustering of groups of any size, and the number of clusters with the best silhouette.

Ward's distance is reducible: two clusters that are each other's nearest are merged in the end whatever else is merged first. So
every round merges all such pairs of all groups, found in cells, so that a cluster is shuffled a fixed number of times; a group of few
clusters is finished by one task.
The merges are the whole tree, and a cut leaves out the highest ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.operators.cells import Cell, cells, compared
from siftlake.operators.components import connected_components

#: Clusters of a group that one task merges to the end; rows of a tile (a group of two tiles is not cut in blocks).
FEW, BLOCK = 1000, 1024
MERGES = "g string, step int, a long, b long, height double"


def ward_distances(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Twice the growth of the sum of squares if centroids ``x`` of ``n`` rows and ``y`` of ``m`` rows are joined."""
    squares = np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0)
    return squares * (2 * np.outer(n, m) / (n[:, None] + m[None]))


def standardised(rows: DataFrame) -> DataFrame:
    """``g, id, v`` with every component standardised within its group (population deviation) and divided by the root of their number."""
    columns = rows.select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
    fits = columns.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "mean", "spread"))).alias("fit"))
    width = F.sqrt(F.size("fit"))
    scaled = F.zip_with("v", "fit", lambda x, f: (x - f["mean"]) / F.when(f["spread"] > 0, f["spread"]).otherwise(1.0) / width)
    return rows.join(fits, "g").select("g", "id", scaled.alias("v"))


def _tiles(cell: Cell, block: int) -> Iterator[tuple[slice, slice]]:
    """Tiles of a cell that hold each two of its rows once; of one block with itself those on the diagonal hold them twice."""
    for i in range(0, len(cell.a["id"]), block):
        for j in range(i if cell.same else 0, len(cell.b["id"]), block):
            yield slice(i, i + block), slice(j, j + block)


def _nearest(block: int):
    """Both ways, so that two clusters see the same distance; ties go to the smaller id, as the rows of a cell are sorted by it."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in compared(batches, ["n", "v"], both=False):
            sides = [(s["id"], np.full(len(s["id"]), np.inf), np.zeros(len(s["id"]), np.int64)) for s in ((cell.a,) if cell.same else (cell.a, cell.b))]

            def closer(side: tuple, rows: slice, others: np.ndarray, found: np.ndarray) -> None:
                _, low, other = side
                best = found.argmin(axis=1)
                height, ids = found[np.arange(len(found)), best], others[best]
                better = (height < low[rows]) | (height == low[rows]) & (ids < other[rows])
                low[rows], other[rows] = np.where(better, height, low[rows]), np.where(better, ids, other[rows])

            for i, j in _tiles(cell, block):
                d = ward_distances(cell.a["v"][i], cell.a["n"][i], cell.b["v"][j], cell.b["n"][j])
                if cell.same and i == j:
                    d = (d + d.T) / 2
                    np.fill_diagonal(d, np.inf)
                    closer(sides[0], i, cell.b["id"][j], d)
                else:
                    closer(sides[0], i, cell.b["id"][j], d)
                    closer(sides[-1], j, cell.a["id"][i], d.T)
            for ids, low, other in sides:
                some = np.isfinite(low)
                g = pa.array([cell.g] * int(some.sum()), pa.string())
                yield pa.RecordBatch.from_arrays([g, pa.array(ids[some]), pa.array(other[some]), pa.array(low[some])], names=["g", "id", "other", "height"])

    return nearest


def _to_the_end(rows: pd.DataFrame) -> pd.DataFrame:
    """All merges of a group's few clusters, in order."""
    rows = rows.sort_values("id", ignore_index=True)
    ids, n, x = rows["id"].to_numpy(), rows["n"].to_numpy(float), np.stack(rows["v"].to_numpy())
    d = ward_distances(x, n, x, n)
    np.fill_diagonal(d, np.inf)
    live, out = n.copy(), []
    for step in range(len(ids) - 1):
        i, j = sorted(divmod(int(d.argmin()), len(ids)))
        height = d[i, j]
        merged = ((live + live[i]) * d[i] + (live + live[j]) * d[j] - live * height) / (live + live[i] + live[j])
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        live[i] += live[j]
        out.append((rows["g"].iloc[0], int(rows["step"].iloc[0]) + step, ids[i], ids[j], height))
    return pd.DataFrame(out, columns=["g", "step", "a", "b", "height"])


def ward_merges(rows: DataFrame, *, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """``g, step, a, b, height``: the whole tree of every group of ``g, id, v``; clusters are named by their smallest id, a < b.

    Steps rise from children to parents. Ids are whole numbers, unique over all groups; a group of n rows has n - 1 merges.
    """
    ship(rows.sparkSession)
    nodes, done, step = materialise(rows.select("g", F.col("id").cast("long").alias("id"), F.lit(1).cast("long").alias("n"), "v"), "ward-nodes"), [], 0
    while True:
        counts = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("clusters"))
        small = nodes.join(counts.filter(F.col("clusters") <= few).select("g"), "g", "left_semi").withColumn("step", F.lit(step))
        done.append(materialise(small.groupBy("g").applyInPandas(_to_the_end, MERGES), "ward-merges"))
        nodes = nodes.join(counts.filter(F.col("clusters") > few).select("g"), "g", "left_semi")
        found = cells(nodes, None, ["n", "v"], one=2 * block).mapInArrow(_nearest(block), "g string, id long, other long, height double")
        best = found.groupBy("g", "id").agg(F.min(F.struct("height", "other")).alias("best"))
        best = materialise(best.select("g", "id", F.col("best.other").alias("other"), F.col("best.height").alias("height")), "ward-nearest")
        back = best.select("g", F.col("other").alias("id"), F.col("id").alias("other"))
        pairs = best.filter("id < other").join(back, ["g", "id", "other"])
        pairs = materialise(pairs.select("g", F.lit(step).alias("step"), F.col("id").alias("a"), F.col("other").alias("b"), "height"), "ward-merges")
        if pairs.isEmpty():
            break
        done.append(pairs)
        partner = nodes.join(pairs.select(F.col("b").alias("id"), "a"), "id").select(F.col("a").alias("id"), F.col("n").alias("m"), F.col("v").alias("w"))
        kept = nodes.join(pairs.select(F.col("b").alias("id")), "id", "left_anti").join(partner, "id", "left")
        total = F.col("n") + F.col("m")
        mean = F.zip_with("v", "w", lambda x, y: (x * F.col("n") + y * F.col("m")) / total)
        nodes = kept.select("g", "id", F.coalesce(total, "n").alias("rows"), F.coalesce(mean, "v").alias("v")).withColumnRenamed("rows", "n")
        nodes, step = materialise(nodes, "ward-nodes"), step + 1  # (an alias n would be taken for the n inside the lambda)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _cuts(most: int):
    """For 2 to ``most`` clusters, which of them each of a group's finest ones is in; both in order of their smallest ids."""

    def cuts(rows: pd.DataFrame) -> pd.DataFrame:
        roots = sorted(rows["root"].dropna().astype("int64"))
        joins = rows.dropna(subset=["place"]).sort_values("place", ascending=False)
        label, out = {r: r for r in roots}, []
        for k in range(len(roots), 1, -1):
            order = {r: i for i, r in enumerate(sorted(set(label.values())))}
            out.append((rows["g"].iloc[0], k, roots, [order[label[r]] for r in roots]))
            join = joins.iloc[len(roots) - k]
            a, b = label[int(join["a_root"])], label[int(join["b_root"])]
            label = {r: min(a, b) if own in (a, b) else own for r, own in label.items()}
        return pd.DataFrame(out, columns=["g", "k", "roots", "labels"])

    return cuts


def _sums(most: int, block: int):
    """Each row's distances to the rows of the other block, added up by their finest cluster."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in compared(batches, ["place", "v"], both=False):
            sides = (cell.a,) if cell.same else (cell.a, cell.b)
            added, one = [np.zeros((len(s["id"]), most)) for s in sides], np.eye(most)
            for i, j in _tiles(cell, block):
                x, y = cell.a["v"][i], cell.b["v"][j]
                d = np.sqrt(ward_distances(x, np.ones(len(x)), y, np.ones(len(y))))
                if cell.same and i == j:
                    d = (d + d.T) / 2
                    np.fill_diagonal(d, 0)
                else:
                    added[-1][j] += d.T @ one[cell.a["place"][i]]
                added[0][i] += d @ one[cell.b["place"][j]]
            for side, by_place in zip(sides, added):
                yield pa.RecordBatch.from_arrays([pa.array(side["id"]), *[pa.array(c) for c in by_place.T.copy()]], names=["id", *[f"s{f}" for f in range(most)]])

    return sums


def ward_clusters(rows: DataFrame, *, by: str, id_col: str = "id", vector: str = "v", most: int = 6, least_size: int = 3, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """``by, id, cluster, silhouette``: the cut of 2 to ``most`` clusters with the best mean silhouette, for every row of every group.

    Only cuts whose clusters all have ``least_size`` rows count, of equal scores (to 12 digits) that of fewer clusters; a group
    without one is cluster 0 and has a null silhouette. Clusters are numbered by their smallest ids. Vectors are standardised
    within their group and have one length there. Ids are unique over all groups. Rows with a null take no part. Copies of a
    vector have distance 0; of merges at one height, which one a cut leaves out is not fixed.
    """
    rows = rows.select(F.col(by).cast("string").alias("g"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna()
    rows = materialise(standardised(rows), "ward-rows")
    merges = materialise(ward_merges(rows, few=few, block=block), "ward-tree")
    high = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("height"), F.desc("step"), F.desc("a"), F.desc("b")))
    top = materialise(merges.withColumn("place", high).filter(F.col("place") < most).select("g", "a", "b", "place"), "ward-top")
    lower = merges.join(top.select("a", "b"), ["a", "b"], "left_anti")
    roots = rows.select("g", "id").join(connected_components(lower.select("a", "b")), F.col("id") == F.col("node"), "left")
    roots = materialise(roots.select("g", "id", F.coalesce("component", "id").alias("root")), "ward-roots")

    finest = roots.groupBy("g", "root").agg(F.count(F.lit(1)).alias("size"))
    finest = materialise(finest.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("root")) - 1), "ward-finest")
    ends = {e: roots.select(F.col("id").alias(e), F.col("root").alias(f"{e}_root")) for e in "ab"}
    joins = top.join(ends["a"], "a").join(ends["b"], "b").select("g", F.lit(None).cast("long").alias("root"), "place", "a_root", "b_root")
    none = [F.lit(None).cast("long").alias(c) for c in ("place", "a_root", "b_root")]
    cuts = finest.select("g", "root", *none).unionByName(joins.withColumn("place", F.col("place").cast("long")))
    cuts = cuts.groupBy("g").applyInPandas(_cuts(most), "g string, k int, roots array<long>, labels array<int>")
    sizes = finest.groupBy("g").agg(F.sum("size").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("place", "size"))), lambda p: p["size"].cast("double")).alias("sizes"))
    cuts = materialise(cuts.join(sizes, "g").filter("k < n"), "ward-cuts")

    placed = rows.join(roots.select("id", "root"), "id").join(finest.select("g", "root", "place"), ["g", "root"]).select("g", "id", "place", "v")
    placed = materialise(placed, "ward-placed")
    sums = [f"s{f}" for f in range(most)]
    added = cells(placed, None, ["place", "v"], one=2 * block).mapInArrow(_sums(most, block), "id long, " + ", ".join(f"{s} double" for s in sums))
    added = added.groupBy("id").agg(*[F.sum(s).alias(s) for s in sums])
    judged = placed.select("g", "id", "place").join(added, "id").join(cuts, "g")
    label = F.get("labels", F.col("place"))

    def within(values, which):
        return F.aggregate(F.zip_with(values, F.col("labels"), lambda s, l: F.when(l == which, s).otherwise(0.0)), F.lit(0.0), lambda t, s: t + s)

    distances = F.slice(F.array(*sums), 1, F.size("labels"))
    own = within(F.col("sizes"), label)
    inner = within(distances, label) / F.greatest(own - 1, F.lit(1.0))
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda o: o != label)
    outer = F.array_min(F.transform(others, lambda o: within(distances, o) / within(F.col("sizes"), o)))
    score = F.when(own > 1, (outer - inner) / F.greatest(outer, inner, F.lit(1e-300))).otherwise(0.0)
    scores = judged.select("g", "k", own.alias("own"), score.alias("score")).groupBy("g", "k").agg(F.avg("score").alias("score"), F.min("own").alias("least"))
    best = scores.filter(F.col("least") >= least_size).groupBy("g").agg(F.max(F.struct(F.round("score", 12).alias("rounded"), (-F.col("k")).alias("minus"), "score")).alias("best"))
    chosen = cuts.join(best.select("g", (-F.col("best.minus")).alias("k"), F.col("best.score").alias("silhouette")), ["g", "k"]).select("g", "labels", "silhouette")
    out = placed.select("g", "id", "place").join(chosen, "g", "left")
    return out.select(F.col("g").alias(by), "id", F.coalesce(label, F.lit(0)).alias("cluster"), "silhouette")
