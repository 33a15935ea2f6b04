"""Regions of masks of any size: runs of mask rows, stitched through connected components, and counts instead of pixels.

A relation of pixels has ``image, y, x, mask, score``. Rows of an image are cut in tiles, so that no task needs an image or
a row of it whole; each run of mask pixels in a tile is a node, and runs that touch, with corners, are linked. What is
measured on regions comes from counts of pixels by region and thresholds reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise
from siftlake.operators import metrics
from siftlake.operators.components import connected_components

#: Pixels of a row that one task looks at together.
TILE = 1024


def thresholds(n: int, margin: float = 1e-7) -> list[float]:
    """``n`` evenly spaced thresholds from just above 1 to just below 0, ascending."""
    return [-margin + i * (1 + 2 * margin) / (n - 1) for i in range(n)]


def reached(score: Column, ordered: Sequence[float]) -> Column:
    """How many of the ascending thresholds a score reaches, by halving; a null reaches none."""
    steps = [1 << i for i in reversed(range(len(ordered).bit_length()))]
    values = F.array(*[F.lit(float(t)) for t in ordered])

    def step(place: Column, by: Column) -> Column:
        after = place + by
        return F.when((after <= len(ordered)) & (F.get(values, after - 1) <= score), after).otherwise(place)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def mask_runs(pixels: DataFrame, ordered: Sequence[float], *, tile: int = TILE) -> DataFrame:
    """``run, image, y, tile, x0, x1, bins``: runs of mask pixels (ends included) with their pixels by thresholds reached."""
    masked = pixels.filter("mask").select("image", "y", "x", F.floor(F.col("x") / tile).alias("tile"), reached(F.col("score"), ordered).alias("reached"))
    place = F.row_number().over(Window.partitionBy("image", "y", "tile").orderBy("x"))
    counts = masked.withColumn("island", F.col("x") - place).groupBy("image", "y", "tile", "island", "reached").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = counts.groupBy("image", "y", "tile", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.collect_list(F.struct("reached", "n")).alias("bins"))
    return materialise(runs.drop("island").withColumn("run", F.monotonically_increasing_id()), "mask-runs")


def touching(runs: DataFrame, *, tile: int = TILE) -> DataFrame:
    """``a, b``: runs that touch: in the row below, and across the edge of a tile."""
    own = runs.select("image", "y", "tile", "x0", "x1", "run")
    named = lambda p, df: df.select(*[F.col(c).alias(c if c in ("image", "y", "tile") else f"{p}_{c}") for c in own.columns])
    below = named("b", own.withColumn("y", F.col("y") - 1))
    down = named("a", own).join(below, ["image", "y", "tile"]).filter("a_x0 <= b_x1 + 1 AND b_x0 <= a_x1 + 1")
    left = own.filter(F.col("x1") == (F.col("tile") + 1) * tile - 1).withColumn("tile", F.col("tile") + 1)
    left = left.withColumn("y", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)))
    across = named("a", left).join(named("b", own.filter(F.col("x0") == F.col("tile") * tile)), ["image", "y", "tile"])
    return down.select(F.col("a_run").alias("a"), F.col("b_run").alias("b")).unionByName(across.select(F.col("a_run").alias("a"), F.col("b_run").alias("b")))


def label_regions(runs: DataFrame, *, tile: int = TILE, least_area: int = 1) -> DataFrame:
    """The runs with ``region``, one of its runs' numbers; regions of fewer pixels than ``least_area`` are left out."""
    labels = connected_components(materialise(touching(runs, tile=tile), "touching"))
    out = runs.join(labels, F.col("run") == F.col("node"), "left").withColumn("region", F.coalesce("component", "run")).drop("node", "component")
    if least_area > 1:
        areas = out.groupBy("region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).filter(F.col("area") >= least_area)
        out = out.join(areas.select("region"), "region", "left_semi")
    return materialise(out, "regions")


def region_boxes(regions: DataFrame) -> DataFrame:
    """``image, region, x0, y0, x1, y1`` (ends excluded), ``area`` and ``aspect`` (height over width)."""
    box = regions.groupBy("image", "region").agg(
        F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area")
    )
    return box.withColumn("aspect", (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))


def region_curve(pixels: DataFrame, regions: DataFrame, ordered: Sequence[float], *, by: str) -> DataFrame:
    """``by, threshold, pro, fpr, n_regions``: mean share of the regions and share of the clean pixels that reach a threshold.

    ``by`` is a column of ``pixels``, the same for all pixels of an image. Null without regions or clean pixels. A region
    adds its share of pixels by thresholds reached, so regions and thresholds are never combined.
    """
    groups = pixels.select("image", by).distinct()
    clean = pixels.filter("NOT mask").groupBy(by, reached(F.col("score"), ordered).alias("reached")).agg(F.count(F.lit(1)).alias("n"))
    counts = regions.select("image", "region", F.inline("bins")).groupBy("image", "region", "reached").agg(F.sum("n").alias("n"))
    each = counts.groupBy("image", "region").agg(F.sum("n").alias("area"), F.collect_list(F.struct("reached", "n")).alias("bins"))
    each = each.join(groups, "image").select(by, "area", F.inline("bins"))
    shares = each.groupBy(by, "reached").agg(F.sum(F.col("n") / F.col("area")).alias("share"))
    spine = pixels.select(by).distinct().withColumn("reached", F.explode(F.sequence(F.lit(0), F.lit(len(ordered)))))
    rows = spine.join(clean, [by, "reached"], "left").join(shares, [by, "reached"], "left").fillna(0, ["n", "share"])
    above = Window.partitionBy(by).orderBy(F.desc("reached")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(by)  # a row for each threshold
    regions_in = F.round(F.sum("share").over(whole))
    rates = rows.select(
        by,
        "reached",
        F.try_divide(F.sum("share").over(above), regions_in).alias("pro"),
        F.try_divide(F.sum("n").over(above), F.sum("n").over(whole)).alias("fpr"),
        regions_in.cast("long").alias("n_regions"),
    )
    value = F.element_at(F.array(*[F.lit(float(t)) for t in ordered]), F.greatest(F.col("reached"), F.lit(1)))
    return rates.filter("reached > 0").select(by, value.alias("threshold"), "pro", "fpr", "n_regions")


def segmentation_metrics(pixels: DataFrame, *, by: str, threshold: float = 0.5, limit: float = 0.3, levels: int = 200, tile: int = TILE) -> DataFrame:
    """``by, n_images, n_regions, dice, miou, pixel_auroc, aupro``: from scores and masks of pixels to the area.

    ``aupro`` is the area under the mean overlap of regions over the false-positive rate, up to ``limit`` and divided by it;
    null without regions or clean pixels, as the AUROC is.
    """
    ordered = thresholds(levels)
    regions = label_regions(mask_runs(pixels, ordered, tile=tile), tile=tile)
    curve = region_curve(pixels, regions, ordered, by=by)
    area = metrics.limited_area(curve, by=[by], x="fpr", y="pro", limit=limit).withColumnRenamed("area", "aupro")
    found = curve.groupBy(by).agg(F.max("n_regions").alias("n_regions"))
    images = pixels.groupBy(by, "image").agg(F.lit(1)).groupBy(by).agg(F.count(F.lit(1)).alias("n_images"))
    marked = pixels.select(by, "mask", (F.col("score") >= threshold).alias("hit"), F.col("mask").cast("int").alias("truth"), "score")
    overlap = metrics.region_overlap_metrics(marked, by=[by], truth="mask", predicted="hit")
    ranks = metrics.auroc(marked, by=[by], label="truth", score="score").withColumnRenamed("auroc", "pixel_auroc")
    return images.join(found, by).join(overlap, by).join(ranks, by).join(area, by)
