"""Pixel relations and per-image helpers. An image is one row; nothing here gathers images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.operators.neardup import greedy_accept


def label_components(mask: np.ndarray, least_area: int = 1) -> np.ndarray:
    """8-connected components numbered from 1 in reading order; smaller ones than ``least_area`` become 0."""
    h, w = mask.shape
    labels = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        padded = np.pad(labels, 1, constant_values=0)
        around = [padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        lowest = np.where(mask, np.min([np.where(a > 0, a, h * w + 1) for a in around], axis=0), 0)
        if (lowest == labels).all():
            break
        labels = lowest
    roots, inverse, counts = np.unique(labels, return_inverse=True, return_counts=True)
    number, out = 0, np.zeros(len(roots), np.int64)
    for i, (root, count) in enumerate(zip(roots, counts)):
        if root > 0 and count >= least_area:
            number += 1
            out[i] = number
    return out[inverse].reshape(h, w)


def mask_components(images: DataFrame, *, image: str, mask: str, least_area: int = 1) -> DataFrame:
    """``image, region, y, x`` of every pixel of a kept component; ``mask`` is an array of rows of booleans."""
    ship(images.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for key, rows in zip(frame["image"], frame["mask"]):
                labels = label_components(np.array([np.asarray(r, bool) for r in rows]), least_area)
                y, x = np.nonzero(labels)
                yield pd.DataFrame({"image": key, "region": labels[y, x], "y": y.astype("int32"), "x": x.astype("int32")})

    rows = images.select(F.col(image).alias("image"), F.col(mask).alias("mask"))
    kind = dict(rows.dtypes)["image"]
    return rows.mapInPandas(run, f"image {kind}, region long, y int, x int")


def bounding_boxes(pixels: DataFrame, *, by: list[str]) -> DataFrame:
    """``x0, y0, x1, y1`` (ends excluded), area and height over width of each region of pixels."""
    box = pixels.groupBy(*by).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count(F.lit(1)).alias("area")
    )
    return box.withColumn("aspect", (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))


def containment(inner: DataFrame, outer: DataFrame, image: str = "image") -> DataFrame:
    """The share of an image's inner pixels that are outer pixels too."""
    marked = inner.join(outer.select(image, "y", "x").withColumn("inside", F.lit(1)), [image, "y", "x"], "left")
    return marked.groupBy(image).agg((F.sum(F.coalesce("inside", F.lit(0))) / F.count(F.lit(1))).alias("containment"))


def box_conflicts(boxes: DataFrame, *, by: str, id_col: str = "id", cell: int = 64, margin: int = 0) -> DataFrame:
    """``a < b`` of boxes (``x0, y0, x1, y1``, ends excluded) of one background that come closer than ``margin`` or overlap.

    Boxes are listed in the grid cells they touch and meet by cell; a pair is reported in the first cell both touch.
    """
    m = F.lit(margin)
    cells = [F.sequence(F.floor((F.col(f"{c}0") - m) / cell), F.floor((F.col(f"{c}1") + m - 1) / cell)) for c in "xy"]
    spread = boxes.select(F.col(by).alias("g"), F.col(id_col).alias("id"), "x0", "y0", "x1", "y1", F.explode(cells[0]).alias("cx"), cells[1].alias("cys"))
    spread = spread.select("g", "id", "x0", "y0", "x1", "y1", "cx", F.explode("cys").alias("cy"))
    a, b = spread.alias("a"), spread.alias("b")
    same = (F.col("a.g") == F.col("b.g")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") < F.col("b.id"))
    near = F.lit(True)
    for c in "xy":
        near = near & (F.col(f"a.{c}0") < F.col(f"b.{c}1") + m) & (F.col(f"b.{c}0") < F.col(f"a.{c}1") + m)
        near = near & (F.col(f"a.c{c}") == F.floor((F.greatest(f"a.{c}0", f"b.{c}0") - m) / cell))
    return a.join(b.hint("merge"), same & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


#: Boxes of a background up to which one task places them in order.
PLACED = 20_000


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by background and id; a box is accepted if it overlaps none accepted before. Only a background's accepted ones are held."""
    background, placed = None, []
    for batch in batches:
        out = []
        for g, x0, y0, x1, y1 in zip(*(batch.column(c).to_pylist() for c in ("g", "x0", "y0", "x1", "y1"))):
            if g != background:
                background, placed = g, []
            if None in (x0, y0, x1, y1):  # overlaps nothing, as in SQL
                out.append(True)
                continue
            for a0, b0, a1, b1 in placed:
                if x0 < a1 and a0 < x1 and y0 < b1 and b0 < y1:
                    out.append(False)
                    break
            else:
                placed.append((x0, y0, x1, y1))
                out.append(True)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.bool_())], names=["id", "accepted"])


def place_in_order(boxes: DataFrame, *, by: str, id_col: str = "id", most: int = PLACED) -> DataFrame:
    """``id, accepted``: boxes (``x0, y0, x1, y1``, ends excluded) of one background in order of id, each accepted if it overlaps no accepted one.

    A background of up to ``most`` boxes is decided by one task that sees each box once: no pairs are made. Larger ones are decided
    from their overlapping pairs, see ``greedy_accept``. ``boxes`` is read more than once; ids are unique whole numbers. A box with a
    null corner or without a background is accepted.
    """
    ship(boxes.sparkSession)
    rows = boxes.select(F.col(by).alias("g"), F.col(id_col).cast("long").alias("id"), "x0", "y0", "x1", "y1")
    large = rows.filter("g IS NOT NULL").groupBy(F.col("g").alias("large_g")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("large_g")
    large = materialise(large, "large-backgrounds")
    few = rows.join(large, F.col("g") == F.col("large_g"), "left_anti").filter("g IS NOT NULL")
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = few.repartition(parts, "g").sortWithinPartitions("g", "id").mapInArrow(_place, "id long, accepted boolean")
    out = out.unionByName(rows.filter("g IS NULL").select("id", F.lit(True).alias("accepted")))
    if large.isEmpty():
        return out
    many = rows.join(large, F.col("g") == F.col("large_g"), "left_semi")
    return out.unionByName(greedy_accept(many.select("id", F.lit(True).alias("eligible")), box_conflicts(many, by="g")))


def perceptual_hash(pixels: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """Signs of the low two-dimensional cosine frequencies against their median, as one integer."""
    n = size * factor
    rows = np.add.reduceat(pixels.astype(float), np.linspace(0, pixels.shape[0], n, endpoint=False).astype(int), axis=0)
    small = np.add.reduceat(rows, np.linspace(0, pixels.shape[1], n, endpoint=False).astype(int), axis=1)
    basis = np.cos(np.pi * np.outer(np.arange(size), 2 * np.arange(n) + 1) / (2 * n))
    low = basis @ small @ basis.T
    bits = (low > np.median(low)).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)


def histogram_distance(df: DataFrame, *, by: list[str], side: str, value: str, bins: int, low: float, high: float) -> DataFrame:
    """First Wasserstein distance between the binned values of two sides (0 and 1), in units of the value."""
    width = (high - low) / bins
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / width))).cast("int")
    counts = df.groupBy(*by, place.alias("bin")).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    from pyspark.sql import Window

    whole = Window.partitionBy(*by)
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.abs(F.try_divide(F.sum("a").over(upto), F.sum("a").over(whole)) - F.try_divide(F.sum("b").over(upto), F.sum("b").over(whole)))
    following = F.coalesce(F.lead("bin").over(Window.partitionBy(*by).orderBy("bin")), F.col("bin") + 1)
    return counts.withColumn("part", gap * (following - F.col("bin")) * width).groupBy(*by).agg(F.sum("part").alias("distance"))
