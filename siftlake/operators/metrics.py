"""Classification and segmentation metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.operators.quantiles import with_quantiles


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def auroc(df: DataFrame, *, by: Sequence[str], label: str, score: str) -> DataFrame:
    """``by..., auroc`` with average ranks for ties; null unless both classes occur.

    Scores are first counted by value, so the ordered window runs over distinct scores of a group.
    """
    counted = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(*by, F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auroc"))


def binary_metrics(df: DataFrame, *, by: Sequence[str], label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts at ``score >= threshold``, macro F1, positive F1, false-positive rate and AUROC by group."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    counts = df.groupBy(*by).agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1 = _ratio(2.0 * tp, 2 * tp + fp + fn)
    f0 = _ratio(2.0 * tn, 2 * tn + fp + fn)
    rows = counts.select(
        *by, "tp", "fp", "fn", "tn", ((f1 + f0) / 2).alias("macro_f1"), f1.alias("positive_f1"), _ratio(fp.cast("double"), fp + tn).alias("fpr")
    )
    curve = auroc(df, by=by, label=label, score=score)
    same = F.lit(True)
    for c in by:
        same = same & rows[c].eqNullSafe(curve[c])
    return rows.join(curve, same).select(*[rows[c] for c in rows.columns], "auroc")


def region_overlap_metrics(df: DataFrame, *, by: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Dice of the foreground and the mean of foreground and background IoU over all pixels (rows) of a group."""
    t, p = F.col(truth), F.col(predicted)
    sums = df.groupBy(*by).agg(
        F.count_if(t & p).alias("both"), F.count_if(t).alias("t"), F.count_if(p).alias("p"), F.count(F.lit(1)).alias("n")
    )
    union = F.col("t") + F.col("p") - F.col("both")
    background = F.col("n") - union
    one = F.lit(1)
    foreground_iou = F.col("both") / F.greatest(one, union)
    background_iou = background / F.greatest(one, F.col("n") - F.col("both"))
    dice = 2 * F.col("both") / F.greatest(one, F.col("t") + F.col("p"))
    return sums.select(*by, dice.alias("dice"), ((foreground_iou + background_iou) / 2).alias("miou"))


def threshold_curve(df: DataFrame, *, by: Sequence[str], label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """True and false positive rates at ``score >= threshold``; null without rows of the class.

    Scores are binned by the thresholds they reach and summed from the top; no row meets more than one threshold.
    """
    ordered = sorted(thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in ordered]), lambda t: t <= F.col(score)))
    bins = df.groupBy(*by, reached.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    spread = df.select(*by).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(ordered)))))
    keyed = spread.join(bins.withColumnRenamed("reached", "i"), [*by, "i"], "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    rates = keyed.withColumn("tpr", F.try_divide(F.sum("pos").over(above), F.sum("pos").over(whole))).withColumn("fpr", F.try_divide(F.sum("neg").over(above), F.sum("neg").over(whole)))
    value = F.element_at(F.array(*[F.lit(float(t)) for t in ordered]), F.greatest(F.col("i"), F.lit(1)))
    return rates.filter("i > 0").select(*by, value.alias("threshold"), "tpr", "fpr")


def limited_area(curve: DataFrame, *, by: Sequence[str], x: str, y: str, limit: float) -> DataFrame:
    """Trapezoid area of y over x from 0 to ``limit``, over ``limit``.

    A curve that begins right of 0 starts from (0, 0); one that ends before the limit goes on level; where it crosses
    the limit it is cut by interpolation, but a curve that lies beyond the limit as a whole has its first y there. A
    group with a null point has no area.
    """
    order = Window.partitionBy(*by).orderBy("x", "y")
    points = curve.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = points.withColumn("x0", F.coalesce(F.lag("x").over(order), F.lit(0.0))).withColumn("inside", F.lag("x").over(order).isNotNull())
    points = points.withColumn("y0", F.coalesce(F.lag("y").over(order), F.when(F.col("x") > 0, F.lit(0.0)).otherwise(F.col("y"))))
    cut = F.when(F.col("inside"), F.col("y0") + (limit - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("x") - F.col("x0"))).otherwise(F.col("y"))
    step = (
        F.when(F.col("x") <= limit, (F.col("x") - F.col("x0")) * (F.col("y0") + F.col("y")) / 2)
        .when(F.col("x0") < limit, (limit - F.col("x0")) * (F.col("y0") + cut) / 2)
        .otherwise(F.lit(0.0))
    )
    last = F.max(F.struct("x", "y"))
    rest = F.greatest(F.lit(limit) - last["x"], F.lit(0.0)) * last["y"]
    whole = F.every(F.col("x").isNotNull() & F.col("y").isNotNull())
    return points.groupBy(*by).agg(F.when(whole, (F.sum(step) + rest) / limit).alias("area"))


def per_region_curve(pixels: DataFrame, regions: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Mean overlap of regions and false-positive rate of clean pixels at each threshold, in order of that rate.

    ``pixels`` has ``image, y, x, prob``; ``regions`` ``image, y, x, region`` of the true regions' pixels. Pixels are
    counted once, by region and number of thresholds reached; only those counts are summed up for each threshold. All
    clean pixels are one region.
    """
    ordered = sorted(float(t) for t in thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in ordered]), lambda t: t <= F.col("prob"))).alias("reached")
    clean = F.col("region").isNull()
    rows = pixels.join(regions, ["image", "y", "x"], "left")
    rows = rows.select(clean.alias("clean"), F.when(~clean, F.col("image")).alias("image"), "region", reached)
    counts = rows.groupBy("clean", "image", "region", "reached").agg(F.count(F.lit(1)).alias("n"))
    by_region = counts.groupBy("clean", "image", "region").agg(F.sum("n").alias("n"), F.collect_list(F.struct("reached", F.col("n").alias("k"))).alias("bins"))
    levels = F.posexplode(F.array(*[F.lit(t) for t in ordered])).alias("i", "threshold")
    hit = F.aggregate(F.filter("bins", lambda b: b["reached"] > F.col("i")), F.lit(0).cast("long"), lambda s, b: s + b["k"])
    rates = by_region.select("clean", "bins", "n", levels).select("clean", "threshold", (hit / F.col("n")).alias("rate"))
    return rates.groupBy("threshold").agg(F.avg(F.when(~F.col("clean"), F.col("rate"))).alias("pro"), F.max(F.when(F.col("clean"), F.col("rate"))).alias("fpr"))


def score_summary(df: DataFrame, *, by: Sequence[str], score: str, inside: Column, threshold: float = 0.5) -> DataFrame:
    """Maximum, upper percentiles, counts over the threshold, and maxima and means inside and outside."""
    s = F.col(score)
    parts = [f(F.when(c, s)).alias(f"{n}_{w}") for w, c in (("inside", inside), ("outside", ~inside)) for n, f in (("max", F.max), ("mean", F.avg))]
    rows = df.groupBy(*by).agg(F.max(s).alias("max"), F.count_if(s >= threshold).alias("n_over"), *parts)
    return with_quantiles(rows, df, by=by, values={"": s}, at={"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999})
