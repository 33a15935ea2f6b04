"""Classification and segmentation measures and score distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.cluster import materialise
from siftlake.functions.scalars import log_z
from siftlake.operators import imaging, metrics, rules
from siftlake.plans.common import SCORED, scored
from siftlake.plans.registry import query
from siftlake.sources.readers import table

_AUROC = """k AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS r FROM scored),
a AS (SELECT lang, CASE WHEN sum(quality) > 0 AND sum(1 - quality) > 0 THEN
  (sum(r * quality) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / (sum(quality)::DOUBLE * sum(1 - quality)) END AS auroc FROM k GROUP BY lang)"""


@query(f"WITH {SCORED}, {_AUROC} SELECT lang, round(auroc, 6) AS auroc FROM a")
def auroc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(scored(spark, sf_dir), by=["lang"], label="quality", score="score").withColumn("auroc", F.round("auroc", 6))


@query(
    f"""WITH {SCORED}, {_AUROC}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (quality = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (quality = 1 AND score < 0.5) AS fn, count(*) FILTER (quality = 0 AND score < 0.5) AS tn FROM scored GROUP BY lang)
SELECT c.lang, tp, fp, fn, tn, round((2.0::DOUBLE * tp / greatest(1, 2 * tp + fp + fn) + 2.0::DOUBLE * tn / greatest(1, 2 * tn + fp + fn)) / 2, 6) AS macro_f1,
  round(2.0::DOUBLE * tp / greatest(1, 2 * tp + fp + fn), 6) AS positive_f1, round(fp / CAST(greatest(1, fp + tn) AS DOUBLE), 6) AS fpr, round(auroc, 6) AS auroc FROM c JOIN a ON c.lang = a.lang"""
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.binary_metrics(scored(spark, sf_dir), by=["lang"], label="quality", score="score")
    return rows.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("macro_f1", "positive_f1", "fpr", "auroc")])


@query(
    """WITH s AS (SELECT l_returnflag AS g, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS b, count(*) FILTER (l_quantity > 25) AS t, count(*) FILTER (l_discount > 0.05) AS p, count(*) AS n FROM lineitem GROUP BY 1)
SELECT g, round(2 * b / CAST(greatest(1, t + p) AS DOUBLE), 6) AS dice, round((b / CAST(greatest(1, t + p - b) AS DOUBLE) + (n - t - p + b) / CAST(greatest(1, n - b) AS DOUBLE)) / 2, 6) AS miou FROM s"""
)
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") > 25).alias("t"), (F.col("l_discount") > 0.05).alias("p"))
    out = metrics.region_overlap_metrics(rows, by=["g"], truth="t", predicted="p")
    return out.select("g", F.round("dice", 6).alias("dice"), F.round("miou", 6).alias("miou"))


THRESHOLDS = [i / 10 for i in range(1, 11)]
_CURVE = f"""{SCORED}, curve AS (SELECT lang, t / 10.0::DOUBLE AS threshold, count(*) FILTER (quality = 1 AND score >= t / 10.0::DOUBLE) / nullif(CAST(sum(quality) AS DOUBLE), 0) AS tpr,
  count(*) FILTER (quality = 0 AND score >= t / 10.0::DOUBLE) / nullif(CAST(sum(1 - quality) AS DOUBLE), 0) AS fpr FROM scored, range(1, 11) r(t) GROUP BY lang, t)"""


@query(f"WITH {_CURVE} SELECT lang, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM curve")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.threshold_curve(scored(spark, sf_dir), by=["lang"], label="quality", score="score", thresholds=THRESHOLDS)
    return rows.select("lang", "threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(
    f"""WITH {_CURVE},
k AS (SELECT lang, fpr AS x, tpr AS y FROM curve WHERE fpr <= 0.3),
nearest AS (SELECT lang, arg_max(fpr, fpr + tpr * 1e-9) FILTER (fpr <= 0.3) AS x0, arg_max(tpr, fpr + tpr * 1e-9) FILTER (fpr <= 0.3) AS y0,
                   min(fpr) FILTER (fpr > 0.3) AS x1, arg_min(tpr, fpr + tpr * 1e-9) FILTER (fpr > 0.3) AS y1 FROM curve GROUP BY lang),
p AS (SELECT * FROM k
      UNION ALL SELECT lang, 0.0::DOUBLE, 0.0::DOUBLE FROM curve GROUP BY lang HAVING min(fpr) > 0
      UNION ALL SELECT lang, 0.3::DOUBLE, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (0.3::DOUBLE - x0) * (y1 - y0) / (x1 - x0) END FROM nearest WHERE coalesce(x0, 0) < 0.3),
s AS (SELECT lang, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY lang ORDER BY x, y))
SELECT lang, round(sum((x - x0) * (y + y0) / 2) / 0.3, 6) AS area FROM s GROUP BY lang"""
)
def limited_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area under the curve from 0 to a false-positive rate of 0.3, cut there by interpolation or held level."""
    curve = metrics.threshold_curve(scored(spark, sf_dir), by=["lang"], label="quality", score="score", thresholds=THRESHOLDS)
    return metrics.limited_area(curve, by=["lang"], x="fpr", y="tpr", limit=0.3).withColumn("area", F.round("area", 6))


@query(
    f"""WITH {SCORED} SELECT source, round(max(score), 6) AS max, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99,
  round(quantile_cont(score, 0.999), 6) AS p999, count(*) FILTER (score >= 0.5) AS n_over, round(max(score) FILTER (toxic = 1), 6) AS max_inside, round(avg(score) FILTER (toxic = 1), 6) AS mean_inside,
  round(max(score) FILTER (toxic = 0), 6) AS max_outside, round(avg(score) FILTER (toxic = 0), 6) AS mean_outside FROM scored GROUP BY source"""
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.score_summary(scored(spark, sf_dir), by=["source"], score="score", inside=F.col("toxic") == 1)
    return rows.select(*[c if c in ("source", "n_over") else F.round(c, 6).alias(c) for c in rows.columns])


@query(
    """WITH c AS (SELECT l_linestatus AS g, CASE WHEN l_quantity < 0 THEN 0 ELSE least(9, CAST(floor((l_extendedprice) / 10000.0::DOUBLE) AS INTEGER)) END AS bin,
  count(*) FILTER (l_returnflag <> 'R') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL),
d AS (SELECT g, bin, abs(sum(a) OVER w / CAST(sum(a) OVER (PARTITION BY g) AS DOUBLE) - sum(b) OVER w / CAST(sum(b) OVER (PARTITION BY g) AS DOUBLE)) AS gap,
  coalesce(lead(bin) OVER (PARTITION BY g ORDER BY bin), bin + 1) - bin AS step FROM c WINDOW w AS (PARTITION BY g ORDER BY bin ROWS UNBOUNDED PRECEDING))
SELECT g, round(sum(gap * step * 10000), 6) AS distance FROM d GROUP BY g"""
)
def wasserstein_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("side"), "l_extendedprice")
    out = imaging.histogram_distance(rows, by=["g"], side="side", value="l_extendedprice", bins=10, low=0.0, high=100000.0)
    return out.withColumn("distance", F.round("distance", 6))


@query(
    """WITH o AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
m AS (SELECT lang, max(n_chars) FILTER (i = (n - 1) // 2 + 1) AS median, min(n_chars) AS least FROM o GROUP BY lang)
SELECT m.lang, median, round(count(*) FILTER (n_chars BETWEEN median // 2 AND median * 2) / CAST(count(*) AS DOUBLE), 6) AS in_band, any_value(least) * 2 > any_value(median) AS least_is_high,
  round(count(*) FILTER (n_chars < 100) / CAST(count(*) AS DOUBLE), 6) AS short_share FROM m JOIN documents d ON m.lang = d.lang GROUP BY ALL"""
)
def distribution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower median, shares in a band around it and below a limit, and whether even the least is high."""
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars")
    values = docs.groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    by_lang = values.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n_chars", "n"))).alias("v"), F.sum("n").alias("total"), F.min("n_chars").alias("least"))
    place = F.floor((F.col("total") - 1) / 2)
    found = F.aggregate("v", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("at")), lambda s, x: F.struct(
        (s["upto"] + x["n"]).alias("upto"), F.coalesce(s["at"], F.when(s["upto"] + x["n"] > place, x["n_chars"])).alias("at")
    ))
    medians = by_lang.select("lang", found["at"].alias("median"), "least")
    rows = docs.join(medians, "lang")
    band = F.col("n_chars").between(F.floor(F.col("median") / 2), F.col("median") * 2)
    return rows.groupBy("lang", "median").agg(
        F.round(F.count_if(band) / F.count(F.lit(1)), 6).alias("in_band"),
        F.any_value(F.col("least") * 2 > F.col("median")).alias("least_is_high"),
        F.round(F.count_if(F.col("n_chars") < 100) / F.count(F.lit(1)), 6).alias("short_share"),
    )


@query(
    """WITH r AS (SELECT l_returnflag AS g, avg(ln(l_quantity)) AS am, stddev_samp(ln(l_quantity)) AS asd, quantile_cont(CAST(l_quantity AS DOUBLE), 0.05) AS p05, quantile_cont(CAST(l_quantity AS DOUBLE), 0.95) AS p95,
  avg(ln(l_extendedprice)) AS pm, stddev_samp(ln(l_extendedprice)) AS psd FROM lineitem GROUP BY 1),
d AS (SELECT array_to_string(list_filter([
  CASE WHEN l_tax > 0.07 THEN 'ROI_OVERFLOW' END,
  CASE WHEN abs((ln(l_quantity) - am) / asd) > 2.5 OR l_quantity < p05 OR l_quantity > p95 THEN 'AREA_OUT_OF_RANGE' END,
  CASE WHEN abs((ln(l_extendedprice) - pm) / psd) > 2.5 THEN 'ASPECT_OUT_OF_RANGE' END,
  CASE WHEN l_suppkey % 16 < 5 THEN 'PHASH_DUPLICATE' END,
  CASE WHEN 1 - l_discount < 0.915 THEN 'NN_TOO_LOW' END,
  CASE WHEN 1 - l_discount >= 0.98 THEN 'NN_TOO_HIGH_COPY' END,
  CASE WHEN l_tax > 0.065 THEN 'EMBEDDING_OUTLIER' END,
  CASE WHEN 1 - 2 * l_discount < 0.85 THEN 'SEAM_POOR' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem JOIN r ON l_returnflag = g)
SELECT reasons, count(*) AS n FROM d GROUP BY reasons"""
)
def geometry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each combination of the quality filter's eight reasons occurs, over score columns made from line items."""
    items = table(spark, sf_dir, "lineitem")
    reference = rules.log_reference(items, "l_returnflag", area="l_quantity", aspect="l_extendedprice")
    reference = materialise(reference, "geometry-reference")  # a row a flag: Spark sees the size and need not shuffle the items by it
    rows = items.join(reference, "l_returnflag")
    scores = {
        "roi_containment": F.when(F.col("l_tax") > 0.07, 0.99).otherwise(1.0),
        "area_ratio": F.col("l_quantity"),
        "area_zscore": log_z(F.col("l_quantity"), F.col("area_mean_log"), F.col("area_std_log")),
        "aspect_zscore": log_z(F.col("l_extendedprice"), F.col("aspect_mean_log"), F.col("aspect_std_log")),
        "phash_min_dist": F.col("l_suppkey") % 16,
        "nn_score": 1 - F.col("l_discount"),
        "tau_low": F.lit(0.915),
        "outlier_score": F.col("l_tax"),
        "tau_outlier": F.lit(0.065),
        "seam_score": 1 - 2 * F.col("l_discount"),
    }
    judged = rules.decide(rows.withColumns(scores), rules.geometry_rules())
    return judged.groupBy(F.array_join("reject_reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))
