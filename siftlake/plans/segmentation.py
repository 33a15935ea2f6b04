"""Pixel masks: regions and segmentation measures over images made from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import regions
from siftlake.plans.registry import query
from siftlake.sources.readers import table

LEVELS, LIMIT = 51, 0.3
PIXELS = """px AS (SELECT label AS object, vec_id AS image, i // 8 AS y, i % 8 AS x, CAST(floor(1000 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + 2 * CAST(embedding[i + 1] AS DOUBLE)))) AS BIGINT) / 1000.0::DOUBLE AS score,
         CAST(embedding[i + 1] AS DOUBLE) * 2 + CAST(embedding[(i + 9) % 64 + 1] AS DOUBLE) > 0.1::DOUBLE AS mask FROM embeddings, range(64) r(i))"""
REGIONS = f"""WITH RECURSIVE {PIXELS},
m AS (SELECT image, y, x, y * 8 + x AS p FROM px WHERE mask),
e AS (SELECT a.image, a.p, b.p AS q FROM m a JOIN m b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT image, p, p AS q FROM m UNION SELECT r.image, r.p, e.q FROM reach r JOIN e ON r.image = e.image AND r.q = e.p),
lab AS (SELECT image, p, min(q) AS region FROM reach GROUP BY image, p)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an image of 8 x 8 pixels: a score from its values, a mask from each with another one."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("object"), F.col("vec_id").alias("image"), v.alias("v"), F.posexplode(v).alias("i", "a"))
    score = F.floor(1000 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 2 * F.col("a")))) / 1000.0
    other = F.get("v", (F.col("i") + 9) % 64)
    return rows.select("object", "image", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), score.alias("score"), (F.col("a") * 2 + other > 0.1).alias("mask"))


@query(
    REGIONS
    + """ SELECT l.image, min(p // 8) AS y0, min(p % 8) AS x0, max(p // 8) + 1 AS y1, max(p % 8) + 1 AS x1, count(*) AS area FROM lab l GROUP BY l.image, region HAVING count(*) >= 3"""
)
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounding boxes of all regions of three pixels or more; rows of an image are cut in tiles of five pixels."""
    runs = regions.mask_runs(pixels(spark, sf_dir), [0.5], tile=5)
    return regions.region_boxes(regions.label_regions(runs, tile=5, least_area=3)).select("image", "y0", "x0", "y1", "x1", "area")


@query(
    REGIONS
    + f""", t AS (SELECT -1e-7::DOUBLE + i * (1 + 2 * 1e-7::DOUBLE) / {LEVELS - 1} AS t FROM range({LEVELS}) r(i)),
a AS (SELECT object, image, region, count(*) AS n FROM lab JOIN px USING (image) WHERE px.y * 8 + px.x = lab.p GROUP BY ALL),
hit AS (SELECT px.object, px.image, region, t, count(*) AS k FROM lab JOIN px ON px.image = lab.image AND px.y * 8 + px.x = lab.p JOIN t ON px.score >= t GROUP BY ALL),
pro AS (SELECT object, t, sum(k / CAST(n AS DOUBLE)) AS s FROM hit JOIN a USING (object, image, region) GROUP BY ALL),
clean AS (SELECT object, t, count(*) AS k FROM px JOIN t ON score >= t WHERE NOT mask GROUP BY ALL),
o AS (SELECT object, count(DISTINCT image) AS n_images, count(*) FILTER (mask AND score >= 0.5) AS b, count(*) FILTER (mask) AS tr, count(*) FILTER (score >= 0.5) AS pr, count(*) AS n FROM px GROUP BY object),
nr AS (SELECT object, count(*) AS n_regions FROM a GROUP BY object),
curve AS (SELECT o.object, t.t, coalesce(clean.k, 0) / nullif(CAST(n - tr AS DOUBLE), 0) AS fpr, coalesce(pro.s, 0) / nullif(n_regions, 0) AS pro
          FROM o CROSS JOIN t LEFT JOIN clean ON clean.object = o.object AND clean.t = t.t LEFT JOIN pro ON pro.object = o.object AND pro.t = t.t LEFT JOIN nr ON nr.object = o.object),
k AS (SELECT object, fpr AS x, pro AS y FROM curve WHERE fpr <= {LIMIT}),
nearest AS (SELECT object, arg_max(fpr, fpr + pro * 1e-9) FILTER (fpr <= {LIMIT}) AS x0, arg_max(pro, fpr + pro * 1e-9) FILTER (fpr <= {LIMIT}) AS y0,
                   min(fpr) FILTER (fpr > {LIMIT}) AS x1, arg_min(pro, fpr + pro * 1e-9) FILTER (fpr > {LIMIT}) AS y1 FROM curve GROUP BY object),
p AS (SELECT * FROM k
      UNION ALL SELECT object, 0.0::DOUBLE, 0.0::DOUBLE FROM curve GROUP BY object HAVING min(fpr) > 0
      UNION ALL SELECT object, {LIMIT}::DOUBLE, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + ({LIMIT}::DOUBLE - x0) * (y1 - y0) / (x1 - x0) END FROM nearest WHERE coalesce(x0, 0) < {LIMIT}),
s AS (SELECT object, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY object ORDER BY x, y)),
area AS (SELECT object, sum((x - x0) * (y + y0) / 2) / {LIMIT} AS aupro FROM s GROUP BY object),
rk AS (SELECT object, CAST(mask AS INTEGER) AS m, rank() OVER (PARTITION BY object ORDER BY score) + (count(*) OVER (PARTITION BY object, score) - 1) / 2.0::DOUBLE AS r FROM px),
auc AS (SELECT object, CASE WHEN sum(m) > 0 AND sum(1 - m) > 0 THEN (sum(r * m) - sum(m) * (sum(m) + 1) / 2.0::DOUBLE) / (sum(m)::DOUBLE * sum(1 - m)) END AS pixel_auroc FROM rk GROUP BY object)
SELECT o.object, n_images, coalesce(n_regions, 0) AS n_regions, round(2 * b / CAST(greatest(1, tr + pr) AS DOUBLE), 6) AS dice,
  round((b / CAST(greatest(1, tr + pr - b) AS DOUBLE) + (n - tr - pr + b) / CAST(greatest(1, n - b) AS DOUBLE)) / 2, 6) AS miou, round(pixel_auroc, 6) AS pixel_auroc,
  round(CASE WHEN n_regions > 0 AND n > tr THEN aupro END, 6) AS aupro FROM o JOIN auc USING (object) LEFT JOIN nr USING (object) LEFT JOIN area USING (object)"""
)
def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, pixel AUROC and the area under the per-region overlap curve of each object."""
    found = regions.segmentation_metrics(pixels(spark, sf_dir), by="object", limit=LIMIT, levels=LEVELS, tile=5)
    return found.select("object", "n_images", "n_regions", *[F.round(c, 6).alias(c) for c in ("dice", "miou", "pixel_auroc", "aupro")])
