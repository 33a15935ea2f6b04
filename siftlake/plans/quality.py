"""Embedding quality: neighbours, distances, calibration, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.cluster import materialise
from siftlake.functions.scalars import dot, log_z, unit
from siftlake.operators import cluster, neardup, ward, vectors as ops
from siftlake.operators.rules import geometry_rules, log_reference
from siftlake.plans import common
from siftlake.plans.common import VECTORS
from siftlake.plans.registry import query
from siftlake.sources.readers import table

_NN = """nn AS (
  SELECT a.g, a.id, arg_max(b.id, (list_cosine_similarity(a.v, b.v), -b.id)) AS neighbour, max(list_cosine_similarity(a.v, b.v)) AS similarity
  FROM gen a JOIN ref b ON a.g = b.g GROUP BY a.g, a.id)"""


@query(f"WITH {VECTORS}, {_NN} SELECT g, id, neighbour, round(similarity, 6) AS similarity FROM nn")
def nn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, generated = common.vectors(spark, sf_dir)
    return ops.nearest_neighbours(generated, real, by="g").withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH {VECTORS}, {_NN}, back AS (
  SELECT a.g, a.id, arg_max(b.id, (list_cosine_similarity(a.v, b.v), -b.id)) AS neighbour FROM ref a JOIN gen b ON a.g = b.g GROUP BY a.g, a.id)
SELECT r.g, r.n_real, round(coalesce(m.n, 0) / CAST(r.n_real AS DOUBLE), 6) AS mutual FROM (SELECT g, count(*) AS n_real FROM ref GROUP BY g) r
LEFT JOIN (SELECT back.g, count(*) AS n FROM back JOIN nn ON nn.id = back.neighbour AND nn.neighbour = back.id GROUP BY back.g) m ON r.g = m.g"""
)
def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, generated = common.vectors(spark, sf_dir)
    return ops.mutual_share(generated, real, by="g").withColumn("mutual", F.round("mutual", 6))


def _kid(biased: bool) -> str:
    n, skip = ("n * n", "") if biased else ("n * (n - 1)", "AND a.id <> b.id")

    def side(x: str) -> str:
        return f"(SELECT a.g, sum(pow(list_inner_product(a.v, b.v) / len(a.v) + 1, 3)) / max({n}) AS k FROM {x} a JOIN {x} b ON a.g = b.g {skip} JOIN (SELECT g, CAST(count(*) AS DOUBLE) AS n FROM {x} GROUP BY g) c ON a.g = c.g GROUP BY a.g)"

    cross = "(SELECT a.g, avg(pow(list_inner_product(a.v, b.v) / len(a.v) + 1, 3)) AS k FROM ref a JOIN gen b ON a.g = b.g GROUP BY a.g)"
    return f"""WITH {VECTORS} SELECT r.g, (SELECT count(*) FROM ref WHERE g = r.g) AS n_real, (SELECT count(*) FROM gen WHERE g = r.g) AS n_generated,
  round(r.k + x.k - 2 * c.k, 6) AS kid FROM {side("ref")} r JOIN {side("gen")} x ON r.g = x.g JOIN {cross} c ON r.g = c.g"""


@query(_kid(False))
def kid_unbiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.kernel_distance(*common.vectors(spark, sf_dir), by="g").withColumn("kid", F.round("kid", 6))


@query(_kid(True))
def kid_biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.kernel_distance(*common.vectors(spark, sf_dir), by="g", biased=True).withColumn("kid", F.round("kid", 6))


@query()
def fid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.frechet_distance(*common.vectors(spark, sf_dir), by="g")


@query(
    f"""WITH {VECTORS}, loo AS (SELECT a.g, a.id, max(list_cosine_similarity(a.v, b.v)) AS s FROM ref a JOIN ref b ON a.g = b.g AND a.id <> b.id GROUP BY a.g, a.id),
u AS (SELECT g, id, i, v[i] / sqrt(list_inner_product(v, v)) AS x FROM ref, range(1, 65) t(i)),
c AS (SELECT g, list(m ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS m FROM u GROUP BY g, i) GROUP BY g),
o AS (SELECT r.g, 1 - list_cosine_similarity(r.v, c.c) AS d FROM ref r JOIN c ON r.g = c.g)
SELECT l.g, l.n, round(tau_low, 6) AS tau_low, round(tau_outlier, 6) AS tau_outlier FROM (SELECT g, count(*) AS n, quantile_cont(s, 0.05) AS tau_low FROM loo GROUP BY g HAVING count(*) >= 3) l
JOIN (SELECT g, quantile_cont(d, 0.95) AS tau_outlier FROM o GROUP BY g) q ON l.g = q.g"""
)
def calibration_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, _ = common.vectors(spark, sf_dir)
    return ops.calibrate(real, by="g").select("g", "n", F.round("tau_low", 6).alias("tau_low"), F.round("tau_outlier", 6).alias("tau_outlier"))


@query(
    f"""WITH {VECTORS}, {_NN}, k AS (SELECT DISTINCT CAST(label AS VARCHAR) AS g FROM embeddings UNION SELECT '__none__'),
a AS (SELECT g, similarity FROM nn UNION ALL SELECT '__all__', similarity FROM nn)
SELECT s.g, CASE WHEN count(similarity) = 0 THEN 'empty' ELSE 'ok' END AS status, count(similarity) AS n, round(avg(similarity), 6) AS nn_mean, round(quantile_cont(similarity, 0.5), 6) AS nn_median,
  round(quantile_cont(similarity, 0.05), 6) AS nn_p05, round(quantile_cont(similarity, 0.95), 6) AS nn_p95
FROM (SELECT g FROM k UNION SELECT '__all__') s LEFT JOIN a ON s.g = a.g GROUP BY s.g"""
)
def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each group and one for all; a group without generated rows stays, with null metrics."""
    real, generated = common.vectors(spark, sf_dir)
    nearest = materialise(ops.nearest_neighbours(generated, real, by="g"), "nearest")
    both = nearest.select("g", "similarity").unionByName(nearest.select(F.lit("__all__").alias("g"), "similarity"))
    spine = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("g")).distinct()
    spine = spine.unionByName(spark.createDataFrame([("__none__",), ("__all__",)], "g string"))
    counts = both.groupBy("g").agg(F.count("similarity").alias("n"))
    rows = spine.join(counts, "g", "left").join(ops.neighbour_summary(both), "g", "left")
    status = F.when(F.col("n").isNull(), "empty").otherwise("ok")
    metrics = [F.round(c, 6).alias(c) for c in ("nn_mean", "nn_median", "nn_p05", "nn_p95")]
    return rows.select("g", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), *metrics)


@query(
    f"""WITH {VECTORS}, s AS (SELECT a.g, a.id, max(list_cosine_similarity(a.v, b.v)) AS s FROM ref a JOIN ref b ON a.g = b.g GROUP BY a.g, a.id)
SELECT g, bool_and(abs(s - 1) <= 1e-6) AS self_nn_ok FROM s GROUP BY g"""
)
def sanity_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set compared with itself finds itself."""
    real, _ = common.vectors(spark, sf_dir)
    nearest = ops.nearest_neighbours(real, real, by="g")
    return nearest.groupBy("g").agg(F.every(F.abs(F.col("similarity") - 1) <= 1e-6).alias("self_nn_ok"))


#: Levels of a component that make four bits of a hash, and the distance under which an accepted vector is a copy.
LEVELS, NEAR = (-0.3, -0.2, 0.2, 0.3), 10
_JUDGED = f"""z AS (SELECT g, id, v, list_sum(list_transform(v, lambda x: abs(x))) AS area, list_max(v) / -list_min(v) AS aspect,
         CAST(array_to_string(list_transform(v, lambda x: {" || ".join(f"CASE WHEN x > {t}::DOUBLE THEN '1' ELSE '0' END" for t in LEVELS)}), '') AS BIT) AS h FROM v),
lr AS (SELECT g, avg(ln(area)) AS am, stddev_samp(ln(area)) AS asd, quantile_cont(area, 0.05) AS p05, quantile_cont(area, 0.95) AS p95, avg(ln(aspect)) AS pm, stddev_samp(ln(aspect)) AS psd
       FROM z WHERE id % 10 = 0 GROUP BY g),
sc AS (SELECT z.g, z.id, z.h, z.area, abs((ln(area) - am) / asd) > 2.5 OR area < p05 OR area > p95 AS bad_area, abs((ln(aspect) - pm) / psd) > 2.5 AS bad_aspect,
         nn.similarity < tau_low AS low, nn.similarity >= 0.98 AS copy, 1 - list_cosine_similarity(z.v, c.c) > tau_outlier AS outlier
       FROM z JOIN lr USING (g) JOIN nn ON nn.g = z.g AND nn.id = z.id JOIN cal ON cal.g = z.g JOIN c ON c.g = z.g WHERE z.id % 10 <> 0)"""
_CALIBRATION = f"""loo AS (SELECT a.g, a.id, max(list_cosine_similarity(a.v, b.v)) AS s FROM ref a JOIN ref b ON a.g = b.g AND a.id <> b.id GROUP BY a.g, a.id),
u AS (SELECT g, id, i, v[i] / sqrt(list_inner_product(v, v)) AS x FROM ref, range(1, 65) t(i)),
c AS (SELECT g, list(m ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS m FROM u GROUP BY g, i) GROUP BY g),
o AS (SELECT r.g, 1 - list_cosine_similarity(r.v, c.c) AS d FROM ref r JOIN c ON r.g = c.g),
cal AS (SELECT l.g, tau_low, tau_outlier FROM (SELECT g, quantile_cont(s, 0.05) AS tau_low FROM loo GROUP BY g HAVING count(*) >= 3) l JOIN (SELECT g, quantile_cont(d, 0.95) AS tau_outlier FROM o GROUP BY g) q ON l.g = q.g)"""


@query(
    f"""WITH RECURSIVE {VECTORS}, {_NN}, {_CALIBRATION}, {_JUDGED},
o2 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS n, NOT (bad_area OR bad_aspect OR low OR copy OR outlier) AS able FROM sc),
kept AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS n, CAST([] AS BIT[]) AS hs, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS dist FROM sc
  UNION ALL
  SELECT q.g, q.n, CASE WHEN able AND coalesce(d, 999) >= {NEAR} THEN list_append(hs, h) ELSE hs END, q.id, d
  FROM (SELECT o2.*, k.hs, list_min(list_transform(k.hs, lambda x: bit_count(xor(x, o2.h)))) AS d FROM kept k JOIN o2 ON o2.g = k.g AND o2.n = k.n + 1) q)
SELECT o2.id, CAST(dist AS INTEGER) AS phash_min_dist, array_to_string(list_filter([CASE WHEN bad_area THEN 'AREA_OUT_OF_RANGE' END, CASE WHEN bad_aspect THEN 'ASPECT_OUT_OF_RANGE' END,
  CASE WHEN dist < {NEAR} THEN 'PHASH_DUPLICATE' END, CASE WHEN low THEN 'NN_TOO_LOW' END, CASE WHEN copy THEN 'NN_TOO_HIGH_COPY' END, CASE WHEN outlier THEN 'EMBEDDING_OUTLIER' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM o2 JOIN kept ON kept.id = o2.id"""
)
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six-rule filter over generated vectors, whose accepted rows alone are what later ones may be copies of.

    Thresholds come from the reference vectors: leave-one-out similarities, distances to the centroid, and logs of two
    measures of size; a vector's hash has four bits a component, by the levels that it is above.
    """
    real, generated = common.vectors(spark, sf_dir)
    measures = {"area": F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)), "aspect": F.array_max("v") / -F.array_min("v")}
    reference = log_reference(real.withColumns(measures), "g", area="area", aspect="aspect")
    thresholds = reference.join(ops.calibrate(real, by="g").drop("n"), "g").join(ops.centroids(real, by="g"), "g")
    thresholds = materialise(thresholds, "quality-thresholds")  # a row a group: Spark sees the size and need not shuffle the vectors by it
    nearest = ops.nearest_neighbours(generated, real, by="g").select("g", "id", F.col("similarity").alias("nn_score"))
    bits = F.array_join(F.transform("v", lambda x: F.concat(*[F.when(x > t, "1").otherwise("0") for t in LEVELS])), "")
    word = lambda i: F.conv(F.substring(F.col("bits"), 64 * i + 1, 64), 2, -10).cast("long")
    rows = generated.withColumns(measures | {"bits": bits}).join(thresholds, "g").join(nearest, ["g", "id"])
    scores = {
        "h": F.array(*[word(i) for i in range(4)]),
        "roi_containment": F.lit(1.0),
        "area_ratio": F.col("area"),
        "area_zscore": log_z(F.col("area"), F.col("area_mean_log"), F.col("area_std_log")),
        "aspect_zscore": log_z(F.col("aspect"), F.col("aspect_mean_log"), F.col("aspect_std_log")),
        "outlier_score": 1 - dot(unit(F.col("v")), F.col("centroid")),
        "seam_score": F.lit(1.0),
    }
    judged = materialise(rows.withColumns(scores).drop("v", "bits", "centroid"), "quality-scores")
    out = neardup.filter_in_order(judged, geometry_rules(phash_min=NEAR), least=NEAR)
    return out.select("id", "phash_min_dist", F.array_join("reject_reasons", ",").alias("reasons"))


@query()
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward clusters of all vectors of each label."""
    real, generated = common.vectors(spark, sf_dir)
    return ward.ward_clusters(real.unionByName(generated), by="g")


#: The fit at a place is the largest, over all starts up to it, of the smallest mean from there to an end past it.
@query(
    """WITH p AS (SELECT l_returnflag, l_linenumber AS x, avg(l_quantity) AS y FROM lineitem GROUP BY ALL),
t AS (SELECT l_returnflag, avg(l_quantity) AS t FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
m AS (SELECT a.l_returnflag, a.x AS low, b.x AS high, avg(c.y) AS mean FROM p a JOIN p b ON a.l_returnflag = b.l_returnflag AND a.x <= b.x
      JOIN p c ON c.l_returnflag = a.l_returnflag AND c.x BETWEEN a.x AND b.x GROUP BY ALL),
l AS (SELECT m.l_returnflag, low, p.x, min(mean) AS least FROM m JOIN p ON p.l_returnflag = m.l_returnflag AND p.x BETWEEN low AND high GROUP BY ALL),
f AS (SELECT l_returnflag, x, max(least) AS fit FROM l GROUP BY ALL),
s AS (SELECT f.*, t, lead(x) OVER w AS next_x, lead(fit) OVER w AS next_fit, min(x) OVER g AS first_x, max(x) OVER g AS last_x, min(fit) OVER g AS first_fit, max(fit) OVER g AS last_fit
      FROM f JOIN t ON f.l_returnflag = t.l_returnflag WINDOW w AS (PARTITION BY f.l_returnflag ORDER BY x), g AS (PARTITION BY f.l_returnflag)),
r AS (SELECT l_returnflag, any_value(t) AS t, any_value(first_x) AS first_x, any_value(last_x) AS last_x, any_value(first_fit) AS first_fit, any_value(last_fit) AS last_fit,
             max(CASE WHEN fit <= t THEN {'x': x, 'fit': fit, 'next_x': next_x, 'next_fit': next_fit} END) AS s FROM s GROUP BY l_returnflag)
SELECT l_returnflag, round(CAST(CASE WHEN t < first_fit THEN first_x WHEN t > last_fit OR s.next_x IS NULL OR s.fit = t THEN coalesce(s.x, last_x)
         ELSE s.x + (t - s.fit) / (s.next_fit - s.fit) * (s.next_x - s.x) END AS DOUBLE), 6) AS x,
       CASE WHEN t < first_fit THEN 'below' WHEN t > last_fit THEN 'above' ELSE 'at' END AS relation FROM r"""
)
def isotonic_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which order count of a line number the mean quantity of small orders is reached."""
    items = table(spark, sf_dir, "lineitem")
    points = items.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("y"))
    target = items.filter("l_linenumber <= 2").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("t"))
    out = cluster.equivalents(points.join(target, "l_returnflag"), by="l_returnflag", x="l_linenumber", y="y", target="t")
    return out.withColumn("x", F.round("x", 6))
