"""Quality of generated vectors by view, input, object and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import vectors
from siftlake.operators.bundle import quality_bundle as bundle
from siftlake.operators.bundle import sanity_checks
from siftlake.plans import common
from siftlake.plans.common import VECTORS
from siftlake.plans.registry import query

INPUTS = ("in0", "in1", "in2", "in3")
METRICS = ("nn_mean", "nn_median", "nn_p05", "nn_p95", "mnn_score", "kid")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Generated and reference vectors. Labels from 8 on are types without references; one input has no rows."""
    real, generated = common.vectors(spark, sf_dir)
    label = F.col("g").cast("int")
    kinds = {"object": F.concat(F.lit("o"), (label % 3).cast("string")), "type": F.concat(F.lit("t"), F.col("g"))}
    generated = generated.withColumns(kinds | {"input_name": F.concat(F.lit("in"), (F.col("id") % 7 % 3).cast("string")), "passed": F.get("v", F.lit(0)) > 0})
    return generated, real.withColumns(kinds).filter(label < 8)


_SIDES = f"""{VECTORS},
r AS (SELECT 'o' || CAST(g AS INTEGER) % 3 AS object, 't' || g AS type, id, v FROM ref WHERE CAST(g AS INTEGER) < 8),
x AS (SELECT 'o' || CAST(g AS INTEGER) % 3 AS object, 't' || g AS type, 'in' || (id % 7 % 3) AS input_name, v[1] > 0 AS passed, id, v FROM gen)"""
_GROUP = "view, input_name, object, defect_type"
_KERNEL = "pow(list_inner_product(a.v, b.v) / len(a.v) + 1, 3)"


@query(
    f"""WITH {_SIDES},
t AS (SELECT DISTINCT input_name, object, type AS defect_type FROM x WHERE object IN (SELECT object FROM r)
      UNION SELECT input_name, object, '__all__' FROM (SELECT DISTINCT object FROM r), (VALUES {", ".join(f"('{n}')" for n in INPUTS)}) i(input_name)),
s AS (SELECT view, input_name, object, defect_type, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.object = t.object AND r.type = t.defect_type) THEN 'type:' || defect_type ELSE 'object_all' END AS real_scope
      FROM t, (VALUES ('unfiltered'), ('filtered')) v(view)),
mx AS (SELECT {_GROUP}, id, v FROM s JOIN x USING (input_name, object) WHERE defect_type IN (type, '__all__') AND (view = 'unfiltered' OR passed)),
mr AS (SELECT {_GROUP}, id, v FROM s JOIN r USING (object) WHERE real_scope IN ('type:' || type, 'object_all')),
p AS (SELECT {_GROUP}, a.id AS x, b.id AS r, list_cosine_similarity(a.v, b.v) AS c, {_KERNEL} AS k FROM mx a JOIN mr b USING ({_GROUP})),
n AS (SELECT {_GROUP}, x, arg_max(r, (c, -r)) AS r, max(c) AS c FROM p GROUP BY {_GROUP}, x),
b AS (SELECT {_GROUP}, r, arg_max(x, (c, -x)) AS x FROM p GROUP BY {_GROUP}, r),
nn AS (SELECT {_GROUP}, count(*) AS n_generated, avg(c) AS nn_mean, quantile_cont(c, 0.5) AS nn_median, quantile_cont(c, 0.05) AS nn_p05, quantile_cont(c, 0.95) AS nn_p95 FROM n GROUP BY {_GROUP}),
mu AS (SELECT {_GROUP}, count(*) AS mutual FROM n JOIN b USING ({_GROUP}, x, r) GROUP BY {_GROUP}),
xr AS (SELECT {_GROUP}, avg(k) AS xr FROM p GROUP BY {_GROUP}),
xx AS (SELECT {_GROUP}, avg({_KERNEL}) AS xx FROM mx a JOIN mx b USING ({_GROUP}) WHERE a.id <> b.id GROUP BY {_GROUP}),
rr AS (SELECT {_GROUP}, avg({_KERNEL}) AS rr FROM mr a JOIN mr b USING ({_GROUP}) WHERE a.id <> b.id GROUP BY {_GROUP}),
nr AS (SELECT {_GROUP}, count(*) AS n_real FROM mr GROUP BY {_GROUP})
SELECT {_GROUP}, real_scope, n_real, coalesce(n_generated, 0) AS n_generated, CASE WHEN n_generated IS NULL THEN 'empty' ELSE 'ok' END AS status,
  round(nn_mean, 6) AS nn_mean, round(nn_median, 6) AS nn_median, round(nn_p05, 6) AS nn_p05, round(nn_p95, 6) AS nn_p95,
  round(CASE WHEN n_generated IS NOT NULL THEN coalesce(mutual, 0) / n_real END, 6) AS mnn_score, round(xx + rr - 2 * xr, 6) AS kid
FROM s LEFT JOIN nr USING ({_GROUP}) LEFT JOIN nn USING ({_GROUP}) LEFT JOIN mu USING ({_GROUP}) LEFT JOIN xr USING ({_GROUP}) LEFT JOIN xx USING ({_GROUP}) LEFT JOIN rr USING ({_GROUP})"""
)
def quality_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of views, inputs, objects and types with its metrics; ``quality_fid`` has the one that SQL cannot give."""
    rows = bundle(*sides(spark, sf_dir), inputs=INPUTS)
    return rows.drop("nn_min", "fid").withColumns({c: F.round(c, 6) for c in METRICS})


@query()
def quality_fid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Fréchet distance of every group; null with fewer than two rows on a side."""
    return bundle(*sides(spark, sf_dir), inputs=INPUTS).select("view", "input_name", "object", "defect_type", "real_scope", "n_real", "n_generated", F.round("fid", 6).alias("fid"))


@query()
def sanity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against themselves, and their components in another order with every other sign turned against them."""
    _, real = sides(spark, sf_dir)
    noise = real.withColumn("v", F.transform(F.reverse("v"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)))
    limits = vectors.calibrate(real, by="object").select(F.col("g").alias("object"), "tau_low")
    return sanity_checks(real, noise, limits, kid_gap=0.0)
