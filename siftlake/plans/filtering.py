"""The filter funnel and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise
from siftlake.functions.scalars import log_z
from siftlake.operators import lineage, rules, scan
from siftlake.operators.quantiles import with_quantiles
from siftlake.plans.common import SAMPLES, samples
from siftlake.plans.registry import query
from siftlake.sources.readers import table

STAGES = [
    ("blocklist", ["BLOCKLISTED"]),
    ("area", ["NO_REFERENCE", "AREA_OUT_OF_RANGE"]),
    ("aspect", ["ASPECT_OUT_OF_RANGE"]),
    ("duplicate", ["EXACT_DUPLICATE"]),
]


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged by containment of benchmark passages, size and shape against labelled good ones, and copies.

    The texts are read once; what follows runs on the narrow table written then. A document whose language (null is
    one) has no labelled good documents is refused as NO_REFERENCE.
    """
    rows = materialise(samples(spark, sf_dir, table(spark, sf_dir, "benchmark").select("text")), "samples")
    reference = rules.log_reference(rows.filter("quality = 1"), "lang", area="n_chars", aspect="per_line").withColumnRenamed("lang", "reference_lang")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    rows = rows.join(first, "sha").join(reference.withColumn("known", F.lit(True)), F.col("lang").eqNullSafe(F.col("reference_lang")), "left")
    area_z = log_z(F.col("n_chars"), F.col("area_mean_log"), F.col("area_std_log"))
    aspect_z = log_z(F.col("per_line"), F.col("aspect_mean_log"), F.col("aspect_std_log"))
    outside = (F.col("n_chars") < F.col("area_p05")) | (F.col("n_chars") > F.col("area_p95"))
    return rules.decide(
        rows,
        [
            rules.Rule("blocklist", "BLOCKLISTED", F.col("contains_passage")),
            rules.Rule("area", "NO_REFERENCE", F.col("known").isNull()),
            rules.Rule("area", "AREA_OUT_OF_RANGE", (F.abs(area_z) > 2.5) | outside),
            rules.Rule("aspect", "ASPECT_OUT_OF_RANGE", F.abs(aspect_z) > 2.5),
            rules.Rule("duplicate", "EXACT_DUPLICATE", F.col("doc_id") > F.col("first_id")),
        ],
    )


DECIDED = f"""WITH {SAMPLES},
ref AS (
  SELECT lang, avg(ln(n_chars)) AS area_m, stddev_samp(ln(n_chars)) AS area_s, quantile_cont(CAST(n_chars AS DOUBLE), 0.05) AS p05, quantile_cont(CAST(n_chars AS DOUBLE), 0.95) AS p95,
         avg(ln(per_line)) AS aspect_m, stddev_samp(ln(per_line)) AS aspect_s
  FROM samples WHERE quality = 1 GROUP BY lang),
hit AS (SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
decided AS (
  SELECT s.doc_id, s.lang, s.source,
         list_filter([
           CASE WHEN hit.doc_id IS NOT NULL THEN 'BLOCKLISTED' END,
           CASE WHEN area_m IS NULL THEN 'NO_REFERENCE' END,
           CASE WHEN abs((ln(n_chars) - area_m) / area_s) > 2.5 OR n_chars < p05 OR n_chars > p95 THEN 'AREA_OUT_OF_RANGE' END,
           CASE WHEN abs((ln(per_line) - aspect_m) / aspect_s) > 2.5 THEN 'ASPECT_OUT_OF_RANGE' END,
           CASE WHEN row_number() OVER (PARTITION BY sha ORDER BY s.doc_id) > 1 THEN 'EXACT_DUPLICATE' END], lambda x: x IS NOT NULL) AS reasons
  FROM samples s LEFT JOIN ref ON s.lang IS NOT DISTINCT FROM ref.lang LEFT JOIN hit ON s.doc_id = hit.doc_id)
"""


@query(
    DECIDED
    + """SELECT lang, count(*) AS total,
  count(*) FILTER (NOT list_has_any(reasons, ['BLOCKLISTED'])) AS after_blocklist,
  count(*) FILTER (NOT list_has_any(reasons, ['BLOCKLISTED', 'NO_REFERENCE', 'AREA_OUT_OF_RANGE'])) AS after_area,
  count(*) FILTER (NOT list_has_any(reasons, ['BLOCKLISTED', 'NO_REFERENCE', 'AREA_OUT_OF_RANGE', 'ASPECT_OUT_OF_RANGE'])) AS after_aspect,
  count(*) FILTER (len(reasons) = 0) AS after_duplicate,
  count(*) FILTER (len(reasons) = 0) AS accepted
FROM decided GROUP BY lang"""
)
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.funnel(decided(spark, sf_dir), STAGES, ["lang"])


@query(DECIDED + "SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM decided")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("doc_id", F.array_join("reject_reasons", ",").alias("reasons"), "passed")


@query(
    DECIDED
    + """, e AS (SELECT source, unnest(reasons) AS reason, generate_subscripts(reasons, 1) AS i FROM decided)
SELECT source, reason, count(*) AS triggers, count(*) FILTER (i = 1) AS first_reason FROM e GROUP BY ALL"""
)
def reject_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.reason_counts(decided(spark, sf_dir), ["source"])


@query(DECIDED + "SELECT source, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) > 0) AS rejected FROM decided GROUP BY source")
def filter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).groupBy("source").agg(F.count_if("passed").alias("accepted"), F.count_if(~F.col("passed")).alias("rejected"))


@query(
    f"""WITH {SAMPLES} SELECT lang, round(avg(ln(n_chars)), 6) AS area_mean_log, round(stddev_samp(ln(n_chars)), 6) AS area_std_log,
  round(quantile_cont(CAST(n_chars AS DOUBLE), 0.05), 6) AS area_p05, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 6) AS area_p95
FROM samples WHERE quality = 1 GROUP BY lang"""
)
def log_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = rules.log_reference(samples(spark, sf_dir).filter("quality = 1"), "lang", area="n_chars")
    return fitted.select("lang", *[F.round(c, 6).alias(c) for c in fitted.columns[1:]])


@query(
    """SELECT lang, min(n_chars) AS least, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.05), 6) AS p05, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 6) AS median,
  round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 6) AS p95, max(n_chars) AS most FROM documents GROUP BY lang"""
)
def linear_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), {"p05": 0.05, "median": 0.5, "p95": 0.95}
    ends = docs.groupBy("lang").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    rows = with_quantiles(ends, docs, by=["lang"], values={"": F.col("n_chars")}, at=at)
    return rows.select("lang", "least", *[F.round(n, 6).alias(n) for n in at], "most")


@query(
    """WITH o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, max(CASE WHEN i = CAST(floor(0.05 * (n - 1)) AS BIGINT) + 1 THEN n_chars END) AS p05, max(CASE WHEN i = CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1 THEN n_chars END) AS median
FROM o GROUP BY source"""
)
def lower_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower-index quantile from counts by value, so a group's values are never gathered into one array."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("source")))
    at = [F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("all") - 1)), F.col("n_chars"))).alias(n) for n, q in (("p05", 0.05), ("median", 0.5))]
    return rows.groupBy("source").agg(*at)


@query("SELECT DISTINCT d.doc_id, d.lang FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark").select("text")
    return lineage.with_containment(table(spark, sf_dir, "documents"), "text", passages).filter("contains_passage").select("doc_id", "lang")


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


@query(
    _LINES
    + """ SELECT doc_id, line, kind FROM (
  SELECT doc_id, line, 'email' AS kind FROM l WHERE regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')
  UNION ALL SELECT doc_id, line, 'license' FROM l WHERE regexp_matches(t, '(?i)license'))"""
)
def personal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_lines(table(spark, sf_dir, "documents"), key="doc_id", text="text", patterns=scan.PERSONAL).withColumn("line", F.col("line").cast("long"))


@query(
    _LINES
    + """ SELECT doc_id, line, kind FROM (
  SELECT doc_id, line, 'private_key' AS kind FROM l WHERE regexp_matches(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----')
  UNION ALL SELECT doc_id, line, 'github_token' FROM l WHERE regexp_matches(t, 'gh[oprsu]_[A-Za-z0-9]{20,}')
  UNION ALL SELECT doc_id, line, 'huggingface_token' FROM l WHERE regexp_matches(t, 'hf_[A-Za-z0-9]{20,}')
  UNION ALL SELECT doc_id, line, 'openai_key' FROM l WHERE regexp_matches(t, 'sk-[A-Za-z0-9_-]{20,}')
  UNION ALL SELECT doc_id, line, 'google_api_key' FROM l WHERE regexp_matches(t, 'AIza[0-9A-Za-z_-]{20,}')
  UNION ALL SELECT doc_id, line, 'aws_key' FROM l WHERE regexp_matches(t, 'AKIA[0-9A-Z]{16}')
  UNION ALL SELECT doc_id, line, 'windows_user_path' FROM l WHERE regexp_matches(t, '(?i)[A-Z]:[\\\\/]+Users[\\\\/]+[^<%\\\\/][^\\\\/]*[\\\\/]'))"""
)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_lines(table(spark, sf_dir, "documents"), key="doc_id", text="text", patterns=scan.SECRETS).withColumn("line", F.col("line").cast("long"))


@query(
    """SELECT 'denied' AS rule, url AS entry FROM pages WHERE starts_with(url, 'http://') AND NOT contains(url, 'page=')
UNION ALL SELECT 'missing', e FROM (SELECT unnest(['http://', 'ftp://', 'https://example.com/']) AS e) WHERE NOT EXISTS (SELECT 1 FROM pages WHERE starts_with(url, e))"""
)
def path_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url")
    plain = scan.path_audit(pages.filter(~F.contains("url", F.lit("page="))), path="url", required=[], denied=["http://"])
    needed = scan.path_audit(pages, path="url", required=["http://", "ftp://", "https://example.com/"], denied=[])
    return plain.unionByName(needed)
