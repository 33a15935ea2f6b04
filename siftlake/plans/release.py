"""What is written and read back, and the composed checks of a release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.cluster import scratch
from siftlake.operators import expect, lineage, replicate
from siftlake.plans.common import RUNS, runs
from siftlake.plans.filtering import DECIDED, decided
from siftlake.plans.registry import query
from siftlake.sources import readers, sinks
from siftlake.sources.readers import table


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns written as CSV and read back under a declared schema."""
    path, columns = scratch(spark, "csv"), ["doc_id", "lang", "source", "n_chars"]
    sinks.write_csv(table(spark, sf_dir, "documents"), path, columns)
    return readers.read_csv(spark, path, "doc_id bigint, lang string, source string, n_chars bigint")


@query("SELECT doc_id, lang, sha256(text) AS sha FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts written as JSON lines and read back with exactly these fields and no repeated key."""
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    rows = readers.read_jsonl(spark, path, "doc_id bigint, lang string, text string", key="doc_id")
    return rows.select("doc_id", "lang", F.sha2("text", 256).alias("sha"))


@query(
    DECIDED
    + "SELECT 'unfiltered' AS view, lang, count(*) AS n FROM decided GROUP BY lang UNION ALL SELECT 'filtered', lang, count(*) FROM decided WHERE len(reasons) = 0 GROUP BY lang"
)
def published_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions published once; the filtered view reads only the accepted part."""
    folder = scratch(spark, "views")
    sinks.publish_views(decided(spark, sf_dir).select("doc_id", "lang", "passed"), folder)
    views = [sinks.read_view(spark, folder, v).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("view"), "lang", "n") for v in ("unfiltered", "filtered")]
    return views[0].unionByName(views[1])


@query(
    DECIDED
    + """, t AS (SELECT lang, count(*) AS total, count(*) FILTER (len(reasons) = 0) AS accepted FROM decided GROUP BY lang),
r AS (SELECT lang, total + CASE WHEN lang = (SELECT min(lang) FROM t) THEN 1 ELSE 0 END AS total, accepted FROM t WHERE lang <> (SELECT max(lang) FROM t) UNION ALL SELECT 'none', 1, 1)
SELECT coalesce(t.lang, r.lang) AS lang, CASE WHEN r.lang IS NULL THEN 'extra' WHEN t.lang IS NULL THEN 'missing' ELSE 'both' END AS status, t.total, t.accepted,
  coalesce(r.total = t.total AND r.accepted = t.accepted, FALSE) AS equal FROM t FULL JOIN r ON t.lang = r.lang"""
)
def report_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's totals against a recount of the decisions; ``status`` tells of groups that only the recount or the report has.

    The report has three faults: the first language's total is one too many, the last one is left out, and ``none`` is no language.
    """
    folder, report = scratch(spark, "decisions"), scratch(spark, "report")
    sinks.publish_views(decided(spark, sf_dir).select("doc_id", "lang", "passed"), folder)
    recounted = sinks.read_view(spark, folder, "unfiltered").groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("accepted"))
    ends = recounted.agg(F.min("lang").alias("low"), F.max("lang").alias("high"))
    wrong = (F.col("total") + F.when(F.col("lang") == F.col("low"), 1).otherwise(0)).alias("total")
    faulty = recounted.crossJoin(F.broadcast(ends)).filter("lang <> high").select("lang", wrong, "accepted")  # one row of ends
    sinks.freeze(faulty.unionByName(spark.createDataFrame([("none", 1, 1)], "lang string, total long, accepted long")), report)
    met = replicate.reconcile(spark.read.parquet(report), recounted, keys=["lang"], metrics=["total", "accepted"])
    equal = (F.col("status") == "both") & (F.col("total_diff") == 0) & (F.col("accepted_diff") == 0)
    return met.join(recounted, "lang", "left").select("lang", "status", "total", "accepted", F.coalesce(equal, F.lit(False)).alias("equal"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ledger_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger appended to twice without a repeated key, and what a plan still lacks after it."""
    path = scratch(spark, "ledger")
    signed = lambda df: df.select("doc_id", F.sha2(F.concat(F.lit("label:"), F.col("doc_id").cast("string")), 256).alias("signature"))
    labels = table(spark, sf_dir, "labels")
    for part in (labels.filter("toxic = 1"), labels.filter("toxic <> 1 OR toxic IS NULL")):
        sinks.append_unique(signed(part), path, "doc_id")
    return sinks.pending(signed(table(spark, sf_dir, "documents")), sinks.read_ledger(spark, path), "doc_id").select("doc_id")


@query(
    """WITH m AS (SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents),
c AS (SELECT 'ids_unique' AS name, count(*) = count(DISTINCT doc_id) AS ok FROM m
      UNION ALL SELECT 'hashes_complete', count(*) = count(sha) FROM m
      UNION ALL SELECT 'splits_disjoint', count(*) = 0 FROM (SELECT sha FROM m GROUP BY sha HAVING count(DISTINCT split) > 1)
      UNION ALL SELECT 'both_splits', count(DISTINCT split) = 2 FROM m
      UNION ALL SELECT 'labels_in_manifest', count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM m))
SELECT name, ok, name = 'splits_disjoint' AS waived, (SELECT bool_and(ok OR name = 'splits_disjoint') FROM c) AS passed FROM c"""
)
def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's contract: keys, hashes, no content in two splits, both splits there, and every label's document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    manifest = docs.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    none = lambda name, rows: rows.agg(F.lit(name).alias("name"), (F.count(F.lit(1)) == 0).alias("ok"))
    checks = none("ids_unique", expect.duplicates(manifest, "doc_id")).unionByName(none("hashes_complete", manifest.filter("sha IS NULL")))
    checks = checks.unionByName(none("splits_disjoint", expect.crossing(manifest, "sha", "split")))
    wanted = spark.createDataFrame([("test",), ("train",)], "split string")
    checks = checks.unionByName(none("both_splits", expect.set_difference_report(manifest.select("split"), wanted, "split")))
    checks = checks.unionByName(none("labels_in_manifest", expect.missing(table(spark, sf_dir, "labels"), manifest, "doc_id")))
    return expect.named_checks(checks, spark.createDataFrame([("splits_disjoint",)], "name string"))


@query(
    f"""WITH {RUNS}, p AS (SELECT DISTINCT g.grp, s.seed FROM runs g CROSS JOIN (SELECT DISTINCT seed FROM runs) s),
b AS (SELECT grp, seed, list_filter([CASE WHEN count(r.m1) = 0 THEN 'missing' END, CASE WHEN bool_or(r.m1 < 0 OR r.m1 > 1 OR r.m2 < 0 OR r.m2 > 1) THEN 'range' END,
  CASE WHEN grp <> 'N' AND count(r.m1) > 1 THEN 'objects' END], lambda x: x IS NOT NULL) AS broken
  FROM p LEFT JOIN runs r USING (grp, seed) GROUP BY grp, seed)
SELECT grp, count(*) AS planned, count(*) FILTER (len(broken) = 0) AS valid, count(*) FILTER (len(broken) = 0) = count(*) AS ok FROM b GROUP BY grp"""
)
def group_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group has a run for every seed, metrics in range and, but for the baseline, one object."""
    ledger = runs(spark, sf_dir)
    plan = ledger.select("grp").distinct().crossJoin(F.broadcast(ledger.select("seed").distinct()))  # few groups and seeds
    found = ledger.groupBy("grp", "seed").agg(
        F.count("m1").alias("n"), F.every(F.col("m1").between(0, 1) & F.col("m2").between(0, 1)).alias("in_range")
    )
    rows = plan.join(found, ["grp", "seed"], "left")
    one = (F.col("grp") == "N") | (F.coalesce("n", F.lit(0)) <= 1)
    broken = expect.breaking(rows, missing=F.coalesce("n", F.lit(0)) > 0, range=F.coalesce("in_range", F.lit(True)), objects=one)
    counts = broken.groupBy("grp").agg(F.count(F.lit(1)).alias("n_broken"))
    totals = plan.groupBy("grp").agg(F.count(F.lit(1)).alias("planned")).join(counts, "grp", "left")
    valid = F.col("planned") - F.coalesce("n_broken", F.lit(0))
    return totals.select("grp", "planned", valid.alias("valid"), (valid == F.col("planned")).alias("ok"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND n_chars >= 1000")
def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions whose parameter is not given do not filter."""
    rows = lineage.where_given(table(spark, sf_dir, "documents"), {"lang": "en", "source": None}, {"n_chars": 1000, "doc_id": None})
    return rows.select("doc_id", "source")


@query(
    """WITH a AS (SELECT DISTINCT lang FROM documents), b AS (SELECT DISTINCT d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)
SELECT (SELECT count(*) FROM b WHERE lang NOT IN (SELECT lang FROM a)) = 0 AS subset,
       (SELECT count(*) FROM b WHERE lang NOT IN (SELECT lang FROM a)) = 0 AND (SELECT count(*) FROM a WHERE lang NOT IN (SELECT lang FROM b)) > 0 AS strict"""
)
def subset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the languages with toxic documents are a subset of all, and a strict one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    toxic = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")
    return expect.subset_report(toxic, docs, "lang")
