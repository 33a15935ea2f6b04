"""Replicated runs, gates and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import expect, metrics, replicate
from siftlake.plans.common import RUNS, SCORED, runs, scored
from siftlake.plans.registry import query
from siftlake.sources.readers import table


@query(f"WITH {RUNS} SELECT grp, object, count(*) AS n, round(avg(m1), 6) AS mean, round(stddev_samp(m1), 6) AS std FROM runs GROUP BY ALL HAVING count(*) >= 2")
def seed_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replicate.mean_std(runs(spark, sf_dir), by=["grp", "object"], metric="m1")
    return rows.select("grp", "object", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    f"""WITH {RUNS}, s AS (SELECT grp, seed, avg(m1) AS macro FROM runs GROUP BY ALL)
SELECT grp, count(*) AS n_seeds, round(avg(macro), 6) AS mean, round(stddev_samp(macro), 6) AS std FROM s GROUP BY grp"""
)
def macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replicate.macro_mean(runs(spark, sf_dir), group="grp", seed="seed", metric="m1")
    return rows.select("grp", "n_seeds", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    f"""WITH {SCORED} SELECT lang, count(*) AS n, round(CASE WHEN stddev_pop(n_chars) = 0 OR stddev_pop(score) = 0 THEN NULL ELSE corr(n_chars, score) END, 6) AS r FROM scored GROUP BY lang"""
)
def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.pearson(scored(spark, sf_dir), "n_chars", "score", ["lang"]).withColumn("r", F.round("r", 6))


@query(
    f"""WITH {RUNS}, g AS (SELECT grp, object, avg(m1) AS m1, avg(m2) AS m2 FROM runs GROUP BY ALL),
p AS (SELECT a.grp, a.m1, a.m2, a.m1 - b.m1 AS d1, a.m2 - b.m2 AS d2 FROM g a JOIN g b ON a.grp <> 'N' AND b.grp = 'N' AND a.object = b.object),
e AS (SELECT grp, avg(m1) AS mean_m1, avg(m2) AS mean_m2, avg(d1) AS mean_gain, bool_and(d1 >= -0.01 AND d2 >= -0.01) AS non_inferior FROM p GROUP BY grp)
SELECT grp, round(mean_gain, 6) AS mean_gain, non_inferior, non_inferior AND mean_gain >= 0 AS passed FROM e ORDER BY mean_m1 DESC, mean_m2 DESC, grp DESC LIMIT 1"""
)
def gate_noninferior(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = runs(spark, sf_dir).groupBy("grp", "object").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2"))
    gate = replicate.non_inferiority(means, group="grp", baseline="N", object_="object", m1="m1", m2="m2", tolerance=0.01, gain=0.0)
    return gate.select("grp", F.round("mean_gain", 6).alias("mean_gain"), "non_inferior", "passed")


@query(
    f"""WITH {RUNS}, d AS (SELECT a.grp, a.object, a.seed, a.m1 - b.m1 AS d FROM runs a JOIN runs b ON b.grp = 'N' AND a.grp <> 'N' AND a.object = b.object AND a.seed = b.seed)
SELECT x.object, count(*) AS n_seeds, count(*) FILTER (sign(x.d) * sign(y.d) = -1) AS n_opposite, count(*) FILTER (sign(x.d) * sign(y.d) = -1) >= 2 AS conflict
FROM d x JOIN d y ON x.grp = 'A' AND y.grp = 'R' AND x.object = y.object AND x.seed = y.seed GROUP BY x.object"""
)
def sign_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replicate.deltas(runs(spark, sf_dir), group="grp", baseline="N", keys=["object", "seed"], metric="m1")
    return replicate.sign_conflicts(rows.filter("grp = 'A'"), rows.filter("grp = 'R'"), object_="object", seed="seed", delta="delta")


@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_discount = 0) AS n_zero, count(*) FILTER (l_discount = 0) >= 40 AS collapse FROM lineitem GROUP BY l_suppkey")
def collapse_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.collapsed(table(spark, sf_dir, "lineitem"), by=["l_suppkey"], metric="l_discount", least=40)


@query(
    f"""WITH {RUNS}, w AS (SELECT object, seed, max(m1) FILTER (grp = 'N') AS b, max(m1) FILTER (grp = 'A') AS r, max(m1) FILTER (grp = 'R') AS g FROM runs WHERE grp = 'N' OR object = 'F' GROUP BY ALL),
a AS (SELECT seed, avg(b) AS b, max(r) AS r, max(g) AS g FROM w GROUP BY seed),
t AS (SELECT seed, b, r, g, CASE WHEN abs((b - r) - (r - g)) <= greatest(1e-12::DOUBLE, 1e-9::DOUBLE * greatest(abs(b - r), abs(r - g))) THEN 'tie' WHEN b - r > r - g THEN 'placement' ELSE 'appearance' END AS attribution FROM a)
SELECT seed, attribution, NOT (b = r AND r = g) AS discriminates,
  CASE WHEN (SELECT bool_and(attribution = 'placement') FROM t) THEN 'placement_dominates' WHEN (SELECT bool_and(attribution = 'appearance') FROM t) THEN 'appearance_dominates' ELSE 'object_dependent' END AS overall,
  round((SELECT avg(b - r) FROM t), 6) AS placement_mean, round((SELECT avg(r - g) FROM t), 6) AS appearance_mean FROM t"""
)
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = runs(spark, sf_dir).filter("grp = 'N' OR object = 'F'")
    pivot = [F.max(F.when(F.col("grp") == g, F.col("m1"))).alias(n) for g, n in (("N", "b"), ("A", "r"), ("R", "g"))]
    wide = ledger.groupBy("object", "seed").agg(*pivot).groupBy("seed").agg(F.avg("b").alias("b"), F.max("r").alias("r"), F.max("g").alias("g"))
    rows = replicate.attribution(wide, object_="seed", baseline="b", real="r", generated="g")
    means = [F.round(c, 6).alias(c) for c in ("placement_mean", "appearance_mean")]
    return rows.select("seed", "attribution", "discriminates", "overall", *means)


@query(
    f"""WITH {RUNS}, w AS (SELECT seed, max(m1) FILTER (grp = 'N' AND object = 'F') AS base, max(m1) FILTER (grp = 'R' AND object = 'F') AS current, max(m1) FILTER (grp = 'A' AND object = 'F') AS inband,
  max(m1) FILTER (grp = 'N' AND object = 'O') AS control FROM runs GROUP BY seed)
SELECT seed, round(inband - current, 6) AS effect, CASE WHEN base = current AND current = inband THEN 'uninformative' WHEN inband - current >= 0.0002 THEN 'helps' WHEN inband - current <= -0.0002 THEN 'harms' ELSE 'no_effect' END AS verdict,
  abs(control - base) >= 0.0005 AS control_anomalous FROM w"""
)
def verdict_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By seed the verdict on the primary object, if its scores differ at all, and whether the control object moved too."""
    m1, grp, object_ = F.col("m1"), F.col("grp"), F.col("object")
    cell = lambda g, o: F.max(F.when((grp == g) & (object_ == o), m1))
    rows = runs(spark, sf_dir).groupBy("seed").agg(
        cell("N", "F").alias("base"), cell("R", "F").alias("current"), cell("A", "F").alias("inband"), cell("N", "O").alias("control")
    )
    effect = F.col("inband") - F.col("current")
    informative = replicate.discriminates(F.col("base"), F.col("current"), F.col("inband"))
    moved = F.abs(F.col("control") - F.col("base")) >= 0.0005
    return rows.select("seed", F.round(effect, 6).alias("effect"), replicate.verdict(effect, 0.0002, informative).alias("verdict"), moved.alias("control_anomalous"))


@query(
    f"""WITH {RUNS}, d AS (SELECT a.object, a.seed, a.n >= 100 AS ok, a.m1 - b.m1 AS e FROM runs a JOIN runs b ON a.grp = 'A' AND b.grp = 'R' AND a.object = b.object AND a.seed = b.seed),
s AS (SELECT object, avg(e) FILTER (seed <> 1 AND ok) AS effect, count(*) FILTER (seed <> 1 AND ok) AS n_blind, avg(e) FILTER (seed = 1) AS disclosed_effect FROM d GROUP BY object)
SELECT object, round(effect, 6) AS effect, n_blind, round(disclosed_effect, 6) AS disclosed_effect,
  CASE WHEN n_blind = 0 THEN 'uninformative' WHEN effect >= 0.0002 THEN 'helps' WHEN effect <= -0.0002 THEN 'harms' ELSE 'no_effect' END AS verdict FROM s"""
)
def confirmed_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = runs(spark, sf_dir).filter("grp IN ('A', 'R')")
    rows = replicate.deltas(ledger, group="grp", baseline="R", keys=["object", "seed"], metric="m1").withColumn("ok", F.col("n") >= 100)
    out = replicate.confirmed_effect(rows, by="object", seed="seed", effect="delta", informative="ok", disclosed=[1], threshold=0.0002)
    return out.select("object", F.round("effect", 6).alias("effect"), "n_blind", F.round("disclosed_effect", 6).alias("disclosed_effect"), "verdict")


@query(
    """WITH k AS (SELECT user_id, value, event_type = 'purchase' AS inside,
  rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS r FROM events),
d AS (SELECT user_id, max(value) AS top, max(value) FILTER (inside) AS inside, max(value) FILTER (NOT inside) AS outside, count(*) FILTER (value >= 60 AND inside) AS hit,
  CASE WHEN count(*) FILTER (inside) > 0 AND count(*) FILTER (NOT inside) > 0 THEN
    (sum(r) FILTER (inside) - count(*) FILTER (inside) * (count(*) FILTER (inside) + 1) / 2.0::DOUBLE) / (CAST(count(*) FILTER (inside) AS DOUBLE) * count(*) FILTER (NOT inside)) END AS auroc
  FROM k GROUP BY user_id)
SELECT user_id, CASE WHEN top IS NULL THEN 'no_pixels' WHEN hit > 0 THEN 'non_zero_overlap' WHEN top >= 60 THEN 'positive_pixels_never_overlap' WHEN d.inside > outside THEN 'underconfident_peak_inside'
  WHEN auroc >= 0.8 THEN 'underconfident_peak_outside_ranking_informative' ELSE 'underconfident_peak_outside_ranking_near_random' END AS diagnosis FROM d"""
)
def zero_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought, v = F.col("event_type") == "purchase", F.col("value")
    events = table(spark, sf_dir, "events")
    rows = events.groupBy("user_id").agg(
        F.count_if((v >= 60) & bought).alias("overlap"), F.max(v).alias("top"), F.max(F.when(bought, v)).alias("inside"), F.max(F.when(~bought, v)).alias("outside")
    )
    ranks = metrics.auroc(events.withColumn("bought", bought.cast("int")), by=["user_id"], label="bought", score="value")
    columns = [F.col(c) for c in ("overlap", "top", "inside", "outside", "auroc")]
    return rows.join(ranks, "user_id").select("user_id", replicate.zero_diagnosis(*columns, threshold=60).alias("diagnosis"))


@query(
    """WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS place, max(value) OVER w AS best,
  coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS rises FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, place - max(CASE WHEN rises THEN place END) OVER w AS stale FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, best, stale, max(CASE WHEN stale >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM s"""
)
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replicate.best_so_far(table(spark, sf_dir, "events"), by=["user_id"], step="event_id", score="value", patience=5)
    return rows.select("user_id", "event_id", "best", F.col("stale").cast("long").alias("stale"), "stopped")


@query(
    """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
w AS (SELECT user_id, floor((step - 1) / 4) AS w, avg(value) AS m FROM e GROUP BY ALL HAVING count(*) = 4)
SELECT user_id, count(*) AS n_windows, round(arg_min(m, w), 6) AS first_mean, round(arg_max(m, w), 6) AS last_mean FROM w GROUP BY user_id"""
)
def window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.sources.readers import numbered

    rows = numbered(table(spark, sf_dir, "events"), by="user_id", order="event_id").withColumn("step", F.col("ordinal") + 1)
    out = replicate.window_means(rows, by=["user_id"], step="step", value="value", width=4)
    return out.select("user_id", "n_windows", F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean"))


@query(
    """WITH c AS (SELECT 'unique_ids' AS name, count(*) = count(DISTINCT doc_id) AS ok FROM documents UNION ALL SELECT 'unique_texts', count(*) = count(DISTINCT text) FROM documents
  UNION ALL SELECT 'labels_known', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0)
SELECT name, ok, name = 'unique_texts' AS waived, (SELECT bool_and(ok OR name = 'unique_texts') FROM c) AS passed FROM c"""
)
def named_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    keys = docs.select("doc_id", F.sha2("text", 256).alias("sha"))  # texts are not shuffled
    unique = keys.agg((F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("unique_ids"), (F.count(F.lit(1)) == F.count_distinct("sha")).alias("unique_texts"))
    unique = unique.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("ok")) for c in unique.columns])))
    known = expect.missing(labels, docs, "doc_id").agg(F.lit("labels_known").alias("name"), (F.count(F.lit(1)) == 0).alias("ok"))
    return expect.named_checks(unique.unionByName(known), spark.createDataFrame([("unique_texts",)], "name string"))
