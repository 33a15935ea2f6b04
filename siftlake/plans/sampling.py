"""Sampling, quotas and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions.scalars import derived_seed
from siftlake.operators import replicate, sampling
from siftlake.operators.ordering import range_bucket, with_place
from siftlake.operators.quantiles import group_quantiles
from siftlake.plans.common import SCORED, scored
from siftlake.plans.registry import query
from siftlake.sources.readers import table

SEED = 42
_ORDER = f"sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id"


@query(f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS i FROM documents) WHERE i <= 10")
def hash_sample_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.k_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), by=["lang"], key="doc_id", k=10, seed=SEED)


@query(
    f"""WITH p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT lang, doc_id, 'fewshot' AS role FROM p WHERE i <= 10),
r AS (SELECT lang, doc_id, n, row_number() OVER (PARTITION BY lang ORDER BY sha256('validation:' || CAST(doc_id AS VARCHAR)), doc_id) AS i FROM p WHERE i > 20)
SELECT * FROM s UNION ALL SELECT lang, doc_id, 'validation' FROM r WHERE i <= greatest(1, n // 10)"""
)
def fewshot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten few-shot rows from a pool of twenty a language, and a validation tenth of the language from outside the pool."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    pool = sampling.k_sample(docs, by=["lang"], key="doc_id", k=20, seed=SEED)
    few = sampling.k_sample(pool, by=["lang"], key="doc_id", k=10, seed=SEED).withColumn("role", F.lit("fewshot"))
    rest = docs.join(pool, ["lang", "doc_id"], "left_anti").join(sizes, "lang")
    share = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    validation = sampling.k_sample(rest, by=["lang"], key="doc_id", k=share, seed="validation").withColumn("role", F.lit("validation"))
    return few.unionByName(validation.drop("n"))


_QUOTA = """s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
q AS (SELECT lang, n, 150 * n / CAST(sum(n) OVER () AS DOUBLE) AS exact FROM s),
f AS (SELECT lang, n, least(CAST(floor(exact) AS BIGINT), n) AS base, round(exact - floor(exact), 9) AS fraction FROM q),
quota AS (SELECT lang, n, base + CASE WHEN row_number() OVER (ORDER BY fraction DESC, lang) <= 150 - CAST(sum(base) OVER () AS BIGINT) THEN 1 ELSE 0 END AS quota FROM f)"""


@query(f"WITH {_QUOTA} SELECT lang, n, quota FROM quota")
def quota_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(sizes, total=150, key="lang", size="n")


@query(
    f"""WITH {_QUOTA}, r AS (SELECT d.lang, doc_id, quota, row_number() OVER (PARTITION BY d.lang ORDER BY {_ORDER}) AS i FROM documents d JOIN quota ON d.lang = quota.lang)
SELECT lang, doc_id FROM r WHERE i <= quota"""
)
def stratified_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return sampling.stratified(docs, strata=["lang"], key="doc_id", count=150, seed=SEED).select("lang", "doc_id")


def _type_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


#: Unit by unit, as the rule is told; the query has no such loop.
_FLOOR = """s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
h AS (SELECT lang, source, n, 200 * n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) AS share FROM s),
f AS (
  SELECT lang, source, n, share, greatest(CAST(floor(share) AS BIGINT), 5) AS quota, CAST(0 AS BIGINT) AS moved FROM h
  UNION ALL
  SELECT lang, source, n, share, quota + CASE WHEN lacking > 0 AND first_to_get = 1 THEN 1 WHEN lacking < 0 AND first_to_give = 1 THEN -1 ELSE 0 END, moved + 1
  FROM (SELECT *, 200 - sum(quota) OVER (PARTITION BY lang) AS lacking,
               row_number() OVER (PARTITION BY lang ORDER BY share - quota DESC, n DESC, source) AS first_to_get,
               row_number() OVER (PARTITION BY lang ORDER BY quota > 5 DESC, quota - share DESC, n, source) AS first_to_give FROM f)
  WHERE lacking <> 0),
floors AS (SELECT lang, source, quota FROM f QUALIFY moved = max(moved) OVER (PARTITION BY lang))"""


@query(f"WITH RECURSIVE {_FLOOR} SELECT lang, source, CAST(quota AS BIGINT) AS quota FROM floors")
def quota_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quotas_with_floor(_type_sizes(spark, sf_dir), by="lang", key="source", size="n", total=200, minimum=5)


@query(
    f"""WITH RECURSIVE {_FLOOR},
t AS (
  SELECT lang, source, quota, sum(quota) OVER (PARTITION BY lang) AS total, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS taken, FALSE AS chosen FROM floors
  UNION ALL
  SELECT lang, source, quota, total, step + 1, taken + CASE WHEN turn = 1 THEN 1 ELSE 0 END, turn = 1
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY taken < quota DESC, (step + 1) * quota / CAST(total AS DOUBLE) - taken DESC, quota DESC, source) AS turn
        FROM t WHERE step < total))
SELECT lang, step - 1 AS step, source FROM t WHERE chosen"""
)
def weighted_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted_schedule(quota_with_floor(spark, sf_dir), by="lang", key="source", quota="quota")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), kind="source", key="doc_id", limit=50).drop("turn")


@query(
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) - 1 AS last FROM documents)
SELECT DISTINCT lang, doc_id FROM r, range(8) t(i) WHERE place = CAST(floor(i * last / 7.0::DOUBLE) AS BIGINT)"""
)
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.evenly_spaced(table(spark, sf_dir, "documents").select("lang", "doc_id"), by=["lang"], order="doc_id", k=8)


@query(
    """WITH k AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents))
SELECT lang, unnest(range(30 // n + CASE WHEN i < 30 % n THEN 1 ELSE 0 END)) AS slot FROM k"""
)
def even_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "documents").select("lang").distinct()
    rows = kinds.withColumn("i", F.row_number().over(Window.orderBy("lang")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    quota = F.floor(F.lit(30) / F.col("n")) + (F.col("i") < F.lit(30) % F.col("n")).cast("long")
    return rows.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), quota - 1)).alias("slot"))


@query(
    f"""SELECT doc_id, e AS epoch, row_number() OVER (PARTITION BY e ORDER BY sha256(concat_ws(':', '{SEED}', CAST(e AS VARCHAR), CAST(doc_id AS VARCHAR)))) - 1 AS place
FROM (SELECT doc_id FROM labels) CROSS JOIN (SELECT CAST(unnest(range(3)) AS INTEGER) AS e)"""
)
def epoch_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.epoch_permutation(table(spark, sf_dir, "labels"), key="doc_id", epochs=3, seed=SEED)
    return rows.withColumn("place", F.col("place").cast("long"))


@query(
    f"""SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', '{SEED}', '0', CAST(doc_id AS VARCHAR)))) - 1 AS place FROM labels) WHERE place >= 100"""
)
def resumed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing order taken up again at its hundredth draw."""
    rows = sampling.epoch_permutation(table(spark, sf_dir, "labels"), key="doc_id", epochs=1, seed=SEED)
    return rows.filter("place >= 100").select("doc_id", F.col("place").cast("long").alias("place"))


@query(
    f"""WITH b AS (SELECT lang, quantile_cont(CAST(n_chars AS DOUBLE), 0.4) AS low, quantile_cont(CAST(n_chars AS DOUBLE), 0.6) AS high FROM documents GROUP BY lang),
i AS (SELECT d.lang, doc_id FROM documents d JOIN b ON d.lang = b.lang AND n_chars BETWEEN low AND high),
m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM i GROUP BY lang)),
a AS (SELECT 'current' AS arm, lang, doc_id FROM documents UNION ALL SELECT 'inband', lang, doc_id FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY arm, lang ORDER BY {_ORDER}) AS nth FROM a)
SELECT arm, lang, doc_id FROM r, m WHERE nth <= m.n"""
)
def matched_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    bands = group_quantiles(docs, by=["lang"], values={"": F.col("n_chars")}, at={"low": 0.4, "high": 0.6})
    return sampling.matched_arms(docs, bands, by="lang", key="doc_id", value="n_chars", seed=SEED).select("arm", "lang", "doc_id")


@query(f"WITH {SCORED} SELECT source, arg_min(doc_id, doc_id) FILTER (score = best) AS doc_id, max(best) AS score FROM (SELECT *, max(score) OVER (PARTITION BY source) AS best FROM scored) GROUP BY source")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the best: the highest score, ties to the smallest id."""
    best = F.max(F.struct("score", (-F.col("doc_id")).alias("minus"))).alias("b")
    return scored(spark, sf_dir).groupBy("source").agg(best).select("source", (-F.col("b.minus")).alias("doc_id"), F.col("b.score").alias("score"))


@query("SELECT doc_id, CAST('0x' || substr(sha256(concat_ws(chr(0), '42', lang, CAST(doc_id AS VARCHAR))), 1, 16) AS UHUGEINT)::VARCHAR AS seed FROM documents")
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", derived_seed(SEED, F.col("lang"), F.col("doc_id")).cast("string").alias("seed"))


@query("SELECT doc_id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY toxic), 9) AS weight FROM labels")
def class_balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    counts = labels.groupBy("toxic").agg(F.round(1.0 / F.count(F.lit(1)), 9).alias("weight"))
    return labels.join(counts, "toxic").select("doc_id", "weight")


_DOMAINS = """d AS (SELECT doc_id, CASE WHEN toxic = 0 THEN 'good' WHEN quality = 1 THEN 'real_bad' ELSE 'other_bad' END AS domain FROM labels),
domains AS (SELECT doc_id, domain, round(CASE domain WHEN 'good' THEN 0.5::DOUBLE WHEN 'real_bad' THEN 0.375::DOUBLE ELSE 0.125::DOUBLE END / count(*) OVER (PARTITION BY domain), 9) AS weight FROM d)"""


@query(f"WITH {_DOMAINS} SELECT doc_id, domain, weight FROM domains")
def domain_balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 0, "good").when(F.col("quality") == 1, "real_bad").otherwise("other_bad")
    shares = {"good": 0.5, "real_bad": 0.5 * 0.75, "other_bad": 0.5 * 0.25}
    rows = sampling.domain_weights(table(spark, sf_dir, "labels"), domain=domain, shares=shares)
    return rows.select("doc_id", "domain", F.round("weight", 9).alias("weight"))


_DRAWS = f"""{_DOMAINS},
c AS (SELECT doc_id, domain, sum(weight) OVER o / sum(weight) OVER () AS high, (sum(weight) OVER o - weight) / sum(weight) OVER () AS low
      FROM domains WINDOW o AS (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT range AS draw, CAST('0x' || substr(sha256('{SEED}:draw:' || CAST(range AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM range(2000)),
drawn AS (SELECT draw, doc_id, domain FROM n JOIN c ON u >= low AND u < high)"""


@query(f"WITH {_DRAWS} SELECT draw, doc_id FROM drawn")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain_balanced_weights(spark, sf_dir)
    return sampling.weighted_draws(rows, key="doc_id", weight="weight", draws=2000, seed=SEED)


@query(f'WITH {_DRAWS} SELECT domain, count(*) AS draws, count(DISTINCT doc_id) AS rows FROM drawn GROUP BY domain')
def exposure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each domain was drawn."""
    drawn = weighted_draws(spark, sf_dir).join(domain_balanced_weights(spark, sf_dir), "doc_id")
    return drawn.groupBy("domain").agg(F.count(F.lit(1)).alias("draws"), F.count_distinct("doc_id").alias("rows"))


@query(f"WITH {SCORED} SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, n_chars DESC, doc_id) AS i FROM scored) WHERE i = 1")
def argmax_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replicate.argmax(scored(spark, sf_dir), by=["lang", "source"], order=[F.desc("score"), F.desc("n_chars"), F.col("doc_id")])
    return rows.select("lang", "source", "doc_id")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i = n // 2 + 1")
def median_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row at place n // 2 of an order; only the length that holds the place is ranked row by row."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    counts = docs.groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("place", F.floor(F.sum("n").over(Window.partitionBy("lang")) / 2))
    held = rows.filter("upto > place AND upto - n <= place").select("lang", "n_chars", (F.col("place") - F.col("upto") + F.col("n")).alias("at"))
    ranked = docs.join(held, ["lang", "n_chars"]).withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1)
    return ranked.filter("i = at").select("lang", "doc_id")


@query("SELECT sha256(text) AS sha, dense_rank() OVER (ORDER BY min(doc_id)) - 1 AS number, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def group_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of copies numbered by first appearance."""
    groups = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = with_place(groups.filter("n > 1"), by=[], bucket=range_bucket(F.col("first")), order=[F.col("first")], name="number")
    return placed.select("sha", "number", "n")


@query(
    """WITH RECURSIVE g AS (
  SELECT strength, ratio, row_number() OVER (ORDER BY CASE WHEN strength = 0.6 AND ratio = 1.5 THEN 0 ELSE 1 END, sha256('42:' || CAST(CAST(strength * 10 AS INTEGER) AS VARCHAR) || ':' || CAST(CAST(ratio * 10 AS INTEGER) AS VARCHAR))) - 1 AS n
  FROM (SELECT unnest([0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS strength) CROSS JOIN (SELECT unnest([1.2::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]) AS ratio)),
k AS (
  SELECT n, strength, ratio, TRUE AS taken, [strength] AS xs, [ratio] AS ys FROM g WHERE n = 0
  UNION ALL
  SELECT g.n, g.strength, g.ratio, NOT (list_contains(xs, g.strength) OR list_contains(ys, g.ratio)),
         CASE WHEN list_contains(xs, g.strength) OR list_contains(ys, g.ratio) THEN xs ELSE list_append(xs, g.strength) END,
         CASE WHEN list_contains(xs, g.strength) OR list_contains(ys, g.ratio) THEN ys ELSE list_append(ys, g.ratio) END
  FROM k JOIN g ON g.n = k.n + 1),
f AS (SELECT *, NOT taken AND ((NOT strength IN (SELECT strength FROM k WHERE taken) AND n = min(n) OVER (PARTITION BY strength))
                               OR (NOT ratio IN (SELECT ratio FROM k WHERE taken) AND n = min(n) OVER (PARTITION BY ratio))) AS brings_one FROM k)
SELECT strength, ratio, row_number() OVER (ORDER BY CASE WHEN taken THEN 0 WHEN brings_one THEN 1 ELSE 2 END, n) - 1 AS place FROM f"""
)
def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small parameter grid: the baseline first, then pairs with new values, ties in seeded order."""
    grid = spark.createDataFrame([(s, r) for s in (0.4, 0.6, 0.8) for r in (1.2, 1.5, 2.0)], "strength double, ratio double")
    name = F.concat_ws(":", F.lit(str(SEED)), F.round(F.col("strength") * 10).cast("int").cast("string"), F.round(F.col("ratio") * 10).cast("int").cast("string"))
    order = Window.orderBy(((F.col("strength") != 0.6) | (F.col("ratio") != 1.5)).cast("int"), F.sha2(name, 256))
    return sampling.covering_order(grid.withColumn("n", F.row_number().over(order) - 1), axes=("strength", "ratio"), order="n").drop("n")
