"""Scans, filters, contracts, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions.scalars import content_hash, is_close
from siftlake.operators import expect, lineage, replicate
from siftlake.operators.quantiles import group_quantiles
from siftlake.plans.common import RUNS, SAMPLES, runs, samples
from siftlake.plans.registry import query
from siftlake.sources import sinks
from siftlake.sources.readers import numbered, table


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars > 2000 ORDER BY lang, doc_id")
def scan_filter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de") & (F.col("n_chars") > 2000))
    return rows.select("doc_id", "lang", "source", "n_chars").orderBy("lang", "doc_id")


@query(
    """SELECT doc_id, quality, toxic FROM labels WHERE (quality = 1 OR (toxic = 1 AND doc_id % 10 = 0))
  AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')"""
)
def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows, bad ones by policy, none of the development selection."""
    rows = table(spark, sf_dir, "labels").filter("quality = 1 OR (toxic = 1 AND doc_id % 10 = 0)")
    selection = table(spark, sf_dir, "documents").filter("source = 'src3'").select("doc_id")
    return rows.join(selection, "doc_id", "left_anti").select("doc_id", "quality", "toxic")


@query("SELECT doc_id % 4 AS partition, doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def partition_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select((F.col("doc_id") % 4).alias("partition"), "doc_id", "lang")


@query(
    """WITH b AS (SELECT lang, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS low, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS high FROM documents GROUP BY lang)
SELECT doc_id, d.lang, n_chars FROM documents d JOIN b ON d.lang = b.lang WHERE n_chars BETWEEN low AND high"""
)
def band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    bands = group_quantiles(docs, by=["lang"], values={"": F.col("n_chars")}, at={"low": 0.25, "high": 0.75})
    return docs.join(bands, "lang").filter(F.col("n_chars").between(F.col("low"), F.col("high"))).select("doc_id", "lang", "n_chars")


@query(
    """SELECT doc_id, coalesce(CASE WHEN doc_id % 7 = 0 THEN 'given_' || lang END, CASE WHEN source LIKE 'src1%' THEN 'first_' || source WHEN source = 'src2' THEN 'no_stats' ELSE source END) AS input_name
FROM documents"""
)
def derived_input_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("given_"), "lang"))
    derived = F.when(F.col("source").startswith("src1"), F.concat(F.lit("first_"), "source")).when(F.col("source") == "src2", "no_stats").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(given, derived).alias("input_name"))


@query(
    f"WITH {SAMPLES} SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality IS NULL) AS n_unlabelled FROM samples GROUP BY lang"
)
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {"n_toxic": F.col("toxic") == 1, "n_good": F.col("quality") == 1, "n_unlabelled": F.col("quality").isNull()}
    return samples(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])


@query("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expect.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha")), "sha")


@query("SELECT sha256(text) AS sha, count(DISTINCT source) AS n_values FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def crossing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expect.crossing(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), "source"), "sha", "source")


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 100 THEN 'length' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang' END,
  CASE WHEN n_chars <> length(text) THEN 'n_chars' END], lambda x: x IS NOT NULL), ',') AS broken
FROM documents WHERE n_chars < 100 OR lang NOT IN ('en', 'de', 'fr') OR n_chars <> length(text)"""
)
def schema_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"length": F.col("n_chars") >= 100, "lang": F.col("lang").isin("en", "de", "fr"), "n_chars": F.col("n_chars") == F.length("text")}
    return expect.breaking(table(spark, sf_dir, "documents"), **rules).select("doc_id", F.array_join("broken", ",").alias("broken"))


@query(
    f"""WITH {RUNS}, x AS (SELECT object, seed, max(m1) FILTER (grp = 'A') AS a, max(m1) FILTER (grp = 'R') AS r FROM runs GROUP BY ALL)
SELECT object, seed, abs(a - r) <= greatest(1e-12::DOUBLE, 1e-2::DOUBLE * greatest(abs(a), abs(r))) AS close FROM x"""
)
def scalar_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, r = (F.max(F.when(F.col("grp") == g, F.col("m1"))) for g in ("A", "R"))
    return runs(spark, sf_dir).groupBy("object", "seed").agg(a.alias("a"), r.alias("r")).select("object", "seed", is_close(F.col("a"), F.col("r"), 1e-2).alias("close"))


def _blocklist(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return rows.filter("doc_id % 10 <> 0"), rows.filter("doc_id % 10 = 0").select("sha")


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def blocklist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.blocked(*_blocklist(spark, sf_dir), "sha").select("doc_id", "sha")


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def blocklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.allowed(*_blocklist(spark, sf_dir), "sha").select("doc_id", "sha")


@query(
    """SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""
)
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers, each of which must be in its manifest; then by nation."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", content_hash(F.col("c_custkey")).alias("actual"))
    rows = table(spark, sf_dir, "orders").withColumn("expected", content_hash(F.col("o_custkey")))
    joined = lineage.provenance(rows, customers, key="o_custkey", manifest_key="c_custkey", expected="expected", actual="actual")
    named = joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size <= 10")
def exactly_one_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").filter("p_size <= 10").select("p_partkey")
    once = expect.exactly_one(table(spark, sf_dir, "part"), ["p_partkey"])
    return keys.join(once, "p_partkey").select("p_partkey", "p_brand", "p_retailprice")


@query(f"WITH {RUNS} SELECT a.grp, a.object, a.seed, round(a.m1 - b.m1, 6) AS delta FROM runs a JOIN runs b ON b.grp = 'N' AND a.grp <> 'N' AND a.object = b.object AND a.seed = b.seed")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replicate.deltas(runs(spark, sf_dir), group="grp", baseline="N", keys=["object", "seed"], metric="m1")
    return rows.select("grp", "object", "seed", F.round("delta", 6).alias("delta"))


@query(
    f"""WITH {RUNS}, a AS (SELECT object, seed, avg(m1) AS m FROM runs WHERE grp <> 'N' AND seed < 4 GROUP BY ALL), b AS (SELECT object, seed, avg(m1) AS m FROM runs WHERE seed > 1 GROUP BY ALL)
SELECT coalesce(a.object, b.object) AS object, coalesce(a.seed, b.seed) AS seed, CASE WHEN a.seed IS NULL THEN 'extra' WHEN b.seed IS NULL THEN 'missing' ELSE 'both' END AS status,
  round(abs(a.m - b.m), 6) AS m_diff FROM a FULL JOIN b ON a.object = b.object AND a.seed = b.seed"""
)
def reconcile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = runs(spark, sf_dir)
    a = ledger.filter("grp <> 'N' AND seed < 4").groupBy("object", "seed").agg(F.avg("m1").alias("m"))
    b = ledger.filter("seed > 1").groupBy("object", "seed").agg(F.avg("m1").alias("m"))
    return replicate.reconcile(a, b, keys=["object", "seed"], metrics=["m"]).withColumn("m_diff", F.round("m_diff", 6))


@query(
    """WITH a AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT a.conv_id, a.i AS ordinal, a.role, b.role AS next_role FROM a JOIN a b ON a.conv_id = b.conv_id AND b.i = a.i + 1"""
)
def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows matched by explicit ordinals instead of positions."""
    rows = numbered(table(spark, sf_dir, "conversations"), by="conv_id", order="turn").select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), "role")
    following = rows.select("conv_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("role").alias("next_role"))
    return rows.join(following, ["conv_id", "ordinal"])


@query("SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_quantity <= 45")
def composite_key_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return expect.missing(items.filter("l_quantity > 49"), items.filter("l_quantity <= 45"), "l_partkey", "l_suppkey", "l_returnflag")


@query(
    """SELECT lang, source, 'missing' AS side FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents)
WHERE (lang, source) NOT IN (SELECT DISTINCT lang, source FROM documents WHERE n_chars > 6000)"""
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which combinations of a plan (languages x sources) have no long document, and which are not in the plan."""
    docs = table(spark, sf_dir, "documents")
    plan = docs.select("lang").distinct().crossJoin(docs.select("source").distinct())  # a plan of a few keys
    return expect.set_difference_report(docs.filter("n_chars > 6000"), plan, "lang", "source")


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 3)")
def nested_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested rows, those of three turns or more unnested again."""
    turns = F.struct("turn", "role", F.length("text").cast("long").alias("n_chars"))
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turns)).alias("turns"))
    return nested.filter(F.size("turns") >= 3).select("conv_id", F.inline("turns"))


@query("SELECT CAST(k AS VARCHAR) AS k, count(*) AS n_pools FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT DISTINCT o_custkey FROM orders) GROUP BY k")
def pool_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by themselves and as orders know them; the two must give a key the same name."""
    named = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    pools = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("origin"))
    pools = pools.unionByName(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k"), named.alias("origin")).distinct())
    return lineage.merged_pool(pools, key="k", origin="origin").select("k", "n_pools")


@query("SELECT lang FROM documents WHERE doc_id < 500 INTERSECT SELECT lang FROM documents WHERE doc_id >= 500")
def setops_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return expect.shared(docs.filter("doc_id < 500"), docs.filter("doc_id >= 500"), "lang")


@query(
    """WITH a AS (SELECT DISTINCT source FROM documents WHERE n_chars > 12000), b AS (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0)
SELECT source, 'extra' AS side FROM a WHERE source NOT IN (SELECT source FROM b) UNION ALL SELECT source, 'missing' FROM b WHERE source NOT IN (SELECT source FROM a)"""
)
def setops_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return expect.set_difference_report(docs.filter("n_chars > 12000"), docs.filter("doc_id % 2 = 0"), "source")


@query("SELECT doc_id, role FROM (SELECT doc_id, 'long' AS role FROM documents WHERE n_chars > 5000 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)")
def setops_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "documents").filter("n_chars > 5000").select("doc_id", F.lit("long").alias("role"))
    return long.unionByName(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("toxic").alias("role")))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").withColumn("nth", first).filter("nth = 1").select("source", "doc_id")


@query(
    f"""WITH {RUNS} SELECT grp, object, seed, m1, CAST(NULL AS VARCHAR) AS alias_of FROM runs
UNION ALL SELECT 'R2', object, seed, m1, 'R' FROM runs WHERE grp = 'R' UNION ALL SELECT 'R3', object, seed, m1, 'R' FROM runs WHERE grp = 'R'"""
)
def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replicate.with_aliases(runs(spark, sf_dir), "grp", {"R2": "R3", "R3": "R"})
    return rows.select("grp", "object", "seed", "m1", "alias_of")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do of a plan when a third of it has output."""
    plan = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", content_hash(F.col("o_orderkey"), F.col("o_orderstatus")).alias("signature"))
    return sinks.pending(plan, plan.filter("o_orderkey % 3 = 0"), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query(
    """WITH r AS (SELECT lang, sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), source, CAST(n_chars AS VARCHAR))) AS x FROM documents)
SELECT lang, count(*) AS n, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), CAST(sum(CAST('0x' || substr(x, 1, 15) AS HUGEINT)) AS VARCHAR),
  CAST(sum(CAST('0x' || substr(x, 50, 15) AS HUGEINT)) AS VARCHAR))) AS digest FROM r GROUP BY lang"""
)
def relation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.relation_digest(table(spark, sf_dir, "documents"), ["doc_id", "source", "n_chars"], ["lang"])


@query("SELECT lang, struct_extract(m, 'n') AS n, struct_extract(m, 'longest') AS longest FROM (SELECT lang, {'n': count(*), 'longest': max(n_chars)} AS m FROM documents GROUP BY lang)")
def record_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "documents").groupBy("lang").agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest")).alias("m"))
    return nested.select("lang", "m.*")
