"""Relations that several queries start from, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import lineage
from siftlake.sources.readers import table


def samples(spark: SparkSession, sf_dir: str, passages: DataFrame | None = None) -> DataFrame:
    """Documents with content hash, lines, characters per line and labels (null where there are none).

    Whatever depends on the text is computed in the scan, containment of ``passages`` too, so no text is shuffled.
    """
    lines = F.size(F.split("text", "\n"))
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha"), lines.cast("long").alias("n_lines"), (F.col("n_chars") / lines).alias("per_line")]
    if passages is not None:
        docs, columns = lineage.with_containment(docs, "text", passages), [*columns, "contains_passage"]
    return docs.select(*columns).join(table(spark, sf_dir, "labels"), "doc_id", "left")


SAMPLES = """samples AS (
  SELECT d.doc_id, lang, source, n_chars, text, sha256(text) AS sha, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
         CAST(n_chars AS DOUBLE) / len(string_split(text, chr(10))) AS per_line, quality, toxic
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run ledger: group, object, seed and two metrics, from line items."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("object"), F.col("l_linenumber").alias("seed")).agg(
        F.round(F.avg("l_discount"), 9).alias("m1"), F.round(F.avg("l_tax"), 9).alias("m2"), F.count(F.lit(1)).alias("n")
    )


RUNS = """runs AS (
  SELECT l_returnflag AS grp, l_linestatus AS object, l_linenumber AS seed, round(avg(l_discount), 9) AS m1, round(avg(l_tax), 9) AS m2, count(*) AS n
  FROM lineitem GROUP BY ALL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in [0, 1) that depends on the doc_id's hash and leans on the label."""
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.withColumn("score", F.round(0.7 * u + 0.3 * F.col("quality"), 3))


SCORED = """scored AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic,
         round(0.7::DOUBLE * (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) + 0.3::DOUBLE * quality, 3) AS score
  FROM documents JOIN labels USING (doc_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference (every tenth vector) and generated vectors with ``g`` (label), ``id`` and ``v``."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("g"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter("id % 10 = 0"), rows.filter("id % 10 <> 0")


VECTORS = """v AS (SELECT CAST(label AS VARCHAR) AS g, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ref AS (SELECT * FROM v WHERE id % 10 = 0),
gen AS (SELECT * FROM v WHERE id % 10 <> 0)"""
