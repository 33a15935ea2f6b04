"""Sources that keep the order of files, scan with conditions, or hold one record a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.cluster import materialise, scratch
from siftlake.operators.file_order import ordinals
from siftlake.plans.registry import query
from siftlake.sources import readers, sinks
from siftlake.sources.readers import table

SCHEMA = "o_orderkey bigint, o_orderpriority string, o_orderstatus string, o_totalprice double"
FIRST, PREFIX = 100, 150
_ORDER = "ORDER BY o_totalprice DESC, o_orderkey"


def _written(rows: DataFrame, name: str) -> str:
    """Orders written as JSON lines, dearest first."""
    path = scratch(rows.sparkSession, name)
    sinks.write_jsonl(rows.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), path)
    return path


@query(f"SELECT o_orderkey, row_number() OVER ({_ORDER}) - 1 AS ordinal FROM orders")
def file_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's place in the files that hold all orders, dearest first."""
    path = _written(table(spark, sf_dir, "orders"), "orders-in-order")
    return ordinals(readers.read_jsonl(spark, path, SCHEMA, places=True)).select("o_orderkey", "ordinal")


@query(
    f"""SELECT input_name, o_orderkey FROM (SELECT o_orderstatus AS input_name, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus {_ORDER}) AS i
FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')) WHERE i <= {FIRST}"""
)
def first_of_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three inputs the first rows in file order, counted after a filter."""
    orders = table(spark, sf_dir, "orders")
    paths = {s: _written(orders.filter(F.col("o_orderstatus") == s), f"orders-{s}") for s in ("F", "O", "P")}
    rows = readers.read_inputs(spark, paths, SCHEMA, key="o_orderkey", keep=F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"), limit=FIRST)
    return rows.select("input_name", "o_orderkey")


@query(f"SELECT o_orderkey, row_number() OVER ({_ORDER}) - 1 AS ordinal FROM orders WHERE o_orderstatus = 'F' {_ORDER} LIMIT {PREFIX}")
def frozen_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly so many first lines of one kind, from files whose hashes are those noted when they were written."""
    path = _written(table(spark, sf_dir, "orders"), "orders-frozen")
    noted = materialise(readers.inventory(spark, path), "orders-hashes")
    rows = readers.exact_prefix(spark, path, SCHEMA, PREFIX, key="o_orderkey", expected=noted, keep=F.col("o_orderstatus") == "F")
    return rows.select("o_orderkey", "ordinal")


@query(
    """SELECT doc_id, source || CASE WHEN lang = 'en' AND n_chars < 2000 THEN '/short' ELSE '' END AS input_name, n_chars FROM documents
WHERE lang = 'en' AND n_chars >= 1000 AND doc_id IN (SELECT doc_id FROM labels)"""
)
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines under conditions that the scan applies, then by a list of ids; the input's name is derived last."""
    path = scratch(spark, "documents-lines")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    rows = readers.scan_jsonl(spark, path, "doc_id bigint, lang string, source string, n_chars bigint", (F.col("lang") == "en") & (F.col("n_chars") >= 1000))
    rows = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return rows.select("doc_id", F.concat("source", F.when(F.col("n_chars") < 2000, "/short").otherwise("")).alias("input_name"), "n_chars")


@query(
    """SELECT CAST(s_nationkey AS VARCHAR) AS object, s_name AS sample_id, s_acctbal AS balance,
  row_number() OVER (ORDER BY CAST(s_nationkey AS VARCHAR), s_suppkey % 7, s_name) - 1 AS ordinal FROM supplier"""
)
def sidecar_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every supplier, gathered into sorted metadata, which is read back in its order."""
    folder, metadata = scratch(spark, "sidecars"), scratch(spark, "metadata")
    record = F.struct(F.col("s_nationkey").cast("string").alias("object"), F.col("s_name").alias("sample_id"), F.col("s_acctbal").alias("balance"))
    documents = table(spark, sf_dir, "supplier").select(F.to_json(F.struct((F.col("s_suppkey") % 7).alias("placement_index"), record.alias("record"))).alias("value"))
    sinks.write_documents(documents.select("value"), folder)
    sidecars = readers.read_sidecars(spark, folder, "placement_index int, record struct<object: string, sample_id: string, balance: double>", pattern="*.txt")
    sinks.write_jsonl(readers.sidecar_records(sidecars, ["record.object", "placement_index", "record.sample_id"]), metadata)
    return ordinals(readers.read_jsonl(spark, metadata, "balance double, object string, sample_id string", places=True))
