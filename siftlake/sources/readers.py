"""Strict readers: every relation comes in with a declared schema, and what does not fit it is an error."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftlake.cluster import materialise
from siftlake.functions.scalars import portable_path
from siftlake.operators.expect import ContractError, duplicates, require_none, set_difference_report
from siftlake.operators.file_order import PLACE, first_rows, located

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV whose header names the schema's columns, no more and no less, in any order; an empty file is an error."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    first = spark.read.text(path).first()
    header = [c.strip().strip('"') for c in first[0].split(",")] if first else []
    if sorted(header) != sorted(schema.fieldNames()):
        raise ContractError(f"{path}: the header is {header}, not {schema.fieldNames()}")
    in_order = StructType([schema[name] for name in header])
    df = spark.read.csv(path, header=True, schema=in_order, mode="FAILFAST").select(*schema.fieldNames())
    if df.isEmpty():
        raise ContractError(f"{path}: no rows")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None, *, places: bool = False) -> DataFrame:
    """JSON lines with exactly the schema's top-level fields; a missing or further one, or a repeated key, is an error.

    ``places`` adds the columns of ``file_order.located``.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    lines = located(spark.read.text(path)).filter(F.trim("value") != "")
    names = F.array(*[F.lit(n) for n in sorted(schema.fieldNames())])
    odd = lines.filter(F.coalesce(F.array_sort(F.json_object_keys("value")) != names, F.lit(True)))
    require_none(odd.select(F.substring("value", 1, 200).alias("line")), f"{path}: other fields than declared")
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), *(PLACE if places else ()))
    rows = rows.select("r.*", *(PLACE if places else ()))
    if key:
        require_none(duplicates(rows, key), f"{path}: repeated {key}")
    return rows


def read_inputs(
    spark: SparkSession, paths: Mapping[str, str], schema: StructType | str, *, key: str, keep=None, limit: int | None = None
) -> DataFrame:
    """Several JSON-lines inputs with ``input_name``; ``keep`` filters first, then the first ``limit`` rows of each in file order."""
    out = None
    for name, path in paths.items():
        rows = read_jsonl(spark, path, schema, key, places=True)
        rows = (rows.filter(keep) if keep is not None else rows).withColumn("input_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.drop(*PLACE) if limit is None else first_rows(out, limit, by=["input_name"])


def exact_prefix(
    spark: SparkSession, folder: str, schema: StructType | str, n: int, *, key: str, expected: DataFrame | None = None, keep=None
) -> DataFrame:
    """The first ``n`` JSON lines of a folder in file order, of those to ``keep``, with their ``ordinal``; fail closed.

    ``expected`` holds ``path, sha256`` of all files (up to 2 GB each) as ``inventory`` gave them: other files or bytes are an error, and so
    are fewer than ``n`` rows and a key that occurs twice among them. Lines after the prefix may repeat keys.
    """
    if expected is not None:
        found = inventory(spark, folder)
        require_none(set_difference_report(found, expected, "path", "sha256"), f"{folder}: not the expected files")
    rows = read_jsonl(spark, folder, schema, places=True)
    prefix = first_rows(rows.filter(keep) if keep is not None else rows, n, name="ordinal")
    rows_found, keys_found = prefix.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if rows_found != n:
        raise ContractError(f"{folder}: {n} rows wanted, {rows_found} found")
    if keys_found != n:
        raise ContractError(f"{folder}: repeated or null {key} among the first {n} rows")
    return prefix


def scan_jsonl(spark: SparkSession, path: str, schema: StructType | str, where=None) -> DataFrame:
    """JSON lines through the built-in scan: conditions on top-level columns reach it, and only columns in use are parsed.

    Fields beyond the schema are ignored and absent ones null; a line that is no JSON of these types is an error when read, unless
    a condition has refused it by then. ``read_jsonl`` checks more and reads all.
    """
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    return rows.filter(where) if where is not None else rows


def read_decisions(spark: SparkSession, path: str, schema: StructType | str, *, reasons: str = "reject_reasons") -> DataFrame:
    """JSON lines of decisions; one without its array of ``reasons`` is an error when read. An empty array is none."""
    rows = scan_jsonl(spark, path, schema)
    lacking = F.raise_error(F.lit(f"{path}: a decision without {reasons}")).cast(dict(rows.dtypes)[reasons])
    return rows.withColumn(reasons, F.when(F.col(reasons).isNull(), lacking).otherwise(F.col(reasons)))


def read_sidecars(spark: SparkSession, folder: str, schema: StructType | str, *, record: str = "record", pattern: str = "*.json") -> DataFrame:
    """One JSON document a file, anywhere below a folder: its fields, and the ``sidecar`` it came from.

    A document of other types, or without its ``record``, is an error when read. Names not of the ``pattern`` are left unread;
    so are files that a condition on ``sidecar`` excludes.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    files = files.withColumn("at_sidecar", F.col("_metadata.file_path")).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a split has few files
    rows = files.select(F.col("at_sidecar").alias("sidecar"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("sidecar", "r.*")
    lacking = F.raise_error(F.concat(F.col("sidecar"), F.lit(f": no {record}"))).cast(dict(rows.dtypes)[record])
    return rows.withColumn(record, F.when(F.col(record).isNull(), lacking).otherwise(F.col(record)))


def sidecar_records(sidecars: DataFrame, order: Sequence[str], *, record: str = "record") -> DataFrame:
    """The records of sidecars, sorted by ``order``, columns of the sidecar or fields of its record (``record.name``)."""
    return materialise(sidecars, "sidecars").orderBy(*order).select(f"{record}.*")  # a sort reads its rows twice


def read_document(spark: SparkSession, path: str, schema: StructType | str, sidecar: str | None = None) -> DataFrame:
    """One JSON document; with a checksum sidecar ``<64 hex>  <name>`` its bytes must have that SHA-256 first."""
    if sidecar:
        line = spark.read.text(sidecar).first()[0]
        found = re.fullmatch(r"([0-9a-f]{64})  (\S+)", line)
        digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if not found or found[1] != digest:
            raise ContractError(f"{path}: its hash is not the sidecar's")
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def read_marked_block(spark: SparkSession, path: str, name: str) -> str:
    """The text between ``<!-- name:begin -->`` and ``<!-- name:end -->``, which must stand there once each."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    parts = re.findall(rf"<!-- {re.escape(name)}:begin -->\n(.*?)\n?<!-- {re.escape(name)}:end -->", text, re.S)
    if len(parts) != 1 or text.count(f"{name}:begin") != 1 or text.count(f"{name}:end") != 1:
        raise ContractError(f"{path}: expected one block {name}")
    return parts[0]


def read_embedded_json(spark: SparkSession, path: str, name: str, schema: StructType | str) -> DataFrame:
    """JSON kept in an HTML comment ``<!-- name: {...} -->`` of a report."""
    texts = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?s)<!-- {re.escape(name)}: (\{{.*?\}}) -->", 1)
    return texts.select(F.from_json(body, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``path, bytes, sha256`` of all files below a folder, paths relative and with forward slashes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = re.sub(r"^file:/*", "/", folder).rstrip("/")
    plain = F.regexp_replace(portable_path(F.col("path")), r"^file:/*", "/")
    relative = F.regexp_replace(plain, rf"^{re.escape(base)}/", "")
    return files.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def merge_caches(caches: Sequence[DataFrame], *, key: str, value: str) -> DataFrame:
    """The union of caches; one key with two values is an error when read."""
    rows = caches[0]
    for more in caches[1:]:
        rows = rows.unionByName(more)
    agreed = rows.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(value))).alias("n"), F.first(value).alias(value))
    checked = F.when(F.col("n") == 1, F.col(value)).otherwise(F.raise_error(F.concat(F.lit("two values for "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[value]))
    return agreed.select(key, checked.alias(value))


def numbered(df: DataFrame, *, by: str, order: str) -> DataFrame:
    """Ordinals from 0 by an explicit order, so that prefixes do not depend on files."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
