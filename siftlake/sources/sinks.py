"""Sinks that refuse to overwrite, to repeat a key, or to change what is frozen."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.expect import ContractError, duplicates, require_none, shared
from siftlake.operators.lineage import relation_digest


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def publish_views(decided: DataFrame, folder: str) -> None:
    """One table partitioned by ``passed``: the whole is the unfiltered view, ``passed=true`` the filtered one."""
    decided.write.partitionBy("passed").mode("errorifexists").parquet(folder)


def read_view(spark: SparkSession, folder: str, view: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    rows = rows.withColumn("passed", F.col("passed").cast("boolean"))
    if view not in ("unfiltered", "filtered"):
        raise ValueError(f"unknown view: {view}")
    return rows.filter("passed") if view == "filtered" else rows


VERSIONS = "_versions"


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(target), system


def committed(spark: SparkSession, path: str) -> list[str]:
    """The data folders of a ledger's versions, oldest first: what its version files name."""
    target, system = _files(spark, f"{path}/{VERSIONS}")
    if not system.exists(target):
        return []
    out = []
    for name in sorted(s.getPath().getName() for s in system.listStatus(target) if s.getPath().getName().isdigit()):
        stream = system.open(_files(spark, f"{path}/{VERSIONS}/{name}")[0])
        try:
            out.append(f"{path}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}")
        finally:
            stream.close()
    return out


def _commit(spark: SparkSession, path: str, version: int, folder: str) -> bool:
    """Make a version's file, which names its data; false if another writer has made that version.

    The file is written under a name of its own and appears whole: by a hard link on a local disk, elsewhere by a rename,
    which HDFS refuses where the name is taken.
    """
    staged, system = _files(spark, f"{path}/_staged/{folder}")
    target, _ = _files(spark, f"{path}/{VERSIONS}/{version:012d}")
    system.mkdirs(target.getParent())
    stream = system.create(staged, False)
    stream.write(bytearray(folder.encode()))
    stream.close()
    if system.getScheme() != "file":
        return system.rename(staged, target)
    local = spark._jvm.java.nio.file
    try:
        local.Files.createLink(local.Paths.get(target.toUri()), local.Paths.get(staged.toUri()))
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    finally:
        system.delete(staged, False)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows that have been appended; what a writer has not committed, or was refused, is not there."""
    folders = committed(spark, path)
    if not folders:
        raise ContractError(f"{path}: no ledger")
    return spark.read.parquet(*folders)


def append_unique(rows: DataFrame, path: str, key: str) -> None:
    """Append to a ledger; other columns, or a key that is there already or twice in ``rows``, is an error.

    The rows are written beside the ledger, checked against all its versions and then committed as the next one. If another
    writer has taken that version, its rows are checked as well and the one after it is tried: of two writers with
    a key in common one is refused, whatever their timing. Nulls are a key.
    """
    spark, folder = rows.sparkSession, f"data-{uuid.uuid4().hex}"
    known, checked = committed(spark, path), 0
    if known and (columns := spark.read.parquet(known[0]).columns) != rows.columns:
        raise ContractError(f"the ledger has {columns}, not {rows.columns}")
    rows.write.parquet(f"{path}/{folder}")
    try:
        own = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
        require_none(duplicates(own, key), f"repeated {key}")
        while True:
            if len(known) > checked:
                others = spark.read.parquet(*known[checked:])
                if others.columns != rows.columns:
                    raise ContractError(f"the ledger has {others.columns}, not {rows.columns}")
                require_none(shared(own, others, key), f"{key} is in the ledger")
            checked = len(known)
            if _commit(spark, path, checked, folder):
                return
            known = committed(spark, path)
    except ContractError:
        target, system = _files(spark, f"{path}/{folder}")
        system.delete(target, True)
        raise


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed columns in order; null becomes empty."""
    df.select(*columns).write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; the job's commit makes it all or nothing."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_documents(df: DataFrame, folder: str) -> None:
    """A file for each row of one text column, in one folder, written by all tasks; tasks put their own files in place."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, F.xxhash64(*df.columns))  # a small table is one split, and its task would write all files
    dealt.write.options(**{"maxRecordsPerFile": "1", "mapreduce.fileoutputcommitter.algorithm.version": "2"}).mode("errorifexists").text(folder)


def freeze(df: DataFrame, path: str) -> str:
    """Write once with a digest beside it; writing the same relation again changes nothing, another is an error."""
    spark = df.sparkSession
    digest = relation_digest(df, df.columns).first()["digest"]
    if _exists(spark, path):
        if relation_digest(spark.read.parquet(path), df.columns).first()["digest"] != digest:
            raise ContractError(f"{path} is frozen")
        return digest
    df.write.parquet(path)
    spark.createDataFrame([(f"{digest}  {path.rsplit('/', 1)[-1]}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.sha256")
    return digest


def pending(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a plan without output yet; output under another signature than planned is an error when read."""
    signed = done.select(key, F.col("signature").alias("done_signature"))
    rows = plan.join(signed, key, "left")
    other = F.col("done_signature").isNotNull() & (F.col("done_signature") != F.col("signature"))
    checked = F.when(other, F.raise_error(F.concat(F.lit("other signature for "), F.col(key).cast("string"))).cast("string")).otherwise(F.col("done_signature"))
    return rows.withColumn("done_signature", checked).filter("done_signature IS NULL").drop("done_signature")
