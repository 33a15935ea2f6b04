"""Session helpers: shipping the package to executors and writing intermediate tables to shared storage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
BATCH_ROWS = 2000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers; Spark distributes the archive. Once per application.

    Arrow batches are held to ``BATCH_ROWS`` rows, as a row here may be a long document.
    """
    sc = spark.sparkContext
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="siftlake-")), "siftlake.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(PACKAGE_DIR):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("siftlake", os.path.relpath(path, PACKAGE_DIR)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one is made in a local session only.

    Elsewhere executors would write to their own disks, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = existing.get() if existing.isDefined() else None
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="siftlake-shared-"))
        spark.sparkContext.setCheckpointDir(folder)
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = existing.get()
    return folder.rstrip("/")


_written: dict[str, list[str]] = {}


def written(spark: SparkSession) -> int:
    """How many tables this application has materialised and not released: a mark for ``release``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that this application has materialised since a mark, but for the last ``keep`` of them.

    Results that still read them must be done with.
    """
    paths = _written.get(spark.sparkContext.applicationId, [])
    end = max(since, len(paths) - keep)
    gone = paths[since:end]
    del paths[since:end]
    for path in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` deletes with the tables."""
    path = f"{shared_dir(spark)}/siftlake/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: an executor that is lost later costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
