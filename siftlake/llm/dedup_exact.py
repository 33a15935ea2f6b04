"""Exact dedup by an exchange of Golomb-coded fingerprints.

Each sender (a task that scans documents) hashes its texts to as many bits as the corpus needs, sorts the
hashes, splits them by owner (a range of the hash space) and sends each owner one Golomb-Rice coded list.
An owner decodes the lists of all senders, and answers each with a bitmap: one bit per hash it sent, set where
the hash occurs more than once anywhere. Only documents with a set bit are suspects, and only their texts are
shuffled, to be grouped byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.llm.idset import marked, without_ids

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits beyond log2(documents): one in 2**SPARE_BITS single documents is suspected without need.
SPARE_BITS = 10
#: A sender gathers at most this many hashes before it sends; a task over more rows acts as several senders.
SENDER_ROWS = 1 << 17
#: Hashes an owner is meant for at most; more documents make more owners.
OWNER_HASHES = 1 << 18


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def rice_encode(values: np.ndarray) -> tuple[bytes, bytes, int]:
    """Sorted non-negative integers as gaps: a unary stream of quotients, a stream of remainders, remainder bits."""
    gaps = np.diff(values, prepend=np.zeros(1, values.dtype)).astype(np.uint64)
    mean = float(gaps.mean()) if len(gaps) else 1.0
    bits = max(0, int(np.floor(np.log2(max(1.0, mean * 0.6931)))))
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes(), bits


def rice_decode(unary: bytes, rest: bytes, bits: int, count: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:count]
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    flat = np.unpackbits(np.frombuffer(rest, np.uint8))[: count * bits].reshape(count, bits).astype(np.uint64)
    gaps = (quotients << np.uint64(bits)) + (flat << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


SENT_SQL = (
    "sender string, doc_id long, text_sha256 string, fingerprint long, "
    "owner int, unary binary, rest binary, bits int, count int"
)
SENT = pa.schema(
    [("sender", pa.string()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("fingerprint", pa.int64())]
    + [("owner", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("bits", pa.int32()), ("count", pa.int32())]
)


def _send(width: int, owner_bits: int):
    """Rows of documents, then for each sender one coded list per owner of the hashes it holds, each hash once."""

    def lists(name: str, held: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.unique(np.concatenate(held))
        owners = (hashes >> np.uint64(width - owner_bits)).astype(np.int64)
        rows = []
        for owner in np.unique(owners):
            own = hashes[owners == owner] - (np.uint64(owner) << np.uint64(width - owner_bits))
            rows.append((name, None, None, None, int(owner), *rice_encode(own), len(own)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SENT.types)], schema=SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            n = batch.num_rows
            if rows and rows + n > SENDER_ROWS:
                yield lists(f"{task}-{part}", held)
                part, held, rows = part + 1, [], 0
            texts = [t.encode() for t in pc.ascii_lower(pc.fill_null(batch.column("text"), "")).to_pylist()]
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, n) >> np.uint64(64 - width)
            held.append(hashes)
            rows += n
            columns = [pa.array([f"{task}-{part}"] * n), batch.column("doc_id"), pa.array(digests), pa.array(hashes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(n, t) for t in SENT.types[4:]], schema=SENT)
        if rows:
            yield lists(f"{task}-{part}", held)

    return send


def _own(lists: pd.DataFrame) -> pd.DataFrame:
    """One owner: of every list it was sent, which hashes occur twice or more among all lists."""
    decoded = [rice_decode(*row) for row in lists[["unary", "rest", "bits", "count"]].itertuples(index=False)]
    hashes, counts = np.unique(np.concatenate(decoded), return_counts=True)
    repeated = hashes[counts > 1]
    bitmaps = [np.packbits(np.isin(values, repeated)).tobytes() for values in decoded]
    return pd.DataFrame({"sender": lists["sender"], "owner": lists["owner"], "bitmap": bitmaps, "count": lists["count"]})


def _suspects(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """One sender: its documents with a set bit. Answers in owner order follow the sorted hashes."""
    _, inverse, counts = np.unique(rows["fingerprint"].to_numpy(), return_inverse=True, return_counts=True)
    answers = answers.sort_values("owner")
    flags = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(answers["bitmap"], answers["count"])]
    suspect = (np.concatenate(flags) == 1) | (counts > 1)
    return rows.loc[suspect[inverse], ["doc_id"]]


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts the row with
    the largest doc_id stays; of rows that repeat that doc_id as well, every one is marked kept (the callers'
    ids are keys). A null doc_id is smaller than any other. An empty table gives an empty result. Other columns are
    not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.count()
    width = min(62, max(24, total.bit_length() + SPARE_BITS))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = owners or max(min(parallel, total // 1024), total // OWNER_HASHES, 2)
    owner_bits = (owners - 1).bit_length()
    sent = materialise(rows.mapInArrow(_send(width, owner_bits), SENT_SQL), "dedup-sent")
    own = sent.filter(F.col("owner").isNull()).select("sender", "doc_id", "text_sha256", "fingerprint")
    lists = sent.filter(F.col("owner").isNotNull()).select("sender", "owner", "unary", "rest", "bits", "count")
    answers = lists.groupBy("owner").applyInPandas(_own, "sender string, owner int, bitmap binary, count int")
    suspects = (
        own.select("sender", "doc_id", "fingerprint").groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(_suspects, "doc_id long")
    )
    suspects = materialise(suspects, "dedup-suspects")
    groups = materialise(_verified(rows, suspects), "dedup-groups")
    joined = own.select("doc_id", "text_sha256").join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _verified(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """Groups of two or more byte-equal texts among the suspects: ``text_sha256, keep_id, group_size``.

    A bitmap of bounded size of the suspects' ids is broadcast, and only the texts of
    documents whose bit is set are shuffled; a chance hit is a text alone in its group. The texts are grouped by
    their bytes; Spark combines equal texts before the shuffle, so a task sends a text once for all its copies.
    """
    near = marked(rows, suspects).filter("hit").select("row.*")
    texts = near.select("doc_id", normalised(F.col("text")).alias("text"))
    groups = texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.filter("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    one = F.when(F.count(F.lit(1)) == 1, F.max("keep_id")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")))
    return groups.groupBy("text_sha256").agg(one.alias("keep_id"), F.max("group_size").alias("group_size"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops."""
    dropped = exact_groups(docs, **options).filter(~F.col("kept")).select("doc_id")
    return without_ids(docs, materialise(dropped, "dedup-dropped"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` with the row that stays of each document's equal texts."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
