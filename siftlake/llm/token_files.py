"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A file set is a folder of Parquet tables, so that any store Spark writes to will do:

* ``dictionary``: one row, the trained dictionary and its hash;
* ``shards``: one row per shard with its place in the order (``part``, ``shard``), the range of its doc_ids, its
  number of documents and tokens, and ``blob``.

A blob is: magic, id width, dictionary hash, count | one zstandard frame per document | doc_ids, frame offsets,
token counts | place of that index, magic. A reader decompresses one document without touching the others.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise, shared_dir, ship
from siftlake.llm.tokens import encoder

MAGIC = b"SLTOKEN1"
HEAD = struct.Struct("<8sB32sI")
FOOT = struct.Struct("<Q8s")
NO_ID = -(1 << 63)
SHARD_TOKENS = 1 << 20
#: The dictionary: documents of its sample, characters of each, and its size.
DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_BYTES = 256, 20_000, 32768
LEVEL = 3
SHARDS_SQL = "part int, shard int, first_id long, last_id long, documents long, tokens long, blob binary"
SHARDS = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64())]
    + [("documents", pa.int64()), ("tokens", pa.int64()), ("blob", pa.binary())]
)
ROWS_SQL = "part int, shard int, doc_id long, before long, n_tokens long, ids binary"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; if there is too little to train on, the samples' own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def pack(ids: list[np.ndarray], doc_ids: list[int | None], dictionary: bytes) -> bytes:
    shared = _dictionary(dictionary)
    compressor = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": shared} if shared else {}))
    frames = [compressor.compress(x.tobytes()) for x in ids]
    width = ids[0].dtype.itemsize
    head = HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest(), len(ids))
    offsets = HEAD.size + np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    index = np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes() + offsets.astype("<u8").tobytes()
    index += np.array([len(x) for x in ids], "<u4").tobytes()
    return b"".join([head, *frames, index, FOOT.pack(int(offsets[-1]), MAGIC)])


class Shard:
    """Random access to the documents of one blob."""

    def __init__(self, blob: bytes, dictionary: bytes) -> None:
        magic, self.width, digest, n = HEAD.unpack_from(blob)
        at, end = FOOT.unpack_from(blob, len(blob) - FOOT.size)
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token-id shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.blob = memoryview(blob)
        self.doc_ids = np.frombuffer(blob, "<i8", n, at)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at + 8 * n)
        self.tokens = np.frombuffer(blob, "<u4", n, at + 8 * n + 8 * (n + 1))
        shared = _dictionary(dictionary)
        self.decompressor = zstandard.ZstdDecompressor(**({"dict_data": shared} if shared else {}))

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, as unsigned 32-bit integers."""
        raw = self.decompressor.decompress(self.blob[int(self.offsets[i]) : int(self.offsets[i + 1])])
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _write(path: str, end_id: int, dictionary: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(path).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder(path).dtype)
        ids, names, tokens = [], [], 0

        def full() -> pa.RecordBatch:
            row = [part, shard, names[0], names[-1], len(ids), tokens, pack(ids, names, dictionary)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, SHARDS.types)], schema=SHARDS)

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(np.concatenate([encode(text), end]))
                names.append(name)
                tokens += len(ids[-1])
                if tokens >= SHARD_TOKENS:
                    yield full()
                    shard, ids, names, tokens = shard + 1, [], [], 0
        if ids:
            yield full()

    return write


def write_ids(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int, parts: int | None = None) -> None:
    """Encode ``doc_id, text`` rows in ascending order of doc_id (null first; ties by text) into ``folder``.

    A null text is encoded like an empty one: only the end id. The dictionary is trained on a bounded sample of
    ``DICTIONARY_DOCS`` documents, ``DICTIONARY_CHARS`` characters of each at most; it changes only the size of the files. Rows are dealt by ranges of doc_id, so
    each task writes a run of the order.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCS)  # of fixed size
    sample = rows.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select(F.substring("text", 1, DICTIONARY_CHARS).alias("text")).limit(2 * DICTIONARY_DOCS).collect()
    encode = encoder(tokenizer).encode
    dictionary = train_dictionary([encode(r.text).tobytes() for r in sample if r.text])
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{folder}/dictionary")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(_write(tokenizer, end_id, dictionary), SHARDS_SQL)
    shards.write.option("compression", "none").parquet(f"{folder}/shards")


def _read(dictionary: bytes, wanted: frozenset[int] | None = None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "blob"))):
                shard = Shard(blob, dictionary)
                before = np.concatenate([[0], np.cumsum(shard.tokens, dtype=np.int64)])[:-1]
                chosen = [i for i, d in enumerate(shard.doc_ids.tolist()) if wanted is None or d in wanted]
                for at in range(0, len(chosen), 500):
                    some = chosen[at : at + 500]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(some), pa.int32()),
                            pa.array([number] * len(some), pa.int32()),
                            pa.array([None if shard.doc_ids[i] == NO_ID else int(shard.doc_ids[i]) for i in some], pa.int64()),
                            pa.array(before[some]),
                            pa.array(shard.tokens[some].astype(np.int64)),
                            pa.array([shard.document(i).tobytes() for i in some], pa.binary()),
                        ],
                        names=["part", "shard", "doc_id", "before", "n_tokens", "ids"],
                    )

    return read


def _dictionary_of(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first()[0])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ids are little-endian unsigned 32-bit integers."""
    shards = spark.read.parquet(f"{folder}/shards")
    per_part = shards.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("part_start", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("shard_start"))
    starts = starts.join(per_part, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    starts = materialise(starts, "token-starts")  # a few bytes a shard: Spark sees the size and need not shuffle the ids
    rows = shards.select("part", "shard", "blob").mapInArrow(_read(_dictionary_of(spark, folder)), ROWS_SQL)
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def fetch(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of a few documents: other shards are skipped by their range, other documents by the index."""
    shards = spark.read.parquet(f"{folder}/shards")
    near = F.lit(False)
    for d in doc_ids:
        near = near | ((F.col("first_id") <= d) & (F.col("last_id") >= d))
    found = shards.filter(near).select("part", "shard", "blob")
    return found.mapInArrow(_read(_dictionary_of(spark, folder), frozenset(doc_ids)), ROWS_SQL).select("doc_id", "ids")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all of ``documents`` and tells of each document what the files hold."""
    folder = f"{shared_dir(spark)}/siftlake/token-files-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_ids(docs, folder, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
