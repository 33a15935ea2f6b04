"""The prefix trie of conversations, grouped by polynomial rolling fingerprints of their turns.

A turn is the SHA-256 of its role and text. The fingerprint of a prefix of d turns is the sum of turn hash times base**i
over its turns, modulo a prime: numpy scans give it for every prefix of a chunk of turns at once, and what stands before a
chunk is one number, so a conversation of any length is spread over tasks. Prefixes of equal length and fingerprint are a
candidate group. If all turns at the end of a group are its representative's (its smallest conversation's), and the
groups above have been verified as well, the prefixes are equal turn by turn: equal last turns and fingerprints leave equal
fingerprints one turn earlier. Members with another last turn are split off: they carry a label from there on, and
groups are formed again with it, until none differs.

Sums over a subtree need no walk from level to level. A node belongs to its smallest member; the nodes of a
conversation are one chain, from some depth to its end. So what the nodes of a subtree add up to is what the chains of its
members add up to, less what stands above in the chain of the node's own: two aggregations.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.llm.held import release
from siftlake.llm.repair import CRC32_SQL, crc32_sql, in_order

PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 69_069_069)
#: Turns of a chunk; turns a task takes apart at once; conversations of a block of the rule, and the turns it may share.
CHUNK, AT_ONCE, BLOCK, SHARED = 512, 1 << 16, 100, 5
#: Ids in a row of the lists that are hashed, depths in a bucket of running sums.
LIST_IDS, DEPTHS = 4096, 4096
NODE = ["depth", "fp", "label"]


def _chunks(most: int):
    """Turns in order to chunks of one conversation, numbered along the order."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number, now, digests, lengths = TaskContext.get().partitionId() << 32, None, [], []
        for batch in batches:
            out = []
            for conv, digest, length in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "digest", "length"))):
                if digests and (conv != now or len(digests) >= most):
                    out.append((now, number, len(digests), b"".join(digests), lengths))
                    number, digests, lengths = number + 1, [], []
                now = conv
                digests.append(digest)
                lengths.append(length)
            if out:
                yield _rows(out)
        if digests:
            yield _rows([(now, number, len(digests), b"".join(digests), lengths)])

    return chunks


CHUNKS = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("n", pa.int64()), ("digests", pa.binary()), ("lengths", pa.list_(pa.int64()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNKS.types)], schema=CHUNKS)


def turns(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, before, n, total, digests, lengths``: chunks of a conversation's turns, and how many stand before each."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("digest", digest).withColumn("length", F.length("text").cast("long"))
    ordered = in_order(rows, "role", "text", ["conv_id", "turn", "digest", "length"])
    found = materialise(ordered.mapInArrow(_chunks(chunk), "conv_id long, seg long, n long, digests binary, lengths array<long>"), "trie-chunks")
    earlier = Window.partitionBy("conv_id").orderBy("seg")
    places = found.select("conv_id", "seg", "n").withColumn("before", F.sum("n").over(earlier) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("conv_id")))
    return found.drop("conv_id", "n").join(places, "seg").drop("seg")


def rebuilt(chunks: DataFrame) -> DataFrame:
    """``conv_id, start, digests, lengths, last, first``: the rule's conversations in chunks; the first one may be empty.

    The first h turns of conversation c - c % 100 (none if there is no such), then the own ones after the first h, where h is
    crc32(decimal c) % 6. ``%`` is truncated, so c = -7 has block 0.
    """
    opening = F.aggregate(
        F.array_sort(F.collect_list(F.struct("before", "digests", "lengths"))),
        F.struct(F.lit(bytearray()).alias("d"), F.array().cast("array<long>").alias("l")),
        lambda s, x: F.struct(F.concat(s["d"], x["digests"]).alias("d"), F.concat(s["l"], x["lengths"]).alias("l")),
    )
    few = chunks.filter((F.col("conv_id") % BLOCK == 0) & (F.col("before") < SHARED))
    few = few.select("conv_id", "before", F.substring("digests", 1, 32 * SHARED).alias("digests"), F.slice("lengths", 1, SHARED).alias("lengths"))
    heads = few.groupBy(F.col("conv_id").alias("block")).agg(opening.alias("head"))
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    rows = chunks.withColumn("h", h).withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "block", "left")
    shared = F.least("h", F.coalesce(F.size("head.l"), F.lit(0)))
    skip = F.least(F.greatest(F.col("h") - F.col("before"), F.lit(0)), F.col("n"))
    first, end = F.col("before") == 0, F.col("before") + F.col("n")
    rows = rows.withColumns({"shared": shared.cast("long"), "skip": skip.cast("long")})
    own = F.substring(F.col("digests"), (32 * F.col("skip") + 1).cast("int"), (32 * F.col("n")).cast("int"))
    ahead = F.substring(F.col("head.d"), F.lit(1), (32 * F.col("shared")).cast("int"))
    kept = rows.filter(first | (end > F.col("h")))
    return kept.select(
        "conv_id",
        F.when(first, 0).otherwise(F.col("shared") + F.greatest(F.col("before") - F.col("h"), F.lit(0))).cast("long").alias("start"),
        F.when(first & (F.col("shared") > 0), F.concat(ahead, own)).otherwise(own).alias("digests"),
        F.when(first & (F.col("shared") > 0), F.concat(F.slice("head.l", 1, F.col("shared").cast("int")), F.slice("lengths", (F.col("skip") + 1).cast("int"), F.col("n").cast("int"))))
        .otherwise(F.slice("lengths", (F.col("skip") + 1).cast("int"), F.col("n").cast("int")))
        .alias("lengths"),
        (F.col("total") <= F.greatest(end, F.col("h"))).alias("last"),
        first.alias("first"),
    )


class Scan:
    """The turns of some chunks one after another, with the fingerprints of the prefixes that end at them."""

    def __init__(self, batch: pa.RecordBatch, prime: int):
        sizes = np.array(pa.compute.list_value_length(batch.column("lengths")), np.int64)
        start = batch.column("start").to_numpy()
        self.row = np.repeat(np.arange(batch.num_rows), sizes)
        place = np.arange(len(self.row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.depth = start[self.row] + place + 1
        self.length = batch.column("lengths").flatten().to_numpy()
        words = np.frombuffer(b"".join(batch.column("digests").to_pylist()), np.uint64).reshape(-1, 4)
        self.words = words.view(np.int64)
        self.sizes, self.totals = sizes, []
        p = np.uint64(prime)
        fp, above = np.zeros(len(self.row), np.uint64), np.zeros(len(self.row), np.uint64)
        ends = np.cumsum(sizes)
        for lane, base in enumerate(BASES):
            powers = np.ones(int(sizes.max(initial=0)) + 2, np.uint64)
            for i in range(1, len(powers)):
                powers[i] = int(powers[i - 1]) * base % prime
            at = np.array([pow(base, int(s), prime) for s in start], np.uint64)
            terms = words[:, lane] % p * (powers[place + 1] * at[self.row] % p) % p
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
            self.totals.append((sums[ends] - sums[ends - sizes]) % p)
            known = batch.column(f"before{lane}").to_numpy().astype(np.uint64) if f"before{lane}" in batch.schema.names else np.zeros(batch.num_rows, np.uint64)
            upto = (sums[1:] - sums[(ends - sizes)[self.row]] + known[self.row]) % p
            fp |= upto << np.uint64(31 * (1 - lane))
            above |= (upto + p - terms) % p << np.uint64(31 * (1 - lane))
        self.fp, self.above = fp.astype(np.int64), above.astype(np.int64)
        self.label, self.above_label = np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
        if "splits" in batch.schema.names:
            for i, splits in enumerate(batch.column("splits").to_pylist()):
                if splits:
                    own = self.row == i
                    self.label[own], self.above_label[own] = (_labels(self.depth[own] - less, splits) for less in (0, 1))


def _labels(depth: np.ndarray, splits: list[dict]) -> np.ndarray:
    """The label at each depth: what the splits down to it hash to."""
    out, label = np.zeros(len(depth), np.int64), 0
    for depth_of, value in sorted((s["depth"], s["value"]) for s in splits):
        (label,) = struct.unpack("q", xxhash.xxh64_digest(struct.pack("qqq", label, depth_of, value)))
        out[depth >= depth_of] = label
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``AT_ONCE`` turns."""
    release()
    for batch in batches:
        sizes = np.cumsum(np.array(pa.compute.list_value_length(batch.column("lengths")), np.int64) + 1)
        cuts = np.searchsorted(sizes, np.arange(AT_ONCE, sizes[-1] if len(sizes) else 0, AT_ONCE)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            if high > low:
                yield batch.slice(low, high - low)


def _totals(prime: int):
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            scan = Scan(batch, prime)
            columns = [batch.column("conv_id"), batch.column("start"), *[pa.array(t.astype(np.int64)) for t in scan.totals]]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "start", "t0", "t1"])

    return totals


def _members(prime: int):
    """A row for each conversation and prefix, the empty one too."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            scan, conv = Scan(batch, prime), batch.column("conv_id").to_numpy()
            columns = [conv[scan.row], scan.depth, scan.fp, scan.label, scan.above, scan.above_label, *scan.words.T, scan.length]
            roots = conv[batch.column("first").to_numpy(zero_copy_only=False)]
            none = np.zeros(len(roots), np.int64)
            columns = [np.concatenate([c, r]) for c, r in zip(columns, [roots, none, none, none, none - 1, none, *[none] * 5])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=MEMBER)

    return members


WORDS = ["q0", "q1", "q2", "q3"]
MEMBER = ["conv_id", *NODE, "above", "above_label", *WORDS, "length"]


def _ends(prime: int):
    """The whole prefix of each conversation."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            scan, conv = Scan(batch, prime), batch.column("conv_id").to_numpy()
            last = np.flatnonzero(batch.column("last").to_numpy(zero_copy_only=False))
            full = last[scan.sizes[last] > 0]
            at = np.cumsum(scan.sizes)[full] - 1
            empty = conv[last[scan.sizes[last] == 0]]
            none = np.zeros(len(empty), np.int64)
            columns = [np.concatenate([c, e]) for c, e in zip([conv[full], scan.depth[at], scan.fp[at], scan.label[at]], [empty, none, none, none])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["conv_id", *NODE])

    return ends


def _shares(prime: int):
    """What a conversation's chain adds to each of its prefixes shorter than ``single``."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            scan = Scan(batch, prime)
            single, weight, leaves = (batch.column(n).to_numpy() for n in ("single", "weight", "leaves"))
            some = np.flatnonzero(scan.depth < single[scan.row])
            roots = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False) & (single > 0))
            none = np.zeros(len(roots), np.int64)
            row = np.concatenate([scan.row[some], roots])
            columns = [np.concatenate([c[some], none]) for c in (scan.depth, scan.fp, scan.label)] + [weight[row], leaves[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*NODE, "weight", "leaves"])

    return shares


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and conversation; the ids of a node in rows of up to ``LIST_IDS``."""
    release()
    now, ids, names = None, [], [*NODE, "low", "ids"]

    def row() -> tuple:
        return (*now, ids[0], ",".join(map(str, ids)))

    def batch_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    for batch in batches:
        out = []
        for *node, conv in zip(*(batch.column(n).to_pylist() for n in (*NODE, "conv_id"))):
            if ids and (node != now or len(ids) >= LIST_IDS):
                out.append(row())
                ids = []
            now = node
            ids.append(conv)
        yield from batch_of(out)
    yield from batch_of([row()] if ids else [])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and least id; the SHA-256 of a node's ids, read on from row to row."""
    release()
    now, digest, names = None, None, [*NODE, "ends_sha256"]
    for batch in batches:
        out = []
        for *node, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids"))):
            if node != now:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, digest.hexdigest())], names=names)


def _split_off(members: DataFrame, mixed: DataFrame, number: int) -> DataFrame:
    """``conv_id, depth, value`` of the members of groups in which last turns differ, but for those of the representative's."""
    found = materialise(members.join(mixed.select(*NODE), NODE).select("conv_id", *NODE, *WORDS), "trie-mixed")
    own = found.groupBy(*NODE).agg(F.min(F.struct("conv_id", *WORDS)).alias("rep"))
    other = found.join(own, NODE).filter(F.struct(*WORDS) != F.struct(*[F.col("rep")[w] for w in WORDS]))
    return other.select("conv_id", "depth", F.xxhash64(F.lit(number), *WORDS).alias("value"))


def _verified(rows: DataFrame, prime: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their splits, and the nodes: groups in which every last turn is the representative's."""
    sql = ", ".join(f"{c} long" for c in MEMBER)
    splits, number = None, 0
    while True:
        members = rows.mapInArrow(_members(prime), sql)
        each = [f(w).alias(f"{w}_{n}") for w in WORDS for n, f in (("low", F.min), ("high", F.max))]
        grouped = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("above", "above_label", "length")], *each)
        differs = F.lit(False)
        for w in WORDS:
            differs = differs | (F.col(f"{w}_low") != F.col(f"{w}_high"))
        nodes = materialise(grouped.select(*NODE, "conv_id", "n_convs", "above", "above_label", "length", differs.alias("differs")), "trie-nodes")
        mixed = nodes.filter("differs")
        if mixed.isEmpty():
            return rows, nodes.drop("differs")
        more, number = _split_off(members, mixed, number), number + 1
        splits = materialise(more if splits is None else splits.unionByName(more), "trie-splits")
        by_conv = splits.groupBy("conv_id").agg(F.collect_list(F.struct("depth", "value")).alias("splits"))
        rows = materialise(rows.drop("splits").join(by_conv, "conv_id", "left"), "trie-rows")


def _above_in_chain(shared: DataFrame) -> DataFrame:
    """``conv_id, depth, less``: the weights of a conversation's nodes above each of its nodes; depths go in buckets."""
    rows = shared.select("conv_id", "depth", "weight", F.floor(F.col("depth") / DEPTHS).alias("bucket"))
    sums = rows.groupBy("conv_id", "bucket").agg(F.sum("weight").alias("sum"))
    whole = F.coalesce(F.sum("sum").over(Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("weight").over(Window.partitionBy("conv_id", "bucket").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sums.withColumn("whole", whole).drop("sum"), ["conv_id", "bucket"]).select("conv_id", "depth", (F.col("whole") + within).alias("less"))


def trie(rows: DataFrame, *, prime: int = PRIME) -> DataFrame:
    """The nodes of ``conv_id, start, digests, lengths, last, first``, chunks of conversations as ``rebuilt`` gives them.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, the root included. A
    smaller ``prime`` makes collisions, and more rounds, but no other result.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.mapInArrow(_totals(prime), "conv_id long, start long, t0 long, t1 long")
    earlier = Window.partitionBy("conv_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "start", *[(F.sum(f"t{i}").over(earlier) % prime).alias(f"before{i}") for i in (0, 1)]).filter("start > 0")
    rows = rows.join(before, ["conv_id", "start"], "left").fillna(0, ["before0", "before1"])
    rows, nodes = _verified(materialise(rows, "trie-rows"), prime)

    parents = nodes.select(F.col("depth").alias("up"), F.col("fp").alias("above"), F.col("label").alias("above_label"), F.col("conv_id").alias("parent_conv_id"))
    upward = nodes.withColumn("up", F.col("depth") - 1)
    up = ["up", "above", "above_label"]
    children = upward.filter("up >= 0").groupBy(*[F.col(c).alias(n) for c, n in zip(up, NODE)]).agg(F.count(F.lit(1)).alias("n_children"))
    tree = upward.join(parents, up, "left").join(children, NODE, "left")
    weight = ((F.col("n_convs") - 1) * F.col("length")).alias("weight")
    tree = materialise(tree.select(*NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), weight), "trie-tree")

    alone = F.coalesce(F.min(F.when(F.col("n_convs") == 1, F.col("depth"))), F.lit(1 << 62)).alias("single")
    chains = tree.groupBy("conv_id").agg(F.sum("weight").alias("weight"), F.count_if(F.col("n_children") == 0).alias("leaves"), alone)
    shares = rows.join(chains.filter("weight > 0 OR leaves > 0"), "conv_id").mapInArrow(_shares(prime), "depth long, fp long, label long, weight long, leaves long")
    totals = shares.groupBy(*NODE).agg(F.sum("weight").alias("all"), F.sum("leaves").alias("n_leaves"))
    shared = tree.filter("n_convs > 1")
    shared = shared.join(totals, NODE, "left").join(_above_in_chain(shared), ["conv_id", "depth"])
    saved = F.coalesce("all", F.lit(0)) - F.col("less")
    columns = ["conv_id", *NODE, "parent_conv_id", "n_convs", "n_children"]
    shared = shared.select(*columns, F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), saved.alias("saved_tokens"))
    single = tree.filter("n_convs = 1").select(*columns, F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))

    ends = rows.filter("last").mapInArrow(_ends(prime), "conv_id long, depth long, fp long, label long")
    lists = ends.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_id_lists, "depth long, fp long, label long, low long, ids string")
    hashes = lists.repartition(*NODE).sortWithinPartitions(*NODE, "low").mapInArrow(_hashed, "depth long, fp long, label long, ends_sha256 string")
    out = shared.unionByName(single).join(hashes, NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, *, chunk: int = CHUNK, prime: int = PRIME) -> DataFrame:
    """The prefix trie of the rebuilt conversations of ``conv_id, turn, role, text``; see ``rebuilt`` and ``trie``.

    Turns go by turn, nulls first; of equal turns by role and text as in ``repair.in_order``. Null roles and texts are
    empty. Rows without a conv_id take no part. Texts of any length count whole; repeated rows are turns of their own. Other columns
    are not read. An empty table gives an empty result, without a root.
    """
    ship(conversations.sparkSession)
    return trie(materialise(rebuilt(turns(conversations, chunk)), "trie-rebuilt"), prime=prime)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all of ``conversations``, a row per node. Odd rows and empty tables: as ``conversation_trie`` says."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = f"""
WITH {CRC32_SQL},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS block, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
r AS (SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.block AND t.i <= h
      UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h),
s AS (SELECT conv_id, row_number() OVER w AS depth, text, sha256(string_agg(len(role) || ':' || len(text) || ':' || role || text, '|') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
m AS (SELECT conv_id, 0 AS depth, '' AS text, 'root' AS node, NULL AS above FROM c
      UNION ALL SELECT conv_id, depth, text, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') FROM s),
n AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * any_value(len(text)) AS weight FROM m GROUP BY node),
k AS (SELECT above, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
u AS (SELECT n.node, p.node AS top FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth JOIN m p ON p.conv_id = m.conv_id AND p.depth <= m.depth),
b AS (SELECT top, count(*) FILTER (k.above IS NULL) AS n_leaves, sum(weight) AS saved_tokens FROM u JOIN n USING (node) LEFT JOIN k ON k.above = u.node GROUP BY top),
e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n p ON p.node = n.above LEFT JOIN k ON k.above = n.node JOIN b ON b.top = n.node LEFT JOIN e ON e.node = n.node
"""
