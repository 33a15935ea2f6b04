"""SimHash near duplicates, with candidates from the pigeonring principle.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most three bits, then
from some segment on every chain of consecutive segments stays within its share of the budget: the first
segment is equal (at most 3/4), the first two differ in at most one bit (6/4), three in at most two (9/4), all
four in at most three. Fingerprints are matched on the chain of two (32 equal bits, or all but one of them),
the chains of three and four are checked on the matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.llm.held import release
from siftlake.operators.components import connected_components

SEED, SHINGLE, BUDGET = 42, 3, 3
#: Rows of a key that one task compares; keys with more are dealt over pairs of blocks. Keys of up to ``SMALL`` rows
#: are compared together, some ``AT_ONCE`` rows at a time.
BLOCK, SMALL, AT_ONCE = 4096, 512, 50_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; of a shorter text that of all its words; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(width)))
    return np.fromiter((digest(b" ".join(s), SEED) for s in runs), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles; 0 without words."""
    hashes = shingle_hashes(text, SHINGLE)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: every row's fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each ring position a row to be found, and rows that look for keys with one zero bit set.

    Of two fingerprints whose second segments differ in one bit, one has a zero there, so each pair is met once.
    """
    bits = np.arange(16, dtype=np.uint64)
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        rows = np.arange(len(fp))
        keys, who, seeks = [], [], []
        for i in range(4):
            first = (fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)
            second = (fp >> np.uint64(16 * ((i + 1) % 4))) & np.uint64(0xFFFF)
            key = (np.uint64(i) << np.uint64(32)) | (first << np.uint64(16)) | second
            at, bit = np.nonzero((second[:, None] >> bits) & np.uint64(1) == 0)
            keys += [key, key[at] | (np.uint64(1) << bits[bit])]
            who += [rows, at]
            seeks += [np.zeros(len(fp), bool), np.ones(len(at), bool)]
        who = np.concatenate(who)
        columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(seeks))]
        columns += [batch.column("fp").take(pa.array(who)), batch.column("rep").take(pa.array(who))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "seeks", "fp", "rep"])


def linked(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rest of the chain from the key's ring position, then the full check."""
    diff = x ^ y
    start = (key.view(np.uint64) >> np.uint64(32)) * np.uint64(16)
    turned = (diff >> start) | (diff << ((np.uint64(64) - start) & np.uint64(63)))
    three = np.bitwise_count(turned & np.uint64((1 << 48) - 1)) <= 2
    return three & (np.bitwise_count(diff) <= BUDGET)


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """The links that join two parts of ``parent`` so far."""

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


#: Tells of pairs with a common key whether their rows are linked: key, fp and fp.
Test = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _compare(key: np.ndarray, seeks: np.ndarray, fp: np.ndarray, rep: np.ndarray, test: Test) -> list[tuple[int, int]]:
    """All rows of a group against those to be found; a spanning forest of the links, the closest pairs first."""
    parent: dict[int, int] = {}
    kept = []
    found = np.flatnonzero(~seeks)
    most = len(np.unique(rep)) - 1
    for at in range(0, len(found), 128):
        x, y = (m.ravel() for m in np.meshgrid(found[at : at + 128], np.arange(len(key)), indexing="ij"))
        ok = np.flatnonzero(test(key[x], fp[x], fp[y]) & (x != y))
        x, y = x[ok], y[ok]
        order = np.argsort(np.bitwise_count(fp[x] ^ fp[y]), kind="stable")
        kept += _forest(rep[x[order]], rep[y[order]], parent)
        if len(kept) == most:
            break
    return kept


def _compare_small(starts: np.ndarray, sizes: np.ndarray, columns: list[np.ndarray], test: Test) -> list[tuple[int, int]]:
    """As ``_compare`` of many groups at once.

    Every row is compared with its group's first one, so that groups with much the same rows give the same links.
    Then rows are compared with those ``d`` places on, for every d, but for pairs that both go with their first one.
    """
    key, seeks, fp, rep = columns
    parent: dict[int, int] = {}
    kept = []

    def link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.flatnonzero(~(seeks[x] & seeks[y]))
        ok = ok[test(key[x[ok]], fp[x[ok]], fp[y[ok]]) & (rep[x[ok]] != rep[y[ok]])]
        x, y = x[ok], y[ok]
        order = np.argsort(np.bitwise_count(fp[x] ^ fp[y]), kind="stable")
        kept.extend(_forest(rep[x[order]], rep[y[order]], parent))
        return y

    group = np.repeat(np.arange(len(starts)), sizes)
    row = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    last = (starts + sizes)[group]
    loose = np.zeros(len(key), bool)
    loose[row] = True
    others = np.flatnonzero(row != starts[group])
    loose[link(starts[group[others]], row[others])] = False
    loose[starts] = False
    left = np.maximum.reduceat(loose[row], np.cumsum(sizes) - sizes) if len(starts) else np.zeros(0, bool)
    row, last = row[left[group]], last[left[group]]  # of groups with loose rows
    for d in range(1, int(sizes.max(initial=0))):
        row, last = (x[row + d < last] for x in (row, last))
        some = row[loose[row] | loose[row + d]]
        link(some, some + d)
    return kept


def _links(batches: Iterator[pa.RecordBatch], test: Test) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and pair of blocks; each such group is compared in full.

    Of the links of a task's rows at hand only a spanning forest goes on, so no link between different parts is lost
    and no group gives more links than it has rows.
    """

    def pairs(columns: list[np.ndarray], last: bool):
        """Links of the complete groups, and the rows of the one that may go on."""
        key, pair, seeks, fp, rep = columns
        fp = fp.view(np.uint64)
        change = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(key)]])
        if not last:
            rest, starts, ends = [c[starts[-1] :] for c in columns], starts[:-1], ends[:-1]
        else:
            rest = None
        links = []
        if len(starts):
            to_find = np.add.reduceat(~seeks[: ends[-1]], starts, dtype=np.int64)
            some = (to_find > 0) & (ends - starts > 1)
            small = some & (ends - starts <= SMALL)
            links = _compare_small(starts[small], (ends - starts)[small], [key, seeks, fp, rep], test)
            for s, e in zip(*(x[some & ~small] for x in (starts, ends))):
                links += _compare(key[s:e], seeks[s:e], fp[s:e], rep[s:e], test)
        return links, rest

    def emit(links) -> pa.RecordBatch:
        a, b = zip(*links)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "pair", "seeks", "fp", "rep")])
        size += batch.num_rows
        if size > AT_ONCE:
            links, rest = pairs([np.concatenate(x) for x in zip(*held)], last=False)
            held, size = [rest], len(rest[0])
            if links:
                yield emit(links)
    if size:
        links, _ = pairs([np.concatenate(x) for x in zip(*held)], last=True)
        if links:
            yield emit(links)


def links(keyed: DataFrame, test: Test, *, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between the ``rep`` ids of ``key, seeks, fp, rep``, as many as keep the components whole.

    Rows that meet under a key are linked if ``test`` says so; of those that seek none is compared with another. A
    key with more than ``block`` rows is cut into blocks, and every pair of its blocks is a group of its own. The
    counts of such keys are joined by size: broadcast only if Spark has seen that they are few.
    """
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = keyed.groupBy("key").count().filter(F.col("count") > block)
    large = materialise(large.select("key", F.ceil(F.col("count") / (block // 2)).cast("int").alias("blocks")), "simhash-large")
    own = F.pmod(F.xxhash64("fp", "seeks", "rep"), F.col("blocks")).cast("int")
    dealt = keyed.join(large, "key", "left").withColumn("own", own)
    dealt = dealt.select("key", pairs_of_blocks(F.col("blocks"), F.col("own")), "seeks", "fp", "rep")
    groups = dealt.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", "rep")
    return groups.mapInArrow(lambda batches: _links(batches, test), "a long, b long")


def pairs_of_blocks(blocks: Column, own: Column) -> Column:
    """``pair``: the pairs of blocks that a row of block ``own`` belongs to; 0 where ``blocks`` is null."""
    others = F.transform(
        F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: x != own),
        lambda x: (F.least(x, own) * blocks + F.greatest(x, own)).cast("long"),
    )
    return F.explode(F.when(blocks.isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)).alias("pair")


def ring_keys(classes: DataFrame) -> DataFrame:
    """``key, seeks, fp, rep``: the keys of the chains of two of 64-bit fingerprints ``fp, rep``."""
    return classes.mapInArrow(_keys, "key long, seeks boolean, fp long, rep long")


def near_components(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    Fingerprints with at most three differing bits are linked; ``component_id`` is the smallest doc_id that links
    reach. Null and empty texts have fingerprint 0, linked like any other. Rows that repeat a doc_id are rows of
    their own; other columns are not read; an empty table gives an empty result. Equal fingerprints are one class from the start, so copies are never compared or paired.
    """
    prints = materialise(fingerprints(docs), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    joined = connected_components(materialise(links(ring_keys(classes.filter("rep IS NOT NULL")), linked), "simhash-links"))
    moved = classes.join(joined, F.col("rep") == F.col("node"), "left")
    moved = materialise(moved.select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-components")
    return prints.join(moved, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all of ``documents``."""
    rows = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
