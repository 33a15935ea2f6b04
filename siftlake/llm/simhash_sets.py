"""SimHash near duplicates of a given set similarity: long fingerprints matched along their ring, sets for the check.

The fingerprint is the SimHash of a text's set of five-word shingles, a ring of segments. Two sets of Jaccard
similarity s differ in a share of about acos(2s / (1 + s)) / pi of its bits, 0.15 for 0.8. The budget allows that
share and four deviations more. By the pigeonring principle, fingerprints within the budget have a place on the
ring from which every chain of consecutive segments stays within its proportional part of it. Texts are matched
where the first two segments of a chain are equal; the following ones are checked on the match, then all bits, and
of each group of texts so linked the whole sets decide, so no dissimilar pair is linked.

Equal segments are more than the principle asks for, so a pair may be missed. ``layout`` takes as many segments as
keep the probability of that near 0.002 at similarity 0.8, less above, and widens them with the number of documents,
so that a key holds some hundred texts by chance at any size.

The share of differing bits is that of large sets; a few shingles scatter more. So every pair with a set of at most
``SMALL`` shingles is found exactly, by a prefix join: with shingles ordered by how many small sets hold them, sets of
similarity s share one of the first n - ceil(s * n) + 1, and those that do are compared in full as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.llm import simhash
from siftlake.llm.held import release
from siftlake.llm.idset import marked, without_ids
from siftlake.operators.components import connected_components

SEED, SHINGLE, SIMILARITY = simhash.SEED, 5, 0.8
SHARE = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Rows of a key that one task compares; keys with more are dealt over pairs of blocks.
BLOCK = 4096
#: The expected number of chains from which a pair at the least similarity is matched, and the bits after the key.
CHAINS, REST = 6.8, 48
#: Sets up to which no pair may be missed, and the size of the largest sets that are similar to those.
SMALL = 30
PARTNERS = math.floor(SMALL / SIMILARITY)


def layout(documents: int) -> tuple[int, int]:
    """Bits of a segment and segments of the ring for a number of documents."""
    width = max(8, math.ceil((math.log2(max(1, documents)) - 8) / 2))
    equal = (1 - SHARE) ** width
    return width, math.ceil(CHAINS / (equal**2 * (1 - equal)) / 8) * 8


def budget(bits: int) -> int:
    return math.floor(bits * SHARE + 4 * math.sqrt(bits * SHARE * (1 - SHARE)))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct word shingles."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits packed in bytes: one where more than half of the shingles have it. Every 64 bits are of another hash."""
    mix = np.random.default_rng(SEED).integers(0, 2**63, (2, -(-bits // 64))).astype(np.uint64) | np.uint64(1)
    ones = np.zeros(mix.shape[1] * 64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of one byte
        x = hashes[at : at + 255, None] * mix[0] + mix[1]
        x ^= x >> np.uint64(32)
        x *= mix[1]
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits((2 * ones > len(hashes))[:bits])


def _class(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _prints(bits: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            fps = [fingerprint(s, bits).tobytes() if len(s) else None for s in sets]
            small = [s.view(np.int64) if 0 < len(s) <= PARTNERS else None for s in sets]
            columns = [batch.column("doc_id"), pa.array([_class(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(small, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "class", "print", "small"])

    return prints


def chain_keys(prints: np.ndarray, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint (a row of bits) a key for each place of the ring, and the ``REST`` bits at most that follow."""
    segments = prints[:, : width * count].reshape(len(prints), count, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
    place = np.arange(count, dtype=np.int64)
    keys = (place << (2 * width)) | (segments << width) | np.roll(segments, -1, axis=1)
    rest = np.zeros_like(segments)
    for i in range(REST // width):
        rest |= np.roll(segments, -2 - i, axis=1) << (i * width)
    return keys, rest


def _keys(width: int, count: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # a few MB of keys at once
                part = batch.slice(at, 500)
                prints = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                found, rest = chain_keys(np.unpackbits(prints, axis=1), width, count)
                columns = [pa.array(found.ravel()), pa.array(np.zeros(found.size, bool)), pa.array(rest.ravel())]
                columns.append(part.column("rep").take(pa.array(np.repeat(np.arange(part.num_rows), count))))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "seeks", "fp", "rep"])

    return keys


def chain_test(width: int, count: int) -> simhash.Test:
    """Whether the chains of three segments and more from a key's place stay within their parts of the budget."""
    part = budget(width * count) / count

    def test(_: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        diff = x ^ y
        ok = np.bitwise_count(diff) <= math.floor((2 + REST // width) * part)
        for i in range(1, REST // width):
            some = np.flatnonzero(ok)
            ok[some] = np.bitwise_count(diff[some] & np.uint64((1 << (i * width)) - 1)) <= math.floor((2 + i) * part)
        return ok

    return test


def _within(bits: int):
    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for n in ("x", "y"))
            near = np.bitwise_count(x ^ y).sum(axis=1) <= budget(bits)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return within


def candidates(classes: DataFrame, width: int, count: int) -> DataFrame:
    """``a, b``: pairs of ``rep`` ids with fingerprints within the budget, as many as keep what is near together."""
    keyed = classes.select("print", "rep").mapInArrow(_keys(width, count), "key long, seeks boolean, fp long, rep long")
    pairs = materialise(simhash.links(keyed, chain_test(width, count)).distinct(), "near-matches")
    both = pairs.join(classes.select(F.col("rep").alias("a"), F.col("print").alias("x")), "a")
    both = both.join(classes.select(F.col("rep").alias("b"), F.col("print").alias("y")), "b")
    return both.mapInArrow(_within(width * count), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("id"), pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "hashes"])


def compare(reps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among a group's sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat, known = flat.astype(np.int32), len(known)
    part, mark, kept = np.arange(len(sets)), np.zeros(known, bool), []
    for i in range(len(sets)):
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        # in whole numbers: both / union >= 0.8
        linked = np.flatnonzero((10 * both >= round(10 * SIMILARITY) * (sizes + sizes[i] - both)) & (part != part[i]))
        if len(linked):
            parts, first = np.unique(part[linked], return_index=True)
            kept += [(int(reps[i]), int(reps[j])) for j in linked[first]]
            part[np.isin(part, parts)] = part[i]
            if (part == part[0]).all():
                break
    return kept


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and pair of blocks; each such group is compared in full."""

    def emit(reps: list[int], sets: list[bytes]) -> Iterator[pa.RecordBatch]:
        links = compare(np.array(reps), [np.frombuffer(s, np.uint64) for s in sets]) if len(reps) > 1 else []
        sets.clear()
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    group, reps, sets = None, [], []
    for batch in batches:
        for key, pair, rep, hashes in zip(*(batch.column(n).to_pylist() for n in ("key", "pair", "rep", "hashes"))):
            if (key, pair) != group:
                yield from emit(reps, sets)
                group, reps, sets = (key, pair), [], []
            reps.append(rep)
            sets.append(hashes)
    yield from emit(reps, sets)


def links(docs: DataFrame, classes: DataFrame, groups: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between the ``rep`` ids of ``class, rep``, as many as keep the components whole.

    Members of a group (``node, component``, its smallest node not listed) are compared in full. Only their sets are read again. A group with
    more than ``block`` members is cut into blocks, and every pair of its blocks is a group of its own.
    """
    sizes = groups.groupBy(F.col("component").alias("key")).agg((F.count(F.lit(1)) + 1).alias("n"))
    members = groups.select(F.col("node").alias("rep"), F.col("component").alias("key")).unionByName(sizes.select(F.col("key").alias("rep"), "key"))
    found = members.join(sizes, "key").join(classes.select("rep", "class"), "rep")
    found = materialise(found, "near-members")
    rows = marked(docs, found.select("rep")).filter("hit").select("id", F.col("row.text").alias("text"))
    sets = rows.mapInArrow(_sets, "id long, class long, hashes binary").groupBy("class", F.col("id").alias("rep")).agg(F.first("hashes").alias("hashes"))
    return _compared(found, sets, ["class", "rep"], block)


def _compared(members: DataFrame, sets: DataFrame, by: list[str], block: int) -> DataFrame:
    """``a, b``: links among the ``rep`` of each ``key``, which has about ``n`` of them; ``sets`` has their ``hashes``."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("n") / (block // 2)).cast("int")
    dealt = members.withColumn("blocks", F.when(F.col("n") > block, blocks)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select(*by, "key", simhash.pairs_of_blocks(F.col("blocks"), F.col("own")))
    dealt = dealt.join(sets, by).select("key", "pair", "rep", "hashes")
    return dealt.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_links, "a long, b long")


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.array(s, np.int64).tobytes() for s in batch.column("small").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "hashes"])


def small_links(classes: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between the ``rep`` of small sets (``rep, small``), exact; as many as keep the components whole."""
    rows = classes.filter("rep IS NOT NULL AND small IS NOT NULL").select("rep", "small")
    held = rows.select("rep", F.size("small").alias("size"), F.explode("small").alias("token"))
    uses = held.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")  # others are in no two sets
    ordered = held.join(uses, "token").groupBy("rep", "size").agg(F.sort_array(F.collect_list(F.struct("uses", "token"))).alias("tokens"))
    prefix = F.expr(f"size - (size * {round(10 * SIMILARITY)} + 9) div 10 + 1 - (size - size(tokens))")  # those in one set come first
    keys = ordered.withColumn("take", prefix.cast("int")).filter("take > 0").select("rep", F.inline(F.slice("tokens", 1, F.col("take"))))
    members = materialise(keys.select("rep", F.col("token").alias("key"), F.col("uses").alias("n")), "near-small")
    return _compared(members, rows.mapInArrow(_bytes, "rep long, hashes binary"), ["rep"], block)


def near_components(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, component_id``, the smallest doc_id that links reach.

    Texts are linked whose sets of five-word shingles have a Jaccard similarity of at least 0.8. Texts with the same
    set are one class, those without words too (null, empty and blank ones). Rows that repeat a doc_id are rows of
    their own; a null doc_id is a group by itself unless its text is in a class. Other columns are not read. An empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width, count = layout(docs.count())
    prints = materialise(rows.mapInArrow(_prints(width * count), "doc_id long, class long, print binary, small array<long>"), "near-prints")
    classes = materialise(prints.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("print").alias("print"), F.first("small").alias("small")), "near-classes")
    matched = candidates(classes.filter("rep IS NOT NULL AND print IS NOT NULL"), width, count)
    groups = connected_components(materialise(matched, "near-candidates"))
    found = links(docs, classes, groups, block=block).unionByName(small_links(classes, block=block))
    joined = connected_components(materialise(found, "near-links"))
    moved = classes.select("class", "rep").join(joined, F.col("rep") == F.col("node"), "left")
    moved = materialise(moved.select("class", F.coalesce("component", "rep").alias("component_id")), "near-components")
    return prints.select("doc_id", "class").join(moved, "class").select("doc_id", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that with the smallest doc_id."""
    others = near_components(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return without_ids(docs, materialise(others, "near-dropped"))
