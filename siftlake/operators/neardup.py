"""Near-duplicate groups by Hamming distance, and splits and selections that respect them."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.functions.scalars import hamming
from siftlake.operators.components import connected_components
from siftlake.operators.hashes import nearest_among, text_bits, wide_pairs
from siftlake.operators.ordering import range_bucket, with_place
from siftlake.operators.rules import Rule, decide


SIMHASH_BITS = 60


def simhash(docs: DataFrame, *, id_col: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, keep..., hash``: a 60-bit SimHash of the distinct lower-cased blank-separated words, from their MD5.

    A bit is set if it is in more than half of the words' first 15 hex digits. Texts are read once and not shuffled. Null
    texts have no hash and no row. Rows that repeat an id are rows of their own.
    """
    weights = 1 << np.arange(SIMHASH_BITS - 1, -1, -1, dtype=np.int64)
    return text_bits(docs, id_col=id_col, text=text, keep=keep, digest=lambda w: hashlib.md5(w).digest(), bits=SIMHASH_BITS, kind="long", pack=lambda bits: (bits @ weights).tolist())


def banded_pairs(
    hashes: DataFrame, *, bits: int, threshold: int, by: str | None = None, id_col: str = "id", hash_col: str = "hash", together: int = 3
) -> DataFrame:
    """``g, a, b, distance`` of rows of one ``by`` value with ``a < b`` and ``distance <= threshold``: every such pair, once.

    Hashes within the threshold agree in at least ``together`` of ``threshold + together`` bands, so pairs come from
    an equi-join on (group, bands, values) for every choice of so many bands: with 60 bits and a threshold of 3, 20
    keys of 30 bits a row. A pair is reported by its first equal bands only, which needs no distinct.
    """
    bands = threshold + together
    edges = [round(i * bits / bands) for i in range(bands + 1)]

    def band(h: Column, i: int) -> Column:
        return F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    def value(h: Column, chosen: tuple[int, ...]) -> Column:
        joined = F.lit(0).cast("long")
        for i in chosen:
            joined = F.shiftleft(joined, edges[i + 1] - edges[i]).bitwiseOR(band(h, i))
        return joined

    group = F.col(by) if by else F.lit(0)
    rows = hashes.select(group.alias("g"), F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter(F.col("h").isNotNull())
    choices = list(itertools.combinations(range(bands), together))
    keys = F.array(*[F.struct(F.lit(sum(1 << i for i in c)).alias("bands"), value(F.col("h"), c).alias("value")) for c in choices])
    rows = rows.select("g", "id", "h", F.inline(keys))
    a, b = rows.alias("a"), rows.alias("b")
    same = F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.bands") == F.col("b.bands")) & (F.col("a.value") == F.col("b.value"))
    xor = F.col("a.h").bitwiseXOR(F.col("b.h"))
    equal = F.lit(0)
    for i in range(bands):
        equal = equal + F.when(band(xor, i) == 0, F.lit(1 << i)).otherwise(F.lit(0))
    rest = equal
    for _ in range(together):
        rest = rest.bitwiseAND(rest - 1)  # without its lowest bit
    first = equal - rest == F.col("a.bands")
    close = hamming(F.col("a.h"), F.col("b.h")) <= threshold
    # Spark would take the size of the table without its keys for the size with them, and broadcast it.
    joined = a.join(b.hint("merge"), same & (F.col("a.id") < F.col("b.id")) & close & first)
    return joined.select(F.col("a.g").alias("g"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), hamming(F.col("a.h"), F.col("b.h")).alias("distance"))


def class_pairs(hashes: DataFrame, *, bits: int, threshold: int, by: str) -> tuple[DataFrame, DataFrame]:
    """Classes ``g, h, rep, n`` of rows with equal hashes in one ``by`` value, and the close pairs among their ``rep``."""
    rows = hashes.select("id", F.col(by).alias("g"), F.col("hash").alias("h")).filter("h IS NOT NULL")
    classes = materialise(rows.groupBy("g", "h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    pairs = banded_pairs(classes, bits=bits, threshold=threshold, by="g", id_col="rep", hash_col="h")
    return classes, materialise(pairs, "class-pairs")


def class_components(hashes: DataFrame, *, bits: int, threshold: int, by: str) -> DataFrame:
    """``id, component, nearest`` of all rows: as ``components`` of all close pairs, and the least distance to another row.

    Rows of one ``by`` value with equal hashes are one class, stood for by its smallest id; only classes are paired,
    so many copies make no pairs among themselves. Rows without a hash are groups of their own.
    """
    rows = hashes.select("id", F.col(by).alias("g"), F.col("hash").alias("h"))
    classes, pairs = class_pairs(hashes, bits=bits, threshold=threshold, by=by)
    ends = pairs.select(F.col("a").alias("end"), "distance").unionByName(pairs.select(F.col("b").alias("end"), "distance"))
    least = ends.groupBy("end").agg(F.min("distance").alias("least"))
    labels = components(classes.select(F.col("rep").alias("id")), pairs).withColumnRenamed("id", "root")
    known = classes.join(labels, F.col("rep") == F.col("root")).join(least, F.col("rep") == F.col("end"), "left")
    nearest = F.when(F.col("n") > 1, F.lit(0)).otherwise(F.col("least"))
    known = known.select(F.col("g").alias("class_g"), F.col("h").alias("class_h"), "component", nearest.alias("nearest"))
    joined = rows.join(known, F.col("g").eqNullSafe(F.col("class_g")) & (F.col("h") == F.col("class_h")), "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"), "nearest")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of all ``nodes(id)`` under ``edges(a, b)``."""
    joined = nodes.select("id").join(connected_components(edges.select("a", "b")), F.col("id") == F.col("node"), "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"))


def groups(hashes: DataFrame, pairs: DataFrame, *, id_col: str = "id") -> DataFrame:
    """``id, group_id, nearest, group_size``: groups numbered by their smallest member, nearest distance or null."""
    members = components(hashes.select(F.col(id_col).alias("id")), pairs)
    ends = pairs.select(F.col("a").alias("end"), "distance").unionByName(pairs.select(F.col("b").alias("end"), "distance"))
    nearest = ends.groupBy("end").agg(F.min("distance").alias("nearest"))
    return numbered(members.join(nearest, F.col("id") == F.col("end"), "left").drop("end"))


def numbered(members: DataFrame) -> DataFrame:
    """``id, component, group_id, nearest, group_size`` of ``id, component, nearest``."""
    roots = members.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    places = with_place(roots, by=[], bucket=range_bucket(F.col("component")), order=[F.col("component")], name="group_id")
    return members.join(places, "component").select("id", "component", "group_id", "nearest", "group_size")


def group_safe_split(rows: DataFrame, *, group: str, split: str, held: str = "test") -> DataFrame:
    """Every row of a group with a held-out member is held out; ``moved`` marks those that were not."""
    touched = rows.filter(F.col(split) == held).select(F.col(group).alias("held_group")).distinct().withColumn("touched", F.lit(True))
    joined = rows.join(touched, F.col(group) == F.col("held_group"), "left").drop("held_group")
    final = F.when(F.col("touched"), F.lit(held)).otherwise(F.col(split))
    return joined.withColumn("final_split", final).withColumn("moved", F.col("final_split") != F.col(split)).drop("touched")


#: Conflicts of a component up to which one task decides it, reading them one by one.
CONFLICTS = 1_000_000


def _refused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by component, b and a: ``b`` is refused if some ``a`` is not. Only a component's refused ids are held."""
    component, refused, at, blocked = None, set(), None, False
    for batch in batches:
        out = []
        for c, a, b in zip(*(batch.column(n).to_pylist() for n in ("component", "a", "b"))):
            if c != component:
                component, refused, at = c, set(), None
            if b != at:
                at, blocked = b, False
            if not blocked and a not in refused:
                blocked = True
                refused.add(b)
                out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])


def greedy_accept(rows: DataFrame, conflicts: DataFrame, *, most: int = CONFLICTS) -> DataFrame:
    """Order-dependent dedup without a pass over all rows: ``id, accepted``.

    ``rows`` has ``id`` (unique whole numbers) and ``eligible`` (passed every other rule); a row is accepted if it is
    eligible and no accepted row with a smaller id conflicts with it. ``conflicts`` has ``a < b``. Rows that no chain
    of conflicts connects do not matter to each other, so each component of conflicts is decided by itself: those of
    up to ``most`` conflicts in order by one task, larger ones by stretches of so many, see ``_refused_in_stretches``.
    """
    ship(rows.sparkSession)
    able = rows.filter("eligible").select("id")
    edges = conflicts.select("a", "b").join(able.withColumnRenamed("id", "a"), "a", "left_semi")
    edges = materialise(edges.join(able.withColumnRenamed("id", "b"), "b", "left_semi"), "conflicts")
    labels = connected_components(edges)
    edges = edges.join(labels, F.col("b") == F.col("node")).select("component", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    sizes = edges.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    edges = materialise(edges.join(sizes, "component"), "conflicts-by-component")
    small = edges.filter(F.col("size") <= most).drop("size").repartition("component").sortWithinPartitions("component", "b", "a")
    refused = materialise(small.mapInArrow(_refused, "id long"), "refused")
    large = edges.filter(F.col("size") > most).drop("size")
    if not large.isEmpty():
        refused = refused.unionByName(_refused_in_stretches(large, most))
    kept = able.join(refused.distinct(), "id", "left_anti").withColumn("accepted", F.lit(True))
    return rows.select("id").join(kept, "id", "left").select("id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide rows in order as far as the edges at hand allow.

    Edges ``component, v, q, b, known`` come sorted by component and b; ``b`` is refused if ``v`` is accepted (``q``) or
    is refused (not ``q``). ``known`` says what ``v`` is, if that is known. What one edge decides alone is ``v`` or its
    opposite and is put in its place. Out come decisions, or the edges that are left of a ``b``.
    """
    component, value, at, left, refused = None, {}, None, set(), False

    def close() -> list[tuple]:
        if at is None:
            return []
        if refused or any((v, not q) in left for v, q in left):
            value[at] = False
        elif not left:
            value[at] = True
        elif len(left) == 1:
            (v, q), *_ = left
            value[at] = (v, not q)
        decided = value.get(at)
        return [(component, at, decided, None, None)] if isinstance(decided, bool) else [(component, at, None, v, q) for v, q in left]

    for batch in batches:
        out = []
        for c, v, q, b, known in zip(*(batch.column(n).to_pylist() for n in ("component", "v", "q", "b", "known"))):
            if (c, b) != (component, at):
                out += close()
                value = value if c == component else {}
                component, at, left, refused = c, b, set(), False
            if not refused:
                known = value.get(v) if known is None else known
                if known is None:
                    left.add((v, q))
                elif isinstance(known, tuple):
                    left.add((known[0], known[1] == q))
                else:
                    refused = known == q
        yield _settled(out)
    yield _settled(close())


def _settled(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["component", "b", "accepted", "v", "q"])


def _refused_in_stretches(edges: DataFrame, most: int) -> DataFrame:
    """``id`` of the refused ones of ``component, a, b``, decided by stretches of about ``most`` edges.

    All stretches are decided at once as far as they can be without each other. What depends on one row of another stretch is
    that row or its opposite, so the next round has only the rows that others depend on: chains of any length shrink
    by a stretch's length a round. Rows that none depends on wait, and are decided in the end from those that are known.
    """
    rows = edges.select("component", F.col("a").alias("v"), F.lit(True).alias("q"), "b")
    later = edges.select(F.col("b").alias("v")).distinct().withColumn("later", F.lit(True))
    rows = rows.join(later, "v", "left").select("component", "v", "q", "b", F.when(F.col("later").isNull(), True).alias("known"))
    rows, decided, waiting = materialise(rows, "stretches"), [], []
    while True:
        parts = max(1, -(-rows.count() // most))
        order = ["component", "b"]
        out = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_settle, "component long, b long, accepted boolean, v long, q boolean")
        out = materialise(out, "settled")
        decided.append(out.filter("accepted IS NOT NULL").select("b", "accepted"))
        open_ = out.filter("accepted IS NULL")
        if open_.isEmpty():
            break
        wanted = materialise(open_.select(F.col("v").alias("b")).distinct(), "wanted")
        waiting.append(open_.join(wanted, "b", "left_anti").select("b", "v", "q"))
        known = decided[-1].select(F.col("b").alias("v"), F.col("accepted").alias("known"))
        rows = materialise(open_.join(wanted, "b", "left_semi").join(known, "v", "left").select("component", "v", "q", "b", "known"), "stretches")
    known = decided[0]
    for more in decided[1:]:
        known = known.unionByName(more)
    for rest in reversed(waiting):
        known = materialise(known, "decided")
        hit = rest.join(known.select(F.col("b").alias("v"), "accepted"), "v").groupBy("b").agg((~F.max(F.col("accepted") == F.col("q"))).alias("accepted"))
        known = known.unionByName(hit)
    return known.filter("NOT accepted").select(F.col("b").alias("id"))


def greedy_dedupe(rows: DataFrame, hashes: DataFrame, *, bits: int, threshold: int, by: str) -> DataFrame:
    """``id, accepted`` as ``greedy_accept`` of all close pairs, decided on the first eligible row of each class.

    Whatever blocks the first one is close to the others of its class too, and if it stays it blocks them. Eligible
    rows without a hash stay.
    """
    able = rows.filter("eligible").select("id").join(hashes.select("id", F.col(by).alias("g"), F.col("hash").alias("h")), "id", "left")
    able = materialise(able, "able")
    firsts = materialise(able.filter("h IS NOT NULL").groupBy("g", "h").agg(F.min("id").alias("id")), "firsts")
    pairs = banded_pairs(firsts, bits=bits, threshold=threshold, by="g", hash_col="h")
    decided = greedy_accept(firsts.select("id", F.lit(True).alias("eligible")), pairs).filter("accepted").select("id")
    stays = decided.unionByName(able.filter("h IS NULL").select("id")).withColumn("stays", F.lit(True))
    return rows.select("id").join(stays, "id", "left").select("id", F.coalesce("stays", F.lit(False)).alias("accepted"))


def filter_in_order(rows: DataFrame, rules: Sequence[Rule], *, least: int, score: str = "phash_min_dist") -> DataFrame:
    """``rows`` with ``score``, ``reject_reasons`` and ``passed``, as a pass in order of ``id`` gives them that knows the accepted rows.

    ``rows`` has ``g``, ``id`` (unique whole numbers), ``h`` (a 256-bit hash, or null) and what the rules read. ``score`` is
    the least distance to an earlier row of the same ``g`` that passed every rule (null without one); the rules may refuse a
    row whose score is under ``least``, and no other one by it. So a row joins the state if no other rule refuses it and no earlier one of
    the state is that near, which is decided on the conflicts alone; the score of every row, refused ones too, is then
    its distance to the state.
    """
    known = rows.withColumn(score, F.lit(None).cast("int"))
    able = materialise(decide(known, rules).filter("passed").select("g", "id", "h"), "filter-able")
    firsts = materialise(able.filter("h IS NOT NULL").groupBy("g", "h").agg(F.min("id").alias("id")), "filter-firsts")
    conflicts = wide_pairs(firsts, threshold=least - 1)
    state = greedy_accept(firsts.select("id", F.lit(True).alias("eligible")), conflicts).filter("accepted").select("id")
    state = materialise(firsts.join(state, "id", "left_semi"), "filter-state")
    near = nearest_among(rows.filter("h IS NOT NULL"), state, earlier=True).select(F.col("id").alias("near_id"), F.col("nearest").cast("int").alias(score))
    return decide(rows.join(near, F.col("id") == F.col("near_id"), "left").drop("near_id"), rules)
