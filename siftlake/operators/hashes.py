"""Hashes of 256 bits: making them in one pass, close pairs, and the nearest other row of every row.

A hash is an array of four longs. Close pairs and nearest rows come from all pairs of a group, in cells (see ``cells``): the differing bits of
three rows with another one are counted by one product of matrices. Where near rows are common, radii can be given: hashes within a radius r
agree in one of r + 1 bands or more, so an equi-join on the values of 4, 8, 16 or 32 bands finds them, from round to round for the rows only
that have none yet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.functions.scalars import hamming_words
from siftlake.operators.cells import cells, compared

WORDS, WORD = 4, 64
BITS = WORDS * WORD
#: Radii of the rounds (none: most rows have no row that near); numbers of bands that lie within words; rows of a block.
RADII, BANDS, BLOCK = (), (4, 8, 16, 32), 2048
#: Bytes of text whose words are looked up at once; words whose set bits fit a byte; words unpacked to bits at once.
AT_ONCE, RUN, UNPACKED = 1 << 21, 255, 1 << 15
#: Rows in one number; rows and columns of a tile; tiles' rows that are held packed; columns of which the least is taken first; more than
#: half of any distance.
PACK, TILE, PACKED, FOLD, FAR = 3, (1152, 1024), 10, 8, 255


def majority_bits(texts: pa.Array, digest: Callable[[bytes], bytes], bits: int) -> np.ndarray:
    """A row of bits for each text: set in more than half of its distinct blank-separated words' digests, from their start."""
    words = pc.split_pattern(texts, pattern=" ")
    coded = words.values.dictionary_encode()
    count, width = len(coded.dictionary), -(-bits // 8)
    keys = np.sort(np.repeat(np.arange(len(texts)) * count, np.diff(words.offsets.to_numpy())) + coded.indices.to_numpy())
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    sizes, which = np.bincount(keys // count, minlength=len(texts)), keys % count
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    table = np.frombuffer(b"".join([digest(w)[:width] for w in distinct]), np.uint8).reshape(count, width)
    runs = -(-sizes // RUN)
    first = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(sizes) - sizes - first * RUN, runs) + np.arange(runs.sum()) * RUN
    edges, sums, step = np.append(starts, len(which)), np.empty((len(starts), width * 8), np.uint8), UNPACKED // RUN
    for at in range(0, len(starts), step):
        to = min(at + step, len(starts))
        ones = np.unpackbits(table[which[edges[at] : edges[to]]], axis=1).view(np.uint64)  # sums of a run's bytes do not carry
        sums[at:to] = np.add.reduceat(ones, starts[at:to] - starts[at], axis=0).view(np.uint8)
    return 2 * np.add.reduceat(sums, first, axis=0, dtype=np.int32)[:, :bits] > sizes[:, None]


def text_bits(docs: DataFrame, *, id_col: str, text: str, keep: tuple[str, ...], digest: Callable[[bytes], bytes], bits: int, kind: str, pack: Callable[[np.ndarray], list]) -> DataFrame:
    """``id, keep..., hash`` of the lower-cased texts, in one pass without a shuffle; null texts have no row."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), *keep, F.lower(text).alias("hashed_text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column("hashed_text")).to_numpy(), dtype=np.int64) // AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
            for at, to in zip(edges, edges[1:]):
                if at == to:
                    continue
                part = batch.slice(at, to - at)
                found = pack(majority_bits(part.column("hashed_text"), digest, bits))
                columns = [part.column(c) for c in ("id", *keep)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=["id", *keep, "hash"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in ("id", *keep)) + f", hash {kind}")


def as_words(bits: np.ndarray) -> list:
    """Rows of bits as lists of signed 64-bit words, the first bit the highest."""
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).tolist()


def wide_simhash(docs: DataFrame, *, id_col: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, keep..., hash``: 256-bit SimHash of the distinct lower-cased words, from their SHA-256, as four longs."""
    return text_bits(docs, id_col=id_col, text=text, keep=keep, digest=lambda w: hashlib.sha256(w).digest(), bits=BITS, kind="array<long>", pack=as_words)


def band_keys(words: Column, bands: int) -> Column:
    """The values of the hash's bands, in order."""
    width = BITS // bands
    out = []
    for i in range(bands):
        shifted = F.shiftrightunsigned(F.get(words, F.lit(i * width // WORD)), WORD - width - i * width % WORD)
        out.append(shifted if width == WORD else shifted.bitwiseAND(F.lit((1 << width) - 1)))
    return F.array(*out)


def _met(left: DataFrame, right: DataFrame, radius: int, which: str) -> DataFrame:
    """``g, a, b, distance``: rows ``g, id, h`` of both sides within the radius, each pair once, at its first equal band.

    ``which`` rows of the right a row meets: ``other``, ``later`` or ``earlier`` ones by id.
    """
    bands = next(b for b in BANDS if b > radius)
    keyed = [df.select("g", "id", "h", band_keys(F.col("h"), bands).alias("keys")).select("g", "id", "h", "keys", F.posexplode("keys").alias("band", "value")) for df in (left, right)]
    a, b = keyed[0].alias("a"), keyed[1].alias("b")
    same = F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value"))
    other = {"other": F.col("a.id") != F.col("b.id"), "later": F.col("a.id") < F.col("b.id"), "earlier": F.col("a.id") > F.col("b.id")}[which]
    equal = F.array_position(F.zip_with("a.keys", "b.keys", lambda x, y: x == y), F.lit(True)) - 1
    d = hamming_words(F.col("a.h"), F.col("b.h"))
    return a.join(b.hint("merge"), same & other & (equal == F.col("a.band")) & (d <= radius)).select(F.col("a.g").alias("g"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.alias("distance"))


def wide_classes(hashes: DataFrame, by: str) -> DataFrame:
    """``g, h, id, n``: classes of equal hashes of one ``by`` value, with their smallest id and size."""
    rows = hashes.select(F.col(by).alias("g"), F.col("hash").alias("h"), "id").filter("h IS NOT NULL")
    return materialise(rows.groupBy("g", "h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "wide-classes")


def _by_parity(side: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and words, those with an even number of set bits first, and how many these are."""
    odd = np.bitwise_count(side["h"].view(np.uint64)).sum(axis=1) % 2
    order = np.argsort(odd, kind="stable")
    return side["id"][order], np.ascontiguousarray(side["h"][order]), int(len(odd) - odd.sum())


def _pieces(even: int, n: int, step: int) -> list[tuple[int, int, int]]:
    """Stretches of at most ``step`` rows of one parity: start, end, parity."""
    return [(at, min(at + step, end), odd) for odd, (start, end) in enumerate(((0, even), (even, n))) for at in range(start, end, step)]


def _factors(h: np.ndarray, left: bool) -> np.ndarray:
    """Factors whose products, summed over the columns, are half the differing bits of two rows, rounded up for each that has an odd number of ones.

    That is half the ones of both less the common ones. For the second half of the bits, what only the left has is added instead, so that no
    sum of some of the products exceeds 193.
    """
    ones, out = np.bitwise_count(h.view(np.uint64)), np.empty((len(h), BITS + 2), np.float32)
    out[:, :BITS] = np.unpackbits(h.view(np.uint8), axis=1)
    half, const = (ones.sum(axis=1, dtype=np.int32) + 1) // 2, np.float32(1)
    if left:
        out[:, BITS], out[:, BITS + 1] = half - ones[:, WORDS // 2 :].sum(axis=1, dtype=np.int32), const
    else:
        np.negative(out[:, : BITS // 2], out=out[:, : BITS // 2])
        np.subtract(const, out[:, BITS // 2 : BITS], out=out[:, BITS // 2 : BITS])
        out[:, BITS], out[:, BITS + 1] = const, half
    return out


def _whole(at: int, end: int, step: int) -> np.ndarray:
    """The places of a stretch, the last repeated to a multiple of ``step``."""
    return np.minimum(np.arange(at, at + -(-(end - at) // step) * step), end - 1)


def _packed(h: np.ndarray) -> np.ndarray:
    """The left factors of ``PACK`` rows in one number: their sums stay under 2^24, so they are exact in single precision in any order."""
    parts = _factors(h[_whole(0, len(h), PACK)], True).reshape(PACK, -1, BITS + 2)
    return sum(parts[k] * np.float32(256**k) for k in range(PACK))


def _tiles(x: np.ndarray, x_even: int, y: np.ndarray, y_even: int, wanted: Callable[[int, int, int, int], bool]) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """Halved distances of the wanted tiles of two tables of words by parity: first and end row, first and end column, how many of the
    two parities are odd, and bytes by row modulo m, column and row // m, m the length of the tile; the last byte is none. Rows and columns
    beyond the last repeat it.

    The distance is twice the byte less the odd parities.
    """
    rows, columns = _pieces(x_even, len(x), TILE[0]), _pieces(y_even, len(y), TILE[1])
    product, whole = (np.empty(-(-TILE[0] // PACK) * (TILE[1] + FOLD), kind) for kind in (np.float32, np.int32))
    for at in range(0, len(rows), PACKED):
        held = [(*piece, _packed(x[piece[0] : piece[1]])) for piece in rows[at : at + PACKED]]
        for to, last, q in columns:
            if not any(wanted(a, b, to, last) for a, b, _, _ in held):
                continue
            right = _factors(y[_whole(to, last, FOLD)], False).T
            for a, b, p, left in held:
                if wanted(a, b, to, last):
                    size = len(left) * right.shape[1]
                    np.matmul(left, right, out=product[:size].reshape(len(left), -1))
                    np.copyto(whole[:size], product[:size], casting="unsafe")
                    yield a, b, to, last, p + q, whole[:size].astype("<i4", copy=False).view(np.uint8).reshape(len(left), -1, 4)


def _least_of_rows(tile: np.ndarray) -> np.ndarray:
    flat = tile.reshape(len(tile), FOLD, -1).min(axis=1)
    turned = np.ascontiguousarray(flat.view(np.uint32).T).view(np.uint8)  # least bytes are faster over the first axis
    return turned.min(axis=0).reshape(-1, 4)[:, :PACK].T.reshape(-1)


def _least_of_columns(tile: np.ndarray) -> np.ndarray:
    return tile.reshape(len(tile), -1).min(axis=0).reshape(-1, 4)[:, :PACK].min(axis=1)


def _close(threshold: int | None, nearest: bool, *, both: bool = False, earlier: bool = False):
    """What the cells of a task hold: pairs ``g, a, b, distance`` within the threshold, and rows ``a, distance`` without ``b``, the
    least distance of ``a`` to another row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(g, a, b, d) -> pa.RecordBatch:
            ends = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([g] * len(a), pa.string()), pa.array(a, pa.int64()), ends, pa.array(d, pa.int32())], names=["g", "a", "b", "distance"])

        for cell in compared(batches, ["h"], both=both):
            a, x, x_even = _by_parity(cell.a)
            b, y, y_even = (a, x, x_even) if cell.same else _by_parity(cell.b)
            low = [np.full(len(ids), BITS + 1, np.int16) for ids in (a, b)]
            if cell.same:
                low[1] = low[0]

            def wanted(at: int, end: int, to: int, last: int) -> bool:
                return last > at if cell.same else not earlier or a[end - 1] > b[to]

            for at, end, to, last, odd, tile in _tiles(x, x_even, y, y_even, wanted):
                if (both or cell.same) and a[at] <= b[last - 1] and (earlier or b[to] <= a[end - 1]):  # a piece's ids ascend
                    p, q = a[_whole(at, end, PACK)].reshape(PACK, -1, 1), b[_whole(to, last, FOLD)]
                    for k in range(PACK):
                        tile[:, :, k][p[k] <= q if earlier else p[k] == q] = FAR
                least, limit = _least_of_rows(tile), -1 if threshold is None else (threshold + odd) // 2
                if nearest:
                    np.minimum(low[0][at:end], 2 * least[: end - at].astype(np.int16) - odd, out=low[0][at:end])
                    if not both:
                        np.minimum(low[1][to:last], 2 * _least_of_columns(tile)[: last - to].astype(np.int16) - odd, out=low[1][to:last])
                if least.min() <= limit:
                    packs, columns = np.flatnonzero((least.reshape(PACK, -1) <= limit).any(axis=0)), np.flatnonzero(_least_of_columns(tile) <= limit)
                    near = tile[np.ix_(packs, columns)][:, :, :PACK]
                    i, j, k = np.nonzero(near <= limit)
                    d = 2 * near[i, j, k].astype(np.int32) - odd
                    i, j = at + packs[i] + k * len(tile), to + columns[j]
                    once = (i < end) & (j < last) & (i < j if cell.same else True)
                    i, j, d = a[i[once]], b[j[once]], d[once]
                    yield rows(cell.g, np.minimum(i, j), np.maximum(i, j), d)
            if nearest:
                for ids, least in zip((a, b), low if not both and not cell.same else low[:1]):
                    yield rows(cell.g, ids[least <= BITS], None, least[least <= BITS].astype(np.int32))

    return found


CLOSE = "g string, a long, b long, distance int"


def wide_pairs(classes: DataFrame, *, threshold: int) -> DataFrame:
    """``g, a, b, distance`` of the classes' ids with ``a < b`` and a distance of at most ``threshold``, from all pairs of a group.

    Bands are not used, as hashes of few different values share too many of them.
    """
    ship(classes.sparkSession)
    rows = classes.select(F.col("g").cast("string").alias("g"), F.col("id").cast("long").alias("id"), "h")
    return cells(rows, None, ["h"]).mapInArrow(_close(threshold, False), CLOSE)


def nearest_among(rows: DataFrame, others: DataFrame, *, earlier: bool = False, radii: tuple[int, ...] = RADII, block: int = BLOCK) -> DataFrame:
    """``id, nearest``: the least distance of a row ``g, id, h`` to one of the others of its ``g``, but for itself.

    ``earlier`` looks at those of smaller id only. Rows without any have none here. Each round joins the rows without a
    neighbour yet with the others, within a wider radius; a row that has one within it is done, as no nearer one
    can be outside. The rest meets all in cells.
    """
    ship(rows.sparkSession)
    open_, found = rows.select("g", "id", "h"), []
    for radius in radii:
        met = _met(open_, others, radius, "earlier" if earlier else "other")
        near = materialise(met.groupBy(F.col("a").alias("id")).agg(F.min("distance").alias("nearest")), "wide-near")
        found.append(near)
        open_ = materialise(open_.join(near.select("id"), "id", "left_anti").select("g", "id", "h"), "wide-open")
        if open_.isEmpty():
            break
    else:
        left, right = (df.select(F.col("g").cast("string").alias("g"), F.col("id").cast("long").alias("id"), "h") for df in (open_, others))
        met = cells(left, right, ["h"], one=block).mapInArrow(_close(None, True, both=True, earlier=earlier), CLOSE)
        rest = met.select(F.col("a").alias("id"), F.col("distance").alias("nearest"))
        found.append(rest.groupBy("id").agg(F.min("nearest").alias("nearest")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def wide_nearest(classes: DataFrame, *, radii: tuple[int, ...] = RADII, block: int = BLOCK) -> DataFrame:
    """``id, nearest``: the least distance from a class to another class of its ``g``; none without another class."""
    return nearest_among(classes, classes, radii=radii, block=block)


def wide_groups(hashes: DataFrame, *, threshold: int, by: str, radii: tuple[int, ...] = RADII) -> DataFrame:
    """``id, component, nearest`` of all rows: groups linked within the threshold, and the least distance to another row.

    Rows that share a hash have 0; a row alone in its ``by`` value, or without a hash, has null. ``component`` is the smallest id.
    """
    from siftlake.operators.neardup import components

    classes = wide_classes(hashes, by)
    if radii:
        pairs, nearest = materialise(wide_pairs(classes, threshold=threshold), "wide-pairs"), wide_nearest(classes, radii=radii)
    else:  # one pass over all pairs tells both
        rows = classes.select(F.col("g").cast("string").alias("g"), F.col("id").cast("long").alias("id"), "h")
        met = materialise(cells(rows, None, ["h"]).mapInArrow(_close(threshold, True), CLOSE), "wide-close")
        pairs = met.filter("b IS NOT NULL")
        nearest = met.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.min("distance").alias("nearest"))
    labels = components(classes.select("id"), pairs).withColumnRenamed("id", "rep")
    nearest = nearest.withColumnRenamed("id", "near_id")
    known = classes.join(labels, F.col("id") == F.col("rep")).join(nearest, F.col("id") == F.col("near_id"), "left")
    least = F.when(F.col("n") > 1, F.lit(0)).otherwise(F.col("nearest"))
    known = known.select(F.col("g").alias("class_g"), F.col("h").alias("class_h"), "component", least.alias("nearest"))
    rows = hashes.select("id", F.col(by).alias("g"), F.col("hash").alias("h"))
    joined = rows.join(known, F.col("g").eqNullSafe(F.col("class_g")) & (F.col("h") == F.col("class_h")), "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"), "nearest")
