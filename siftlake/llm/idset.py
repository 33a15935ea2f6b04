"""Picking or dropping documents by a set of ids without shuffling the texts of all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log2 of the bits of the broadcast filter, kept in 64-bit words: at most 2**20 rows. It has 8 bits or more for each
#: id up to 8 million ids; more ids make it less selective, and with it more texts are shuffled for the exact test.
LEAST_BITS, MOST_BITS = 16, 26


def filter_bits(ids: int) -> int:
    return 1 << min(MOST_BITS, max(LEAST_BITS, (8 * ids).bit_length()))


def _word(key: Column, bits: int) -> Column:
    return F.shiftright(F.pmod(F.xxhash64(key), F.lit(bits)), 6)


def _bit(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]), (F.pmod(F.xxhash64(key), F.lit(64)) + 1).cast("int"))


def filter_words(ids: DataFrame, bits: int) -> DataFrame:
    """``filter_word, filter_bits`` of the one column of ``ids``."""
    key = F.col(ids.columns[0])
    return ids.select(_word(key, bits).alias("filter_word"), _bit(key).alias("bit")).groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits"))


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``id`` and ``hit``: false only where the doc_id is surely not in ``ids``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    bits = filter_bits(ids.count())
    rows = rows.withColumn("filter_word", _word(F.col("id"), bits)).join(F.broadcast(filter_words(ids, bits)), "filter_word", "left")
    hit = F.coalesce(F.col("filter_bits").bitwiseAND(_bit(F.col("id"))) != 0, F.lit(False))
    return rows.select("row", "id", hit.alias("hit"))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id is in the one column of ``ids``.

    A bitmap of bounded size tells which rows may be meant; only their texts are shuffled for the exact test.
    """
    rows = marked(docs, ids)
    gone = ids.select(F.col(ids.columns[0]).alias("gone"))
    maybe = rows.filter("hit").join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    return rows.filter("NOT hit").select("row.*").unionByName(maybe.select("row.*"))
