"""Blocklists, provenance joins and canonical digests."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship


def blocked(df: DataFrame, blocklist: DataFrame, key: str) -> DataFrame:
    """Rows whose content hash is on the blocklist; a clean relation has none."""
    return df.join(blocklist.select(key).distinct(), key, "left_semi")


def allowed(df: DataFrame, blocklist: DataFrame, key: str) -> DataFrame:
    return df.join(blocklist.select(key).distinct(), key, "left_anti")


def where_given(df: DataFrame, equal: Mapping[str, object], least: Mapping[str, object]) -> DataFrame:
    """Rows with the given values and at least the given values; a parameter that is None does not filter."""
    for column, value in equal.items():
        df = df if value is None else df.filter(F.col(column) == F.lit(value))
    for column, value in least.items():
        df = df if value is None else df.filter(F.col(column) >= F.lit(value))
    return df


@lru_cache(maxsize=2)
def _automaton(passages: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p in passages:
        found.add_word(p, True)
    found.make_automaton()
    return found


#: Characters of passages that are sent to the workers at once.
PASSAGE_CHARS = 20_000_000


def with_containment(df: DataFrame, text: str, passages: DataFrame, column: str = "contains_passage", *, most: int = PASSAGE_CHARS) -> DataFrame:
    """Whether a text contains one of the passages (the one column of ``passages``); empty and null ones are in no text.

    One pass over each text, whatever the number of passages, if they have ``most`` characters or fewer; more are
    dealt by hash to so many parts, and each part is one pass more, so the list that is sent stays bounded.
    """
    ship(df.sparkSession)
    listed = passages.select(F.col(passages.columns[0]).alias("passage")).filter(F.length("passage") > 0).distinct()
    parts = max(1, -(-(listed.agg(F.sum(F.length("passage"))).first()[0] or 0) // most))
    out = df
    for part in range(parts):
        own = listed if parts == 1 else listed.filter(F.pmod(F.xxhash64("passage"), F.lit(parts)) == part)
        found = _contains(tuple(sorted(r.passage for r in own.collect())))(F.col(text))
        out = out.withColumn(column, found if part == 0 else F.col(column) | found)
        if part < parts - 1:
            out = materialise(out, "containment")
    return out


def _contains(listed: tuple[str, ...]):
    @F.pandas_udf("boolean")
    def contains(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(listed) if listed else None
        for texts in parts:
            yield texts.map(lambda t: bool(automaton and t and next(automaton.iter(t), None) is not None)).astype(bool)

    return contains


def provenance(rows: DataFrame, manifest: DataFrame, *, key: str, manifest_key: str, expected: str, actual: str) -> DataFrame:
    """``rows`` with their manifest entry; a missing entry or another content hash is an error when read."""
    entry = manifest.withColumn("in_manifest", F.lit(True))
    joined = rows.join(entry, rows[key] == entry[manifest_key], "left")
    ok = F.col("in_manifest").isNotNull() & rows[expected].eqNullSafe(entry[actual])
    message = F.concat(F.lit("no matching manifest entry for "), rows[key].cast("string"))
    checked = F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return joined.withColumn("in_manifest", checked).filter("in_manifest").drop("in_manifest")


def relation_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A digest of each group as a multiset of rows, and its count; the order of rows does not matter.

    Row hashes are added as 60-bit numbers from both ends of their SHA-256, so groups of any size combine
    before they are shuffled.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    low = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(row, 50, 15), 16, 10).cast("decimal(38,0)")
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(low).alias("a"), F.sum(high).alias("b"))
    return sums.select(*by, "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))


def merged_pool(pools: DataFrame, *, key: str, origin: str) -> DataFrame:
    """One row for each key of several pools; a key of two origins is an error when read."""
    rows = pools.groupBy(key).agg(F.count_distinct(origin).alias("n_origins"), F.min(origin).alias(origin), F.count(F.lit(1)).alias("n_pools"))
    checked = F.when(F.col("n_origins") == 1, F.col("n_pools")).otherwise(F.raise_error(F.concat(F.lit("two origins for "), F.col(key).cast("string"))).cast("bigint"))
    return rows.withColumn("n_pools", checked).drop("n_origins")
