"""Exact quantiles of groups of any size: selection on the ordered bits of doubles by counts.

No aggregate holds a group's values. Rounds look at more and more leading bits: values are counted by group and leading bits,
which combines before the shuffle, and a wanted rank goes on with the one bin that it falls in. A bin of few values is read
out and sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise

#: Low bits that a round leaves out, and values up to which a bin is read out.
SHIFTS, SMALL = (52, 40, 28, 16, 4, 0), 20_000
_STEP, _LEAST, _MOST = float(1 << 52), -1022, 1023


def ordered_bits(x: Column) -> Column:
    """A long that is ordered as the double is, equal for equal ones; both zeros are 0, NaN comes after infinity."""
    a = F.when((F.abs(x) > 0) & (F.abs(x) < float("inf")), F.abs(x))
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(_LEAST)), F.lit(_MOST))
    power = F.pow(F.lit(2.0), guess)  # of two whole numbers, so exact; the logarithm may be off by one
    exponent = F.greatest(F.when(a < power, guess - 1).when(a / 2 >= power, guess + 1).otherwise(guess), F.lit(_LEAST))
    bits = (exponent - _LEAST) * (1 << 52) + (a / F.pow(F.lit(2.0), exponent) * _STEP).cast("long")
    top = F.lit((_MOST - _LEAST + 2) * (1 << 52))
    key = F.when(F.isnan(x), top + 1).when(F.abs(x) == float("inf"), top).when(x == 0, F.lit(0)).otherwise(bits)
    return F.when((x < 0) & ~F.isnan(x), -key).otherwise(key)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null key equals a null key."""
    other = right.withColumnsRenamed({k: f"q_other_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"q_other_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"q_other_{k}" for k in keys])


def group_quantiles(df: DataFrame, *, by: Sequence[str], values: Mapping[str, Column], at: Mapping[str, float], small: int = SMALL) -> DataFrame:
    """``by..., <value>_<label>``: linear quantiles of every value at every share; with the name ``""`` the label alone.

    A quantile at share q of n values is at place q * (n - 1) in their order, between two values in proportion. Nulls are left
    out; a value of which a group has none has null quantiles, and a group without rows has no row. A null key is a group.
    NaN counts as the largest value. Values are taken as doubles.
    """
    if any(not 0 <= q <= 1 for q in at.values()):
        raise ValueError(f"shares outside 0 to 1: {dict(at)}")
    names = {f"q_by{i}": c for i, c in enumerate(by)}
    keys = [*names, "q_what"]
    pairs = F.array(*[F.struct(F.lit(n).alias("q_what"), c.cast("double").alias("q_x")) for n, c in values.items()])
    rows = df.select(*[F.col(c).alias(n) for n, c in names.items()], F.inline(pairs))
    rows = materialise(rows.withColumn("q_key", ordered_bits(F.col("q_x"))), "quantile-values")

    sizes = materialise(rows.groupBy(*keys).agg(F.count("q_x").alias("q_n")), "quantile-sizes")
    place = F.col("q_share") * (F.col("q_n") - 1)
    shares = F.array(*[F.struct(F.lit(label).alias("q_label"), F.lit(float(q)).alias("q_share")) for label, q in at.items()])
    wanted = sizes.filter("q_n > 0").select(*keys, "q_n", F.inline(shares)).withColumn("q_place", place)
    ends = F.array(F.floor("q_place"), F.ceil("q_place"))
    ranks = wanted.select(*keys, F.explode(ends).alias("q_rank"), "q_n").distinct()
    state = ranks.select(*keys, "q_rank", F.col("q_rank").alias("q_left"), F.lit(0).cast("long").alias("q_bin"), F.col("q_n").alias("q_size"))
    rows = rows.filter("q_x IS NOT NULL")

    found, before = [], None
    for shift in (*SHIFTS, None):
        bin_at = F.lit(0).cast("long") if before is None else F.shiftright("q_key", before)
        binned = rows.withColumn("q_bin", bin_at)
        few = state.filter((F.col("q_size") <= small) | F.lit(shift is None))
        bins = few.select(*keys, "q_bin").distinct()
        if shift is None:  # all values of a bin are equal
            read = _joined(binned, bins, [*keys, "q_bin"]).groupBy(*keys, "q_bin").agg(F.min("q_x").alias("q_value"))
            found.append(_joined(few, read, [*keys, "q_bin"]).select(*keys, "q_rank", "q_value"))
            break
        read = _joined(binned, bins, [*keys, "q_bin"]).groupBy(*keys, "q_bin").agg(F.sort_array(F.collect_list("q_x")).alias("q_sorted"))
        value = F.get("q_sorted", F.col("q_left").cast("int")).alias("q_value")
        found.append(_joined(few, read, [*keys, "q_bin"]).select(*keys, "q_rank", value))
        state = state.filter(F.col("q_size") > small)
        if state.isEmpty():
            break
        open_ = state.select(*keys, "q_bin").distinct()
        counts = _joined(binned, open_, [*keys, "q_bin"]).groupBy(*keys, "q_bin", F.shiftright("q_key", shift).alias("q_next")).agg(F.count(F.lit(1)).alias("q_count"))
        earlier = Window.partitionBy(*keys, "q_bin").orderBy("q_next").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("q_below", F.coalesce(F.sum("q_count").over(earlier), F.lit(0)))
        inside = (F.col("q_left") >= F.col("q_below")) & (F.col("q_left") < F.col("q_below") + F.col("q_count"))
        state = _joined(state, counts, [*keys, "q_bin"]).filter(inside)
        state = state.select(*keys, "q_rank", (F.col("q_left") - F.col("q_below")).alias("q_left"), F.col("q_next").alias("q_bin"), F.col("q_count").alias("q_size"))
        state, before = materialise(state, "quantile-ranks"), shift

    ends = wanted.select(*keys, "q_label", "q_place", F.explode(F.array(F.floor("q_place"), F.ceil("q_place"))).alias("q_rank"))
    met = _joined(ends, reduce(DataFrame.unionByName, found), [*keys, "q_rank"]).groupBy(*keys, "q_label", "q_place")
    met = met.agg(F.min("q_value").alias("q_low"), F.max("q_value").alias("q_high"))
    between = (F.ceil("q_place") - F.col("q_place")) * F.col("q_low") + (F.col("q_place") - F.floor("q_place")) * F.col("q_high")
    met = met.select(*keys, "q_label", F.when(F.col("q_low") == F.col("q_high"), F.col("q_low")).otherwise(between).alias("q_value"))
    own = lambda n, label: (F.col("q_what") == n) & (F.col("q_label") == label)
    out = [F.max(F.when(own(n, label), F.col("q_value"))).alias(f"{n}_{label}" if n else label) for n in values for label in at]
    wide = met.groupBy(*names).agg(*out) if names else met.agg(*out)
    if names:
        groups = sizes.select(*names).distinct()
        wide = _joined(groups, wide, list(names), "left")
    return wide.withColumnsRenamed(names)


def with_quantiles(rows: DataFrame, df: DataFrame, *, by: Sequence[str], values: Mapping[str, Column], at: Mapping[str, float]) -> DataFrame:
    """``rows`` with the quantiles that ``df`` has for their ``by``."""
    return _joined(rows, group_quantiles(df, by=by, values=values, at=at), list(by), "left")
