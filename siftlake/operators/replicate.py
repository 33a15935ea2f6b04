"""Replicated-run statistics, comparisons with a baseline, gates and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.scalars import is_close, opposite_signs
from siftlake.operators.ordering import range_bucket, with_place


def mean_std(df: DataFrame, *, by: Sequence[str], metric: str, least: int = 2) -> DataFrame:
    """Count, mean and sample deviation by group; groups with fewer than ``least`` rows are left out."""
    stats = df.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    return stats.filter(F.col("n") >= least)


def macro_mean(df: DataFrame, *, group: str, seed: str, metric: str) -> DataFrame:
    """Mean over objects for each group and seed, then mean and sample deviation over seeds."""
    per_seed = df.groupBy(group, seed).agg(F.avg(metric).alias("macro"))
    return per_seed.groupBy(group).agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("macro").alias("mean"), F.stddev_samp("macro").alias("std"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation; null without spread on either side."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("r"))


def deltas(df: DataFrame, *, group: str, baseline: str, keys: Sequence[str], metric: str) -> DataFrame:
    """Each row's metric minus the baseline group's for the same keys; without a baseline row the key is left out."""
    base = df.filter(F.col(group) == baseline).select(*keys, F.col(metric).alias("base"))
    return df.filter(F.col(group) != baseline).join(base, list(keys)).withColumn("delta", F.col(metric) - F.col("base"))


def argmax(df: DataFrame, *, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("nth = 1").drop("nth")


def non_inferiority(df: DataFrame, *, group: str, baseline: str, object_: str, m1: str, m2: str, tolerance: float, gain: float) -> DataFrame:
    """One row: the winning candidate (largest mean of m1, then m2, then name) and whether it passes the gate.

    It passes if on every object neither metric falls more than ``tolerance`` below the baseline's and the mean
    gain in m1 is at least ``gain``.
    """
    base = df.filter(F.col(group) == baseline).select(object_, F.col(m1).alias("b1"), F.col(m2).alias("b2"))
    paired = df.filter(F.col(group) != baseline).join(base, object_)
    within = (F.col(m1) - F.col("b1") >= -tolerance) & (F.col(m2) - F.col("b2") >= -tolerance)
    each = paired.groupBy(group).agg(
        F.avg(m1).alias("mean_m1"), F.avg(m2).alias("mean_m2"), F.avg(F.col(m1) - F.col("b1")).alias("mean_gain"), F.every(within).alias("non_inferior")
    )
    best = argmax(each, by=[], order=[F.desc("mean_m1"), F.desc("mean_m2"), F.desc(group)])
    return best.withColumn("passed", F.col("non_inferior") & (F.col("mean_gain") >= gain))


def sign_conflicts(left: DataFrame, right: DataFrame, *, object_: str, seed: str, delta: str, least: int = 2) -> DataFrame:
    """By object: in how many seeds two comparisons have opposite signs, and whether in at least ``least``."""
    met = left.select(object_, seed, F.col(delta).alias("a")).join(right.select(object_, seed, F.col(delta).alias("b")), [object_, seed])
    counts = met.groupBy(object_).agg(F.count(F.lit(1)).alias("n_seeds"), F.count_if(opposite_signs(F.col("a"), F.col("b"))).alias("n_opposite"))
    return counts.withColumn("conflict", F.col("n_opposite") >= least)


def collapsed(df: DataFrame, *, by: Sequence[str], metric: str, least: int = 2) -> DataFrame:
    """Groups whose metric is exactly zero in at least ``least`` runs."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(metric) == 0).alias("n_zero")).withColumn("collapse", F.col("n_zero") >= least)


def verdict(effect: Column, threshold: Column | float, informative: Column | None = None) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    judged = F.when(effect >= t, "helps").when(effect <= -t, "harms").otherwise("no_effect")
    return judged if informative is None else F.when(~informative, "uninformative").otherwise(judged)


def discriminates(*scores: Column) -> Column:
    """Whether the scores are not all the same; if they are, the metric cannot tell the candidates apart."""
    return ~(F.array_min(F.array(*scores)) == F.array_max(F.array(*scores)))


def attribution(df: DataFrame, *, object_: str, baseline: str, real: str, generated: str) -> DataFrame:
    """By object the larger of ``placement`` (baseline - real) and ``appearance`` (real - generated) effects; then overall.

    Values within 1e-9 relative or 1e-12 absolute tie. ``overall`` names a cause only if it is the larger one on every
    object; ties and mixed answers are ``object_dependent``. The means of both effects stand beside it, and
    ``discriminates`` tells whether an object's three scores differ at all. An object without one of them is an
    error, raised when the result is read.
    """
    complete = F.col(baseline).isNotNull() & F.col(real).isNotNull() & F.col(generated).isNotNull()
    first = F.when(complete, F.col(baseline)).otherwise(F.raise_error(F.concat(F.lit("a score is missing: "), F.col(object_).cast("string"))).cast("double"))
    p, a = first - F.col(real), F.col(real) - F.col(generated)
    answer = F.when(is_close(p, a), "tie").when(p > a, "placement").otherwise("appearance")
    rows = df.withColumn("placement_effect", p).withColumn("appearance_effect", a).withColumn("attribution", answer)
    rows = rows.withColumn("discriminates", discriminates(F.col(baseline), F.col(real), F.col(generated)))
    whole = rows.agg(
        F.every(F.col("attribution") == "placement").alias("all_placement"),
        F.every(F.col("attribution") == "appearance").alias("all_appearance"),
        F.avg("placement_effect").alias("placement_mean"),
        F.avg("appearance_effect").alias("appearance_mean"),
    )
    overall = F.when(F.col("all_placement"), "placement_dominates").when(F.col("all_appearance"), "appearance_dominates").otherwise("object_dependent")
    whole = whole.select(overall.alias("overall"), "placement_mean", "appearance_mean")
    return rows.crossJoin(F.broadcast(whole))  # one row


def confirmed_effect(df: DataFrame, *, by: str, seed: str, effect: str, informative: str, disclosed: Sequence[int], threshold: float) -> DataFrame:
    """Verdicts from undisclosed and informative seeds only; the disclosed seeds' mean is reported beside them."""
    blind = ~F.col(seed).isin(*disclosed) & F.col(informative)
    rows = df.groupBy(by).agg(
        F.avg(F.when(blind, F.col(effect))).alias("effect"), F.count_if(blind).alias("n_blind"), F.avg(F.when(F.col(seed).isin(*disclosed), F.col(effect))).alias("disclosed_effect")
    )
    return rows.withColumn("verdict", F.coalesce(verdict(F.col("effect"), threshold, F.col("n_blind") > 0), F.lit("uninformative")))


def best_so_far(df: DataFrame, *, by: Sequence[str], step: str, score: str, patience: int, width: int = 4096) -> DataFrame:
    """Running best, steps since it rose (strictly), and whether training would have stopped by then.

    Steps are whole numbers. Running values are carried from one stretch of ``width`` steps to the next by a row for
    each stretch, so a group may hold most of the rows; only the rows of a stretch are sorted together.
    """

    def carried(rows: DataFrame, value: Column, name: str, earlier: str | None = None) -> DataFrame:
        """The running maximum of ``value`` over the group as ``name``, and that before the row as ``earlier``."""
        keys = [*by, "stretch"]
        tops = rows.groupBy(*keys).agg(F.max(value).alias("top"))
        before = F.max("top").over(Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
        tops = tops.select(*[F.col(k).alias(f"at_{k}") for k in keys], before.alias("top"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"at_{k}"))
        inside = Window.partitionBy(*keys).orderBy(step)
        joined = rows.join(tops, same).drop(*[f"at_{k}" for k in keys])
        out = joined.withColumn(name, F.greatest("top", F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
        if earlier:
            out = out.withColumn(earlier, F.greatest("top", F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, -1))))
        return out.drop("top")

    rows = with_place(df, by=by, bucket=range_bucket(F.col(step), width), order=[F.col(step)])
    rows = carried(rows.withColumn("stretch", range_bucket(F.col(step), width)), F.col(score), "best", "earlier")
    rises = F.coalesce(F.col(score) > F.col("earlier"), F.lit(True))
    rows = carried(rows, F.when(rises, F.col("place")), "rose").withColumn("stale", F.col("place") - F.col("rose"))
    rows = carried(rows, F.col("stale"), "stalest").withColumn("stopped", F.col("stalest") >= patience)
    return rows.drop("place", "stretch", "earlier", "rose", "stalest")


def window_means(df: DataFrame, *, by: Sequence[str], step: str, value: str, width: int) -> DataFrame:
    """First and last mean over full, non-overlapping windows of ``width`` steps (numbered from 1)."""
    means = df.groupBy(*by, F.floor((F.col(step) - 1) / width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m")).filter(F.col("n") == width)
    return means.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), F.min_by("m", "w").alias("first_mean"), F.max_by("m", "w").alias("last_mean"))


#: A pixel AUROC from which a ranking counts as informative.
INFORMATIVE_AUROC = 0.80


def zero_diagnosis(overlap: Column, top: Column, inside_max: Column, outside_max: Column, auroc: Column, threshold: float) -> Column:
    """Why a segmentation's overlap is zero: where its most confident pixel is, and how well its scores rank."""
    return (
        F.when(top.isNull(), "no_pixels")
        .when(overlap > 0, "non_zero_overlap")
        .when(top >= threshold, "positive_pixels_never_overlap")
        .when(inside_max > outside_max, "underconfident_peak_inside")
        .when(auroc >= INFORMATIVE_AUROC, "underconfident_peak_outside_ranking_informative")
        .otherwise("underconfident_peak_outside_ranking_near_random")
    )


def reconcile(left: DataFrame, right: DataFrame, *, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Full outer comparison: which side lacks a key, and absolute differences of metrics."""
    a = left.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics], F.lit(True).alias("in_a"))
    b = right.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics], F.lit(True).alias("in_b"))
    rows = a.join(b, list(keys), "full")
    status = F.when(F.col("in_a").isNull(), "extra").when(F.col("in_b").isNull(), "missing").otherwise("both")
    return rows.select(*keys, status.alias("status"), *[F.abs(F.col(f"{m}_a") - F.col(f"{m}_b")).alias(f"{m}_diff") for m in metrics])


def with_aliases(df: DataFrame, group: str, aliases: dict[str, str]) -> DataFrame:
    """Rows of alias groups as copies of the group they stand for; ``alias_of`` is null for physical rows."""
    out = df.withColumn("alias_of", F.lit(None).cast("string"))
    for alias in aliases:
        target = resolve_alias(alias, aliases)
        copies = df.filter(F.col(group) == target).withColumn(group, F.lit(alias)).withColumn("alias_of", F.lit(target))
        out = out.unionByName(copies)
    return out


def resolve_alias(name: str, aliases: dict[str, str], known: Sequence[str] | None = None) -> str:
    """Follow ``aliases`` to a physical group; a cycle or an unknown end is an error."""
    seen = []
    while name in aliases:
        if name in seen:
            raise ValueError(f"alias cycle: {' -> '.join([*seen, name])}")
        seen.append(name)
        name = aliases[name]
    if known is not None and name not in known:
        raise ValueError(f"unknown group: {name}")
    return name
