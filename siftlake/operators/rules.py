"""Multi-label rejection rules, their funnel, and reference fits they compare with."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators.quantiles import with_quantiles


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true where a row is refused for ``reason``; a null does not refuse."""

    stage: str
    reason: str
    rejects: Column


def geometry_rules(
    area_z: float = 2.5, aspect_z: float = 2.5, phash_min: int = 5, copy_nn: float = 0.98, seam_min: float = 0.85, quantile_guard: bool = True
) -> list[Rule]:
    """The six rules of the quality filter over score columns, in funnel order; strictness as given here."""
    outside = (F.col("area_ratio") < F.col("area_p05")) | (F.col("area_ratio") > F.col("area_p95"))
    area = F.abs("area_zscore") > area_z
    return [
        Rule("roi", "ROI_OVERFLOW", F.col("roi_containment") < 1.0),
        Rule("area", "AREA_OUT_OF_RANGE", area | outside if quantile_guard else area),
        Rule("aspect", "ASPECT_OUT_OF_RANGE", F.abs("aspect_zscore") > aspect_z),
        Rule("phash", "PHASH_DUPLICATE", F.col("phash_min_dist") < phash_min),
        Rule("dinov2", "NN_TOO_LOW", F.col("nn_score") < F.col("tau_low")),
        Rule("dinov2", "NN_TOO_HIGH_COPY", F.col("nn_score") >= copy_nn),
        Rule("dinov2", "EMBEDDING_OUTLIER", F.col("outlier_score") > F.col("tau_outlier")),
        Rule("seam", "SEAM_POOR", F.col("seam_score") < seam_min),
    ]


def reject_reasons(rules: Sequence[Rule], disabled: Sequence[str] = ()) -> Column:
    """All reasons that apply, in the order of the rules. Disabling an unknown stage is an error."""
    unknown = set(disabled) - {r.stage for r in rules}
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    live = [F.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.reason)) for r in rules if r.stage not in disabled]
    return F.array_compact(F.array(*live)) if live else F.array().cast("array<string>")


def decide(df: DataFrame, rules: Sequence[Rule], disabled: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("reject_reasons", reject_reasons(rules, disabled)).withColumn("passed", F.size("reject_reasons") == 0)


def funnel(decided: DataFrame, stages: Sequence[tuple[str, Sequence[str]]], by: Sequence[str]) -> DataFrame:
    """Per group: ``total``, survivors ``after_<stage>`` of all stages so far, and ``accepted``. One aggregation."""
    counts, so_far = [F.count(F.lit(1)).alias("total")], []
    for stage, reasons in stages:
        so_far += reasons
        held = F.arrays_overlap("reject_reasons", F.array(*[F.lit(r) for r in so_far]))
        counts.append(F.count_if(~held).alias(f"after_{stage}"))
    return decided.groupBy(*by).agg(*counts, F.count_if(F.size("reject_reasons") == 0).alias("accepted"))


def reason_counts(decided: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many rows each reason is given for, and for how many it is the first."""
    rows = decided.select(*by, F.posexplode("reject_reasons").alias("i", "reason"))
    return rows.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("triggers"), F.count_if(F.col("i") == 0).alias("first_reason"))


def log_reference(df: DataFrame, by: str, **columns: str) -> DataFrame:
    """Mean and sample deviation of the logs, and linear p05 and p95, of each named positive column by group."""
    out = []
    for name, column in columns.items():
        log = F.ln(F.col(column))
        out += [F.avg(log).alias(f"{name}_mean_log"), F.stddev_samp(log).alias(f"{name}_std_log")]
    values = {name: F.col(column) for name, column in columns.items()}
    return with_quantiles(df.groupBy(by).agg(*out), df, by=[by], values=values, at={"p05": 0.05, "p95": 0.95})


def lower_quantile(values: Column, q: float) -> Column:
    """``sorted(values)[int(q * (n - 1))]`` of an array."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))
