"""Fail-closed checks: each finds the rows that break a contract; ``require_none`` raises on the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A relation breaks its contract."""


def require_none(violations: DataFrame, message: str) -> None:
    row = violations.first()
    if row is not None:
        raise ContractError(f"{message}: {row.asDict(recursive=True)}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Keys of ``df`` that ``other`` lacks."""
    return df.select(*keys).distinct().join(other.select(*keys).distinct(), list(keys), "left_anti")


def shared(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Keys of both; disjoint relations have none."""
    return df.select(*keys).intersect(other.select(*keys))


def set_difference_report(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Keys on one side only, with ``side`` ``missing`` (of ``other``) or ``extra``."""
    extra = missing(df, other, *keys).withColumn("side", F.lit("extra"))
    return extra.unionByName(missing(other, df, *keys).withColumn("side", F.lit("missing")))


def subset_report(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """One row: whether the keys of ``df`` are a ``subset`` of those of ``other``, and a ``strict`` one."""
    sides = set_difference_report(df, other, *keys).agg(F.count_if(F.col("side") == "extra").alias("extra"), F.count_if(F.col("side") == "missing").alias("missing"))
    subset = F.col("extra") == 0
    return sides.select(subset.alias("subset"), (subset & (F.col("missing") > 0)).alias("strict"))


def breaking(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows for which a rule is not true, with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def crossing(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with more than one distinct value."""
    return df.groupBy(group).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def exactly_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` if each key occurs once; a key that does not is an error when the row is read."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    message = F.concat(F.lit("expected exactly one row for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = df.withColumn("n_of_key", F.when(n == 1, n).otherwise(F.raise_error(message).cast("bigint")))
    return checked.filter(F.col("n_of_key") == 1).drop("n_of_key")


def named_checks(checks: DataFrame, waivers: DataFrame) -> DataFrame:
    """One row per check with ``ok`` and ``waived``, and the conjunction ``passed`` over all in every row.

    ``checks`` has ``name, ok``, ``waivers`` has ``name``. A waiver for no check is an error.
    """
    require_none(missing(waivers, checks, "name"), "waiver for an unknown check")
    rows = checks.join(waivers.select("name").distinct().withColumn("waived", F.lit(True)), "name", "left")
    rows = rows.withColumn("waived", F.coalesce("waived", F.lit(False)))
    from pyspark.sql import Window

    return rows.withColumn("passed", F.every(F.col("ok") | F.col("waived")).over(Window.partitionBy()))


def forbid_inputs(df: DataFrame, denied: list[str]) -> DataFrame:
    """``df``, if none of the files it reads lies at or below a denied path."""
    for file in df.inputFiles():
        plain = file.split(":", 1)[-1].replace("//", "/").lstrip("/")
        for path in denied:
            if f"{plain}/".startswith(path.split(":", 1)[-1].strip("/") + "/"):
                raise ContractError(f"{file} must not be read")
    return df
