"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document's expected copies are in proportion to the binary digits of its size, so that long documents are taken
somewhat more often, at most ``MOST_COPIES``; the level is such that a source's expected words are its target. The
whole part of that number are certain copies. The rest is an inclusion probability p, unequal within a source: the
words still missing are drawn without replacement by Pareto order sampling. A document with a uniform number u has
the rank r = (u / (1 - u)) / (p / (1 - p)), kept as r / (1 + r), and the lowest ranks are taken until the source's
words reach its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise
from siftlake.operators.ordering import with_place

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2.0
#: Ranks are first summed in this many steps, so only one step of each source is ever sorted.
STEPS = 4096


def uniform(key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of ``key`` as text; null keys count as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(
    sizes: DataFrame, *, cycle: tuple[float, ...] = CYCLE, total_share: float = TOTAL_SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """``source, source_size, target``: one row per source with its word target.

    ``sizes`` has ``source`` and ``source_size``, one row per source. Sources in code-point order, null last,
    weigh ``cycle`` repeating. They share ``total_share`` of all words; no target exceeds ``most`` times its
    source's size, the excess is reshared by weight until none is above: each round finds the common level of the
    sources below their caps from two sums, so no task ever holds all sources. A source without words gets 0.
    """
    by_name = F.struct(F.col("source").isNull().alias("last"), F.substring("source", 1, 2).alias("start"))
    rows = with_place(sizes, by=[], bucket=by_name, order=[F.col("source").asc_nulls_last()], name="i")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    rows = rows.withColumn("weight", F.element_at(weights, (F.col("i") % len(cycle) + 1).cast("int")))
    rows = materialise(rows.withColumn("cap", F.col("source_size") * F.lit(float(most))), "mix-sources")
    level, before = float("inf"), None
    while level != before:
        above = F.col("weight") * F.lit(level) > F.col("cap") if before is not None else F.lit(False)
        found = rows.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap"))).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("open")
        ).first()
        before = level
        if found["open"]:
            level = ((found["all"] or 0) * total_share - (found["capped"] or 0.0)) / found["open"]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digits(size: Column) -> Column:
    """Binary digits of a size: the weight of a document."""
    return F.length(F.bin(size))


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source`` and ``size`` (words; 0 for null) of every row: the one pass over the texts."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def _rank(u: Column, p: Column) -> Column:
    """Pareto's rank r as r / (1 + r), which has the same order."""
    return F.when(p > 0, u * (1 - p) / (u * (1 - p) + p * (1 - u)))


def expected_copies(by_digits: DataFrame, targets: DataFrame, *, most: float = MOST_COPIES) -> DataFrame:
    """One row per source and number of digits: certain copies ``whole``, probability ``p`` of one more, and the source's ``missing`` words.

    ``by_digits`` has ``source, digits, words``. Expected copies are level x digits, at most ``most``. With the most
    digits first the capped ones are a prefix, so running sums over a source's few rows find the level.
    """
    source = Window.partitionBy("source")
    upto = source.orderBy(F.desc("digits")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = targets.select(F.col("source").alias("plan_source"), "source_size", "target")
    rows = by_digits.join(known, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("weighted", F.col("words") * F.col("digits"))
    rest = (F.sum("weighted").over(source) - F.sum("weighted").over(upto) + F.col("weighted")).cast("double")
    level = F.try_divide(F.col("target") - F.lit(float(most)) * (F.sum("words").over(upto) - F.col("words")).cast("double"), rest)
    rows = rows.withColumn("level", level)
    first = F.max(F.when(F.col("level") * F.col("digits") <= most, F.struct("digits", "level"))).over(source)
    copies = F.least(F.lit(float(most)), F.coalesce(first["level"] * F.col("digits"), F.lit(float(most))))
    rows = rows.withColumn("copies", F.when(F.col("source_size") > 0, copies).otherwise(F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.col("copies") - F.floor("copies"))
    rows = rows.withColumn("missing", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(source).cast("double"))
    return rows.select("plan_source", F.col("digits").alias("plan_digits"), "source_size", "target", "whole", "p", "missing")


def plan_mix(
    sizes: DataFrame,
    *,
    cycle: tuple[float, ...] = CYCLE,
    total_share: float = TOTAL_SHARE,
    most: float = MOST_COPIES,
    steps: int = STEPS,
) -> DataFrame:
    """One row per source and number of digits: the source's size and target, whole copies, p, and the rank up to
    which one copy more is taken.

    Words are summed by source and step of the rank (a map-side sum of at most sources x ``steps`` rows); of each
    source only the one step that holds the boundary is sorted, so a source with a third of all rows is never
    gathered in a task. The last document taken is the one that brings the source's words nearest to its target.
    """
    by_digits = sizes.groupBy("source", digits(F.col("size")).alias("digits")).agg(F.sum("size").alias("words"))
    by_digits = materialise(by_digits, "mix-digits")
    by_source = by_digits.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(by_source, cycle=cycle, total_share=total_share, most=most)
    expected = materialise(expected_copies(by_digits, targets, most=most), "mix-expected")
    rows = _with_rank(sizes, expected, steps=steps).filter("rank IS NOT NULL")
    by_step = materialise(rows.groupBy("source", "step", "missing").agg(F.sum("size").alias("words")), "mix-steps")
    running = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (
        by_step.withColumn("upto", F.sum("words").over(running))
        .filter(F.col("upto") >= F.col("missing"))
        .groupBy(F.col("source").alias("edge_source"))
        .agg(F.min(F.struct("step", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
        .select("edge_source", F.col("edge.step").alias("edge_step"), F.col("edge.before").alias("before"))
    )
    edges = materialise(edges, "mix-edges")
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    inside = F.col("before") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = (
        rows.join(edges, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("step") == F.col("edge_step")))
        .withColumn("inside", inside)
        .filter(F.col("inside") - F.col("size") / 2 <= F.col("missing"))
        .groupBy(F.col("source").alias("cut_source"))
        .agg(F.max(F.struct("rank", "doc_id")).alias("cut"))
    )
    plan = expected.join(edges.drop("before"), F.col("plan_source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    plan = plan.join(cuts, F.col("plan_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    return materialise(plan, "mix-plan")


def _with_rank(rows: DataFrame, plan: DataFrame, *, steps: int) -> DataFrame:
    """``rows`` (with doc_id, source and size) joined to the plan of their source and digits, with rank and step of the rank."""
    same = F.col("source").eqNullSafe(F.col("plan_source")) & (digits(F.col("size")) == F.col("plan_digits"))
    joined = rows.join(plan, same).drop("plan_source", "plan_digits")
    return joined.withColumn("rank", _rank(uniform(F.col("doc_id")), F.col("p"))).withColumn("step", F.floor(F.col("rank") * steps).cast("long"))


def decide(rows: DataFrame, plan: DataFrame, *, steps: int = STEPS) -> DataFrame:
    """``rows`` (with doc_id, source and size) with their source's ``source_size`` and ``target``, and their ``copies``.

    Where the boundary lies in no step, all words are missing, and every document with a rank gets its copy.
    """
    joined = _with_rank(rows, plan, steps=steps)
    here = F.struct(F.col("rank").alias("rank"), F.col("doc_id").alias("doc_id"))
    at_edge = (F.col("step") == F.col("edge_step")) & F.coalesce(here <= F.col("cut"), F.lit(False))
    extra = F.coalesce(F.col("rank").isNotNull() & (F.col("edge_step").isNull() | (F.col("step") < F.col("edge_step")) | at_edge), F.lit(False))
    return joined.select(*rows.columns, "source_size", "target", (F.col("whole") + extra.cast("long")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Null texts have size 0; a null source is a source of its own, last in order. Rows that repeat a doc_id are
    drawn alike, as their random number depends on the doc_id only; so if they lie on a source's boundary, all of
    them are taken. Other columns are not read. An empty table gives an empty result.
    """
    sizes = materialise(document_sizes(docs), "mix-sizes")
    rows = decide(sizes, plan_mix(sizes, **options), steps=options.get("steps", STEPS))
    return rows.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; rows without a copy go.

    Ties, nulls, repeats and empty tables are treated as by ``mix``; all columns are handed on.
    """
    plan = plan_mix(materialise(document_sizes(docs), "mix-sizes"), **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = decide(rows, plan, steps=options.get("steps", STEPS)).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op9_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with the words that the mix takes of it."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
w AS (
  SELECT source, source_size, i, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(i % 3 AS INTEGER) + 1] AS weight, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s)),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, i ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap)) AS target FROM l),
k AS (SELECT source, length(bin(size)) AS digits, CAST(sum(size) AS BIGINT) AS words FROM docs GROUP BY ALL),
c AS (
  SELECT k.source, digits, words, source_size, target,
         (target - 2.0::DOUBLE * CAST(sum(words) OVER o - words AS DOUBLE))
         / nullif(CAST(sum(words * digits) OVER (PARTITION BY k.source) - sum(words * digits) OVER o + words * digits AS DOUBLE), 0) AS level
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY k.source ORDER BY digits DESC ROWS UNBOUNDED PRECEDING)),
e AS (
  SELECT source, digits, words, source_size, target,
         CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, coalesce(arg_max(level, digits) FILTER (level * digits <= 2) OVER (PARTITION BY source) * digits, 2)) ELSE 0 END AS copies
  FROM c),
r AS (
  SELECT source, digits, source_size, target, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS p,
         target - CAST(sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS missing
  FROM e),
q AS (
  SELECT doc_id, docs.source, size, source_size, target, whole, p, missing, u * (1 - p) / (u * (1 - p) + p * (1 - u)) AS rank
  FROM docs JOIN r ON docs.source IS NOT DISTINCT FROM r.source AND length(bin(size)) = digits),
d AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY p > 0 DESC, rank, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken
FROM (SELECT *, whole + CASE WHEN p > 0 AND upto - size / 2.0::DOUBLE <= missing THEN 1 ELSE 0 END AS copies FROM d)
"""
