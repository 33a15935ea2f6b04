"""Near-duplicate groups and what depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.cluster import materialise
from siftlake.operators import hashes as wide, imaging, neardup
from siftlake.operators.ordering import range_bucket, with_place
from siftlake.plans.registry import query
from siftlake.sources.readers import table

THRESHOLD = 3
HASHES = """w AS (
  SELECT doc_id, lang, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM documents),
h AS (SELECT doc_id, lang, CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) AS x FROM w),
b AS (SELECT doc_id, lang, i, count(*) AS n, sum((x >> i) & 1) AS ones FROM h, range(60) t(i) GROUP BY ALL),
hashes AS (SELECT doc_id AS id, lang, CAST(sum(CASE WHEN 2 * ones > n THEN CAST(1 AS BIGINT) << i ELSE 0 END) AS BIGINT) AS hash FROM b GROUP BY ALL)"""
PAIRS = f"""{HASHES},
pairs AS (
  SELECT x.id AS a, y.id AS b, x.lang, bit_count(xor(x.hash, y.hash)) AS distance
  FROM hashes x JOIN hashes y ON x.lang = y.lang AND x.id < y.id AND bit_count(xor(x.hash, y.hash)) <= {THRESHOLD})"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(neardup.simhash(table(spark, sf_dir, "documents"), id_col="doc_id", text="text", keep=("lang",)), "hashes")


def _members(rows: DataFrame) -> DataFrame:
    return neardup.class_components(rows, bits=60, threshold=THRESHOLD, by="lang")


@query(f"WITH {HASHES} SELECT id, hash FROM hashes")
def simhash_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir).select("id", "hash")


@query(
    f"""WITH {HASHES}, classes AS (SELECT lang, hash, min(id) AS rep, count(*) AS n FROM hashes GROUP BY lang, hash)
SELECT x.rep AS a, y.rep AS b, x.n AS a_size, y.n AS b_size, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance
FROM classes x JOIN classes y ON x.lang = y.lang AND x.rep < y.rep AND bit_count(xor(x.hash, y.hash)) <= {THRESHOLD}"""
)
def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close pairs among the first documents of each class of equal hashes; ``neardup_groups`` has the members."""
    classes, pairs = neardup.class_pairs(hashes(spark, sf_dir), bits=60, threshold=THRESHOLD, by="lang")
    sizes = [classes.select(F.col("rep").alias(end), F.col("n").alias(f"{end}_size")) for end in ("a", "b")]
    return pairs.join(sizes[0], "a").join(sizes[1], "b").select("a", "b", "a_size", "b_size", "distance")


GROUPS = f"""WITH RECURSIVE {PAIRS},
e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT id, id AS other FROM hashes UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a),
c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


@query(
    GROUPS
    + """, n AS (SELECT a AS id, min(distance) AS nearest FROM (SELECT a, distance FROM pairs UNION ALL SELECT b, distance FROM pairs) GROUP BY 1)
SELECT c.id, component, dense_rank() OVER (ORDER BY component) - 1 AS group_id, CAST(coalesce(nearest, -1) AS INTEGER) AS nearest, count(*) OVER (PARTITION BY component) AS group_size
FROM c LEFT JOIN n ON c.id = n.id"""
)
def neardup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.numbered(materialise(_members(hashes(spark, sf_dir)), "members"))
    return found.withColumn("group_id", F.col("group_id").cast("long")).withColumn("nearest", F.coalesce("nearest", F.lit(-1)))


@query(
    GROUPS
    + """, s AS (SELECT id, component, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM c)
SELECT id, split, CASE WHEN max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) OVER (PARTITION BY component) = 1 THEN 'test' ELSE split END AS final_split FROM s"""
)
def group_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(hashes(spark, sf_dir)).select("id", "component")
    split = members.withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    return neardup.group_safe_split(split, group="component", split="split").select("id", "split", "final_split")


@query(
    f"""WITH RECURSIVE {PAIRS},
able AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE n_chars >= 500),
before AS (SELECT b AS id, list(a) AS near FROM pairs WHERE a IN (SELECT id FROM able) AND b IN (SELECT id FROM able) GROUP BY b),
ordered AS (SELECT able.id, n, coalesce(near, []) AS near FROM able LEFT JOIN before ON able.id = before.id),
kept AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ids
  UNION ALL
  SELECT o.n, CASE WHEN list_has_any(k.ids, o.near) THEN k.ids ELSE list_append(k.ids, o.id) END FROM kept k JOIN ordered o ON o.n = k.n + 1)
SELECT doc_id AS id, list_contains((SELECT arg_max(ids, n) FROM kept), doc_id) AS accepted FROM documents"""
)
def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stays if it has 500 characters and no earlier staying one of its language is near it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") >= 500).alias("eligible"))
    return neardup.greedy_dedupe(docs, hashes(spark, sf_dir), bits=60, threshold=THRESHOLD, by="lang")


WIDE_THRESHOLD = 6
WIDE = """w AS (SELECT doc_id, lang, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM documents),
x AS (SELECT word, sha256(word) AS hex FROM (SELECT DISTINCT word FROM w)),
d AS (SELECT word, i, CAST('0x' || substr(hex, i + 1, 1) AS INTEGER) AS digit FROM x, range(64) r(i)),
c AS (SELECT doc_id, lang, i, count(*) AS n, sum(digit >> 3) AS b3, sum((digit >> 2) & 1) AS b2, sum((digit >> 1) & 1) AS b1, sum(digit & 1) AS b0 FROM w JOIN d USING (word) GROUP BY ALL),
wide AS (SELECT doc_id AS id, lang, CAST(string_agg(CASE WHEN 2 * b3 > n THEN '1' ELSE '0' END || CASE WHEN 2 * b2 > n THEN '1' ELSE '0' END
  || CASE WHEN 2 * b1 > n THEN '1' ELSE '0' END || CASE WHEN 2 * b0 > n THEN '1' ELSE '0' END, '' ORDER BY i) AS BIT) AS hash FROM c GROUP BY doc_id, lang)"""


@query(
    f"""WITH RECURSIVE {WIDE},
dist AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.hash, y.hash)) AS d FROM wide x JOIN wide y ON x.lang = y.lang AND x.id <> y.id),
e AS (SELECT a, b FROM dist WHERE d <= {WIDE_THRESHOLD}),
reach AS (SELECT id, id AS other FROM wide UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a),
g AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT g.id, component, CAST(min(d) AS INTEGER) AS nearest, count(*) OVER (PARTITION BY component) AS group_size FROM g LEFT JOIN dist ON dist.a = g.id GROUP BY g.id, component"""
)
def wide_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by 256-bit hashes, and every document's distance to the nearest other one of its language."""
    rows = materialise(wide.wide_simhash(table(spark, sf_dir, "documents"), id_col="doc_id", text="text", keep=("lang",)), "wide-hashes")
    members = materialise(wide.wide_groups(rows, threshold=WIDE_THRESHOLD, by="lang"), "wide-members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    return members.join(sizes, "component").select("id", "component", "nearest", "group_size")


BOXES = """boxes AS (
  SELECT l_partkey AS g, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS id, CAST(l_orderkey * 7 % 200 AS INTEGER) AS x0, CAST(l_orderkey % 150 AS INTEGER) AS y0,
         CAST(l_orderkey * 7 % 200 + 4 + l_quantity AS INTEGER) AS x1, CAST(l_orderkey % 150 + 4 + l_quantity AS INTEGER) AS y1
  FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of different sizes on many backgrounds, one for each line item, numbered in order of its keys."""
    keys = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    items = with_place(table(spark, sf_dir, "lineitem").select(*keys), by=[], bucket=range_bucket(keys[0]), order=keys, name="id")
    x, y, side = F.col("l_orderkey") * 7 % 200, F.col("l_orderkey") % 150, F.col("l_quantity") + 4
    corners = {"x0": x, "y0": y, "x1": x + side, "y1": y + side}
    return items.select(F.col("l_partkey").alias("g"), "id", *[c.cast("int").alias(n) for n, c in corners.items()])


@query(f"WITH {BOXES} SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.g = b.g AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def box_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.box_conflicts(boxes(spark, sf_dir), by="g")


@query(
    f"""WITH RECURSIVE {BOXES},
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS n, {{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} AS box FROM boxes),
k AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, x0 INTEGER, y0 INTEGER, x1 INTEGER, y1 INTEGER)[]) AS kept FROM boxes
  UNION ALL
  SELECT o.g, o.n, CASE WHEN len(list_filter(k.kept, lambda b: b.x0 < o.x1 AND o.x0 < b.x1 AND b.y0 < o.y1 AND o.y0 < b.y1)) > 0 THEN k.kept ELSE list_append(k.kept, o.box) END
  FROM k JOIN o ON o.g = k.g AND o.n = k.n + 1),
ids AS (SELECT g, list_transform(arg_max(kept, n), lambda b: b.id) AS ids FROM k GROUP BY g)
SELECT boxes.id, list_contains(ids, boxes.id) AS accepted FROM boxes JOIN ids ON boxes.g = ids.g"""
)
def nonoverlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes placed in order of id, each only if it overlaps none that was placed before."""
    return imaging.place_in_order(materialise(boxes(spark, sf_dir).filter("g IS NOT NULL"), "boxes"), by="g")
