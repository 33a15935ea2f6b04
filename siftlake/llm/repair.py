"""Repair of the turn structure of conversations: a forward Viterbi pass over four grammar states.

A repaired conversation's role initials are ``(s?(ua)+)?``. The states are: nothing yet, after ``s``, after ``u``, after
``a``. Every turn makes a layer: each state keeps the cheapest way to it as (cost, audit string), and a layer is closed by
the insertions that lead from state to state, two relaxations at most. The cost of a way follows from its audit string, so
no two ways of equal cost are prefixes of each other, and the least (cost, audit) of a state stays the least whatever
comes after.

A conversation may hold a third of all turns, so it is cut into segments: rows are dealt by range in the order of
conversation and turn, each segment is passed from all four states at once, and the results are joined like matrices,
``FAN`` neighbours a task and round. Only the digest at the end reads a conversation's texts one after another, as
SHA-256 has no other way; a row of that pass is a segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.llm.held import release

#: Turns and characters of a segment; segments that one task joins in a round.
SEGMENT, SEGMENT_CHARS, FAN = 512, 1_000_000, 64
#: Characters of a text by which rows of equal turn and role are ordered, before its hash decides.
ORDER_CHARS = 100
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\v\f\r"
NEVER = 1 << 62

Way = tuple[int, str]
Layer = list[Way | None]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``, and ``role0, text0`` as they were: the damage that the query repairs.

    By crc32(``conv_id:turn``) % 20: 0 drops a row (no copies), 1 empties its text, 2 removes ``.!?``, 3 repeats it,
    4 makes it the user's. A null is one space, in the key too.
    """
    given = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(given[0], F.lit(":"), given[1])) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), given[2].alias("role0"), given[3].alias("text0"), fault.alias("fault"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role0")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text0", ".!?", "")).otherwise(F.col("text0")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
        "role0",
        "text0",
    )


def in_order(rows: DataFrame, role: str, text: str, keep: list[str]) -> DataFrame:
    """``keep`` of the rows, dealt by range and sorted by conv_id, turn (nulls first), role and text.

    Rows alike in all of these are interchangeable and may lie in several tasks, so no key is too large.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {"at_role": F.col(role), "at_text": F.substring(text, 1, ORDER_CHARS), "at_hash": F.unhex(F.sha2(text, 256)), "at_row": F.monotonically_increasing_id()}
    order = ["conv_id", "turn", *keys]
    dealt = rows.select(*keep, *[c.alias(n) for n, c in keys.items()])
    return dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*keep)


SEGMENTS_SQL = "conv_id long, seg long, turns array<long>, roles array<string>, texts array<string>, kinds string, keys array<binary>"
SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("seg", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("kinds", pa.string()), ("keys", pa.list_(pa.binary()))]
)


def kind(role: str, text: str) -> str:
    """Two letters of a turn: its role's initial (``-`` if it is none of the grammar's), and its fault by itself."""
    bare = text.strip(BLANKS)
    return (role[0] if role[:1] and role[0] in "sua" else "-") + ("b" if not bare else "." if bare[-1] in ".!?" else "t")


def _segments(most: int):
    """Sorted rows to segments, numbered along the order. A conversation without rows left has an empty one."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number, now, held, chars = TaskContext.get().partitionId() << 32, None, [], 0

        def row() -> tuple:
            turns, roles, texts = ([r[i] for r in held] for i in range(3))
            keys = [hashlib.sha256(f"{now[0]}:{len(r)}:{r}{t}".encode()).digest() for _, r, t in held]
            return (now[0], number, turns, roles, texts, "".join(map(kind, roles, texts)), keys)

        for batch in batches:
            out = []
            for conv, turn, role, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies"))):
                if now is not None and now[0] != conv or len(held) >= most or chars >= SEGMENT_CHARS:
                    out.append(row())
                    number, held, chars = number + 1, [], 0
                now = (conv,)
                held += [(turn, role, text)] * copies
                chars += len(text) * copies
            yield from _batch(out, SEGMENTS)
        if now is not None:
            yield from _batch([row()], SEGMENTS)

    return segments


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _closed(layer: Layer) -> Layer:
    """The layer after insertions: a user's from every other state, then an assistant's from the user's."""
    for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        ways = [(layer[s][0] + INSERT, layer[s][1] + "I") for s in sources if layer[s]]
        layer[to] = min([*ways, layer[to]] if layer[to] else ways, default=None)
    return layer


def _step(layer: Layer, initial: str, fault: str) -> Layer:
    """The next turn's layer. ``fault``: ``b`` blank or ``d`` duplicate, which must go, ``t`` truncated, ``.`` none."""
    ways: list[list[Way]] = [[(w[0] + DELETE, w[1] + "D")] if w else [] for w in layer]
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        for state, way in enumerate(layer):
            if way:
                to = ASSISTANT if state == USER else USER
                ways[to].append((way[0] + REROLE + more, way[1] + "R"))
                if initial == ("a" if state == USER else "u"):
                    ways[to].append((way[0] + more, way[1] + "K"))
                elif initial == "s" and state == START:
                    ways[SYSTEM].append((way[0] + more, way[1] + "K"))
    return _closed([min(w, default=None) for w in ways])


def passed(initials: str, faults: str) -> list[Layer]:
    """From each of the four states, the cheapest way to each through all turns."""
    out = []
    for start in range(4):
        layer: Layer = [None] * 4
        layer[start] = (0, "")
        for initial, fault in zip(initials, faults):
            layer = _step(layer, initial, fault)
        out.append(layer)
    return out


def chained(first: list[Layer], then: list[Layer]) -> list[Layer]:
    """The ways through one segment and the next."""
    out = []
    for layer in first:
        row: Layer = []
        for to in range(4):
            ways = [(w[0] + then[s][to][0], w[1] + then[s][to][1]) for s, w in enumerate(layer) if w and then[s][to]]
            row.append(min(ways, default=None))
        out.append(row)
    return out


def cheapest(ways: list[Layer]) -> Way:
    """The best whole way: from nothing, insertions ahead of the first turn included, to nothing or an assistant's turn."""
    begin = _closed([(0, ""), None, None, None])
    layer = chained([begin], ways)[0]
    return min(w for w in (layer[START], layer[ASSISTANT]) if w)


COUNTS = ("blank", "duplicate", "truncated", "illegal")
PART_SQL = (
    "conv_id long, seg long, " + "".join(f"{c} long, " for c in COUNTS) + "head string, tail string, low long, high long, distinct_turns long, costs array<long>, audits array<string>"
)
PART = pa.schema(
    [("conv_id", pa.int64()), ("seg", pa.int64())]
    + [(c, pa.int64()) for c in COUNTS]
    + [("head", pa.string()), ("tail", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("distinct_turns", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def _flat(ways: list[Layer]) -> tuple[list[int], list[str]]:
    return [w[0] if w else NEVER for layer in ways for w in layer], [w[1] if w else "" for layer in ways for w in layer]


def _ways(costs: list[int], audits: list[str]) -> list[Layer]:
    flat = [(c, a) if c < NEVER else None for c, a in zip(costs, audits)]
    return [flat[i : i + 4] for i in range(0, 16, 4)]


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        rows = []
        for conv, seg, kinds, turns, repeats in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "seg", "kinds", "turns", "repeats"))):
            initials, faults = kinds[::2], list(kinds[1::2])
            for i in repeats or ():
                faults[i] = "d" if faults[i] != "b" else "b"
            known = [t for t in turns if t is not None]
            counts = [faults.count(f) for f in "bdt"] + [_illegal(initials)]
            spread = (known[0], known[-1], len(set(known))) if known else (None, None, 0)
            rows.append((conv, seg, *counts, initials[:1], initials[-1:], *spread, *_flat(passed(initials, "".join(faults)))))
        yield from _batch(rows, PART)


def _joined(p: dict, q: dict) -> dict:
    """Two neighbouring parts of a conversation as one."""
    out = {c: p[c] + q[c] for c in COUNTS} | {"conv_id": p["conv_id"], "seg": p["seg"]}
    if p["tail"] and q["head"]:
        out["illegal"] += _illegal(p["tail"] + q["head"])
    out["head"], out["tail"] = p["head"] or q["head"], q["tail"] or p["tail"]
    known = [x for x in (p, q) if x["low"] is not None]
    out["low"], out["high"] = (known[0]["low"], known[-1]["high"]) if known else (None, None)
    out["distinct_turns"] = p["distinct_turns"] + q["distinct_turns"] - (len(known) == 2 and p["high"] == q["low"])
    out["costs"], out["audits"] = _flat(chained(_ways(p["costs"], p["audits"]), _ways(q["costs"], q["audits"])))
    return out


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation, block and segment; each block becomes one row."""
    release()
    at, held = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if at == (row["conv_id"], row["block"]):
                held = _joined(held, row)
            else:
                out += [held] if held else []
                at, held = (row["conv_id"], row["block"]), row
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=PART)
    if held:
        yield pa.RecordBatch.from_pylist([held], schema=PART)


OUT = ("gaps", *COUNTS, "cost")
OUT_SQL = "conv_id long, " + "".join(f"{c} long, " for c in OUT) + "audit string, repaired_sha256 string"
OUT_SCHEMA = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in OUT] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


class Repaired:
    """Writes a conversation as its audit says, turn by turn; ``lines`` are the repaired ``role:text``."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.digest, self.empty = hashlib.sha256(), True
        self._insertions()

    def _write(self, role: str, text: str) -> None:
        self.digest.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty = False
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def _next(self) -> str:
        return "assistant" if self.state == USER else "user"

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._write(self._next(), "")

    def turn(self, role: str, text: str) -> None:
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._write(role if edit == "K" else self._next(), text)
        self._insertions()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's result row comes first, then its segments in order."""
    release()
    result, writer = None, None

    def finished() -> tuple:
        gaps = result["high"] - result["low"] + 1 - result["distinct_turns"] if result["low"] is not None else 0
        return (result["conv_id"], gaps, *[result[c] for c in COUNTS], *cost_of, writer.digest.hexdigest())

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["seg"] < 0:
                if result:
                    out.append(finished())
                result, cost_of = row, cheapest(_ways(row["costs"], row["audits"]))
                writer = Repaired(cost_of[1])
            else:
                for role, text in zip(row["roles"], row["texts"]):
                    writer.turn(role, text)
        yield from _batch(out, OUT_SCHEMA)
    if result:
        yield from _batch([finished()], OUT_SCHEMA)


def repaired(rows: DataFrame, *, role_order: str = "role", text_order: str = "text", segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text, copies``: faults, cheapest repair and its digest.

    ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. A row stands ``copies`` times in a row;
    conversations with none left have zeros, an empty audit and the empty string's hash. Rows of a conversation go by
    turn, nulls first; of equal turns by role, the text's first ``ORDER_CHARS`` characters and its hash (of the columns
    named as order). A null conv_id is a conversation. Empty texts are blank; texts of any length are read whole, and
    a segment ends after ``SEGMENT_CHARS`` characters. Repeated rows are duplicates after the first. Other columns are not read. An
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_order(rows, role_order, text_order, ["conv_id", "turn", "role", "text", "copies"])
    segments = materialise(ordered.mapInArrow(_segments(segment), SEGMENTS_SQL), "repair-segments")
    seen = segments.select("seg", F.posexplode("keys").alias("i", "key"))
    first = seen.groupBy("key").agg(F.min(F.struct("seg", "i")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeats = seen.join(first, "key").filter(F.struct("seg", "i") != F.col("first")).repartition(tasks, "seg").groupBy("seg").agg(F.collect_list("i").alias("repeats"))
    parts = segments.select("conv_id", "seg", "kinds", "turns").repartition(tasks, "seg").join(repeats, "seg", "left")
    parts = materialise(parts.mapInArrow(_pass, PART_SQL), "repair-parts")
    longest = parts.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    while longest > 1:  # one round for every factor of fan
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seg")) - 1
        blocks = parts.withColumn("block", F.floor(place / fan))
        dealt = blocks.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seg")
        parts = materialise(dealt.mapInArrow(_join, PART_SQL), "repair-parts")
        longest = -(-longest // fan)
    texts = segments.select("conv_id", "seg", "roles", "texts")
    both = parts.withColumn("seg", F.lit(-1).cast("long")).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_digests, OUT_SQL)


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged by rule, with its faults and its cheapest repair.

    Null, empty, very long and repeated rows, ties of turns, an empty table and further columns: as ``damaged`` and
    ``repaired`` say.
    """
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repaired(rows, role_order="role0", text_order="text0")


#: The same in SQL: layer by layer for all conversations at once.
CRC32_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"


OP12_SQL = f"""
WITH RECURSIVE {CRC32_SQL},
ids AS (SELECT DISTINCT conv_id FROM conversations),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT key, {crc32_sql("key")} % 20 AS fault FROM (SELECT DISTINCT key FROM k), crc_table),
d AS (SELECT conv_id, turn, role0, text0, CASE fault WHEN 4 THEN 'user' ELSE role0 END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text0, '.!?', '') ELSE text0 END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM k JOIN c ON k.key = c.key),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, copy) AS i FROM d),
f AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
g AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS both_initials FROM f),
edits(edit, price) AS (VALUES ('D', 3), ('R', 2), ('K', 0)),
closing(goes, state, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, state, {{'cost': CAST(2 * n AS BIGINT), 'audit': repeat('I', n)}} AS way FROM ids, closing WHERE goes = 0
  UNION ALL
  SELECT conv_id, i, closing.state, min({{'cost': CAST(way.cost + step + 2 * n AS BIGINT), 'audit': way.audit || edit || repeat('I', n)}}) AS way FROM (
    SELECT w.conv_id, g.i, w.way, edit, price + CASE WHEN edit <> 'D' AND fault = 't' THEN 1 ELSE 0 END AS step,
           CASE edit WHEN 'D' THEN w.state WHEN 'R' THEN CASE w.state WHEN 2 THEN 3 ELSE 2 END ELSE CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS goes
    FROM ways w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1, edits
    WHERE edit = 'D' OR (fault NOT IN ('b', 'd') AND (edit = 'R' OR (w.state, initial) IN ((0, 's'), (0, 'u'), (1, 'u'), (3, 'u'), (2, 'a'))))) JOIN closing USING (goes)
  GROUP BY conv_id, i, closing.state),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (both_initials NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
best AS (SELECT ids.conv_id, gaps, blank, duplicate, truncated, illegal, min(way) AS way FROM ids LEFT JOIN n ON ids.conv_id IS NOT DISTINCT FROM n.conv_id
         JOIN ways ON ways.conv_id IS NOT DISTINCT FROM ids.conv_id AND ways.i = coalesce(n, 0) AND state IN (0, 3) GROUP BY ALL),
letters AS (SELECT conv_id, unnest(string_split(way.audit, '')) AS edit, generate_subscripts(string_split(way.audit, ''), 1) AS pos FROM best WHERE way.audit <> ''),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS q FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
said AS (SELECT p.conv_id, pos, edit, q, role, text, initial FROM placed p LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i AND edit <> 'I' WHERE edit <> 'D'),
opening AS (SELECT conv_id, max(CASE WHEN q = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) AS s FROM said GROUP BY conv_id),
lines AS (SELECT said.conv_id, pos, CASE WHEN edit = 'K' THEN role WHEN (q - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END AS line
          FROM said JOIN opening ON opening.conv_id IS NOT DISTINCT FROM said.conv_id),
whole AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM lines GROUP BY conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       way.cost AS cost, way.audit AS audit, coalesce(digest, sha256('')) AS repaired_sha256 FROM best LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM best.conv_id
"""
