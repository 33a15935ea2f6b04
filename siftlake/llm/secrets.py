"""Secrets: three fixed patterns, and runs of characters that a battery of randomness tests cannot tell from chance.

Every run of ``LEAST`` or more characters of the usual encodings is a candidate. Its encoding is the narrowest that holds
its characters. Under the hypothesis of independent, equally likely symbols of that encoding these statistics are
about standard normal: chi-squared of the symbol counts, the runs of two classes of symbols (digits and letters, or lower
case and the rest), the correlation of neighbours, and how many of the decoded bytes have their top bit. Their squares
add up to the statistic ``S``, small for keys.

Short runs of ordinary text pass such tests too, the more the shorter they are. So ordinary text is what is held against
it: all documents' text, written in each encoding and cut in windows of each length class, gives the
distribution of S without secrets. A candidate's p-value is the share of windows of its encoding and length class with an S as
small; within each such cell the Benjamini-Hochberg rule keeps the share of false discoveries at ``RATE``. Cells
are as many as the tables below say, so counts are all that leaves a task.
"""

from __future__ import annotations

import binascii
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.llm.held import release

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base; the number of characters at least of the named group.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
BASE = ((0, ASSIGN, 2, 8), (1, re.compile(r"AKIA[A-Z0-9]+"), 0, 16), (2, re.compile(r"[0-9a-f]{32,}"), 0, 32))

LEAST = 16
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{16,}+)={0,2}")
#: Lower ends of the length classes, whole groups of every encoding: windows have these lengths, which is to a longer
#: candidate's disadvantage.
LENGTHS = (16, 24, 32, 40, 48, 64, 96, 128)
CYCLE = sum(LENGTHS)
#: False discoveries among all at most, per cell; S in bins of ``WIDTH``, up to 0.999 of chance.
RATE, WIDTH, BINS = 0.05, 0.25, 74
#: Characters whose windows a task holds at once.
AT_ONCE = 1_000_000

#: Encodings, narrowest first: the symbols in order, which of them are the first class of the runs test, and
#: the symbols of a group that hold a byte's top bit, with its place there.
ALPHABETS = (
    ("hex", "0123456789abcdef", string.digits, (2, {0: 3})),
    ("base32", string.ascii_uppercase + "234567", "234567", (8, {0: 4, 1: 1, 3: 3, 4: 0, 6: 2})),
    ("base36", string.digits + string.ascii_lowercase, string.digits, (1, {})),
    ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", string.ascii_lowercase, (4, {0: 5, 1: 3, 2: 1})),
)
SIZES = tuple(len(symbols) for _, symbols, _, _ in ALPHABETS)
CLASSES = tuple(np.array([c in first for c in symbols], np.int8) for _, symbols, first, _ in ALPHABETS)
TOP_BITS = tuple(top for *_, top in ALPHABETS)


def _codes(symbols: str, also: dict[str, str]) -> np.ndarray:
    table = np.full(256, 255, np.uint8)
    for i, c in enumerate(symbols):
        table[ord(c)] = i
    for c, same in also.items():
        table[ord(c)] = symbols.index(same)
    return table


UPPER_CASE = dict(zip(string.ascii_uppercase, string.ascii_lowercase))
CODES = (
    _codes(ALPHABETS[0][1], {c: UPPER_CASE[c] for c in "ABCDEF"}),
    _codes(ALPHABETS[1][1], {}),
    _codes(ALPHABETS[2][1], UPPER_CASE),
    _codes(ALPHABETS[3][1], {"-": "+", "_": "/"}),
)
#: Which encoding holds a run, by what occurs in it. One case only, but for base64.
FORMS = (re.compile(r"[0-9a-f]+|[0-9A-F]+"), re.compile(r"[A-Z2-7]+"), re.compile(r"[0-9a-z]+|[0-9A-Z]+"))
ALNUM = (string.digits + string.ascii_letters).encode()
NOT_ALNUM = bytes(sorted(set(range(256)) - set(ALNUM)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the fixed patterns, by start, then kind; whole matches."""
    found = [(m.start(), kind, m.end()) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def encoding(run: str) -> int:
    return next((i for i, form in enumerate(FORMS) if form.fullmatch(run)), len(FORMS))


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, side="right")) - 1


def statistic(symbols: np.ndarray, code: int) -> np.ndarray:
    """S of each row of symbols of one encoding."""
    rows, n = symbols.shape
    k, first = SIZES[code], CLASSES[code]
    counts = np.bincount((np.arange(rows)[:, None] * k + symbols).ravel(), minlength=rows * k).reshape(rows, k)
    chi = (counts.astype(np.float64) ** 2).sum(axis=1) * k / n - n
    uniform = (chi - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
    share = first.mean()
    each = 2 * share * (1 - share)
    spread = (n - 1) * each * (1 - each) + 2 * (n - 2) * share * (1 - share) * (1 - 4 * share * (1 - share))
    member = first[symbols]
    runs = ((member[:, 1:] != member[:, :-1]).sum(axis=1) - (n - 1) * each) / np.sqrt(spread)
    x = symbols - np.float64((k - 1) / 2)
    serial = (x[:, 1:] * x[:, :-1]).sum(axis=1) / ((k * k - 1) / 12) / np.sqrt(n - 1)
    group, places = TOP_BITS[code]
    tops = [(symbols[:, i::group] >> bit) & 1 for i, bit in places.items()]
    known = sum(t.shape[1] for t in tops)
    top = (sum(t.sum(axis=1) for t in tops) - known / 2) / np.sqrt(known / 4) if known else 0.0
    return np.maximum(uniform, 0) ** 2 + runs**2 + serial**2 + top**2


def bins(s: np.ndarray) -> np.ndarray:
    return np.minimum(s / WIDTH, BINS).astype(np.int64)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """``start, end, cell, bin`` of the runs of a text."""
    out = []
    for m in RUN.finditer(text):
        code = encoding(m[1])
        symbols = CODES[code][np.frombuffer(m[1].encode(), np.uint8)]
        out.append((m.start(), m.end(), code * len(LENGTHS) + length_class(len(symbols)), int(bins(statistic(symbols[None].astype(np.int64), code))[0])))
    return out


def _base32(raw: np.ndarray) -> np.ndarray:
    """Symbols of whole groups of five bytes."""
    groups = raw.reshape(-1, 5).astype(np.uint64)
    number = (groups << np.array([32, 24, 16, 8, 0], np.uint64)).sum(axis=1, dtype=np.uint64)
    return ((number[:, None] >> np.arange(35, -1, -5, dtype=np.uint64)) & np.uint64(31)).astype(np.uint8).ravel()


def streams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``encoding, symbols, lengths``: the texts one after another in each encoding.

    As bytes in hexadecimal, base32 and base64 (whole groups of 15 bytes of each text), as lower-case letters and digits,
    and as words joined with capital initials.
    """
    raws = [t.encode() for t in texts]
    whole = [r[: len(r) // 15 * 15] for r in raws]
    sizes = np.array([len(r) for r in whole], np.int64)
    joined = b"".join(whole)
    raw = np.frombuffer(joined, np.uint8)
    yield 0, np.stack([raw >> 4, raw & 15], axis=1).ravel(), sizes * 2
    yield 1, _base32(raw), sizes // 5 * 8
    yield 3, CODES[3][np.frombuffer(binascii.b2a_base64(joined, newline=False), np.uint8)], sizes // 3 * 4
    for code, parts in ((2, [r.lower() for r in raws]), (3, [t.title().encode() for t in texts])):
        bare = [p.translate(None, NOT_ALNUM) for p in parts]
        yield code, CODES[code][np.frombuffer(b"".join(bare), np.uint8)], np.array([len(b) for b in bare], np.int64)


def windows(texts: list[str], counts: Counter) -> None:
    """Count S of ordinary text: of each text's stream, windows of the lengths in turn. They do not depend on other texts."""
    for code, symbols, sizes in streams(texts):
        starts = np.cumsum(sizes) - sizes
        cycles = -(-sizes // CYCLE)
        owner = np.repeat(np.arange(len(sizes)), cycles)
        begin = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(cycles) - cycles, cycles)) * CYCLE
        end = (starts + sizes)[owner]
        for i, length in enumerate(LENGTHS):
            own = begin + sum(LENGTHS[:i])
            own = own[own + length <= end]
            if len(own):
                found = bins(statistic(symbols[own[:, None] + np.arange(length)].astype(np.int64), code))
                for b, n in enumerate(np.bincount(found, minlength=BINS + 1)):
                    counts[code * len(LENGTHS) + i, b, 1] += int(n)


FOUND_SQL = (
    "doc_id long, base array<struct<start: int, kind: int, end: int>>, runs array<struct<start: int, end: int, cell: int, bin: int>>, "
    "counts array<struct<cell: int, bin: int, ordinary: int, n: long>>"
)


def _struct(names: tuple[str, ...], last: pa.DataType | None = None) -> pa.DataType:
    return pa.list_(pa.struct([(n, last if last and n == names[-1] else pa.int32()) for n in names]))


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("base", _struct(("start", "kind", "end"))), ("runs", _struct(("start", "end", "cell", "bin"))), ("counts", _struct(("cell", "bin", "ordinary", "n"), pa.int64()))]
)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document; last, a row with the counts of the task."""
    release()
    counts: Counter = Counter()

    def rows(ids: list, bases: list, runs: list, last: list) -> pa.RecordBatch:
        named = [
            [[dict(zip(("start", "kind", "end"), s)) for s in spans] for spans in bases],
            [[dict(zip(("start", "end", "cell", "bin"), s)) for s in spans] for spans in runs],
            [None if c is None else [dict(zip(("cell", "bin", "ordinary", "n"), (*key, n))) for key, n in c.items()] for c in last],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, *named], FOUND.types)], schema=FOUND)

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        runs = [candidates(t) for t in texts]
        counts.update((cell, b, 0) for own in runs for _, _, cell, b in own)
        at = 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= AT_ONCE):
                chars, upto = chars + len(texts[upto]), upto + 1
            windows(texts[at:upto], counts)
            at = upto
        yield rows(batch.column("doc_id").to_pylist(), [base_spans(t) for t in texts], [[r for r in own if r[3] < BINS] for own in runs], [None] * len(texts))
    yield rows([None], [[]], [[]], [counts])


def limits(counts: DataFrame, rate: float = RATE) -> DataFrame:
    """``cell, limit``: the largest bin of which the rule's share of false discoveries is at most ``rate``; none, no row.

    Of ``cell, bin, ordinary, n``; at most a row for each bin of each cell.
    """
    by_bin = counts.groupBy("cell", "bin").agg(*[F.sum(F.when(F.col("ordinary") == o, F.col("n")).otherwise(0)).alias(name) for o, name in ((0, "runs"), (1, "windows"))])
    cell = Window.partitionBy("cell")
    upto = cell.orderBy("bin")
    p = (1 + F.sum("windows").over(upto)) / (1 + F.sum("windows").over(cell))
    false = F.try_divide(p * F.sum("runs").over(cell), F.sum("runs").over(upto))
    return by_bin.withColumn("false", false).filter((F.col("bin") < BINS) & (F.col("false") <= rate)).groupBy("cell").agg(F.max("bin").alias("limit"))


def _number(kind: int) -> F.Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _listed(spans) -> F.Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, *, rate: float = RATE) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, the fixed patterns' and then ``random`` for runs that pass, which may lie
    inside others. A null text is empty; texts are read whole, whatever their length; rows that repeat a doc_id, or
    have none, are rows of their own; other columns are not read. An empty table gives an empty result. What is called
    random depends on all documents: in a few there is too little ordinary text to rule out chance.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(rows.mapInArrow(_found, FOUND_SQL), "secret-runs")
    known = limits(found.filter("counts IS NOT NULL").select(F.inline("counts")), rate).collect()  # a row a cell at most
    spans = F.col("base")
    if known:
        limit = F.create_map(*[F.lit(v) for r in known for v in (r["cell"], r["limit"])])
        passed = F.filter("runs", lambda r: F.coalesce(r["bin"] <= F.element_at(limit, r["cell"]), F.lit(False)))
        spans = F.concat(spans, F.transform(passed, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end"))))
    number = {f"n_{k}": _number(i) for i, k in enumerate(KINDS[:3])}
    documents = found.filter("counts IS NULL")
    return documents.select("doc_id", *[c.alias(n) for n, c in number.items()], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def op11_secret_spans(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` with the spans of their secrets. Odd rows and empty tables: as ``secret_spans`` says."""
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
