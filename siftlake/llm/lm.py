"""Scoring documents with a gated recurrent language model over the corpus's own vocabulary.

All training documents are counted: every word's count enters the model, as the share of its class for words
outside the network and as the starting point of the network's biases. Then all documents are written as symbols,
once. The network is trained on all training documents, each once: a round takes its part of them, replicas train
on parts of that by truncated backpropagation as the rows come in, and their states are averaged after every round.

Three kinds of words are told apart by count. *Frequent* words are outputs of the network. *Listed* words are so
many more whose counts are sent to every worker. The counts of all *other* words stay in their table and are
joined to the documents' words. A word outside the network gets the probability of its class, which the network
predicts, times (count + 1) over the class's total; a class has one further share of 1 for all unseen words, so
the probabilities of all words add up to one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.llm.gru import Gru

END = b""
FREQUENT, LISTED = 2000, 200_000
WORD_CLASSES, ENDINGS, REST_CLASSES = 40, 63, 17
#: Every training document trains the network in one of ROUNDS rounds, PER_REPLICA documents or more to a task.
ROUNDS, PER_REPLICA = 8, 192
#: Tasks that add up the replicas' states; the driver gets a row of each.
ADDERS = 4
COUNTED_WORDS = 500_000
#: Bytes of text, and those of one more document, that are cut into words at once.
PIECE_BYTES = 4_000_000
#: Symbols of the documents that a task trains on or scores at once.
TRAIN_SYMBOLS, GROUP_SYMBOLS = 1_000_000, 1_500_000


def words_of(texts: pa.Array) -> pa.ListArray:
    """Words between ASCII white space, A-Z lower-cased, and one end of every text."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ended = pc.if_else(pc.equal(trimmed, ""), trimmed, pc.binary_join_element_wise(trimmed, "", " "))
    return pc.ascii_split_whitespace(ended)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``PIECE_BYTES`` bytes of text, as words take more room than texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        runs = np.cumsum(sizes.astype(np.int64)) // PIECE_BYTES
        edges = [*np.flatnonzero(np.diff(runs, prepend=-1)).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task; it hands them on whenever it holds ``COUNTED_WORDS`` words."""

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    held, rows = [], 0
    for piece in _pieces(batches):
        found = words_of(piece.column("text")).flatten().value_counts()
        held.append(pa.table([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"]))
        rows += len(found)
        if rows > 2 * COUNTED_WORDS:
            held = [summed(held)]
            rows = len(held[0])
            if rows > COUNTED_WORDS:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from summed(held).to_batches()


@dataclass
class Vocabulary:
    """What a worker needs to know of the words: symbols and log10(count + 1) of the listed ones, and the classes."""

    words: pa.Array  # a word's place here is its place in the two arrays
    symbols: np.ndarray
    logs: np.ndarray
    endings: dict[bytes, int]
    frequent: int
    class_logs: np.ndarray  # log10 of the total of each class outside the network
    frequent_counts: np.ndarray
    first: np.ndarray
    tokens: int
    types: int
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of words in the lists; -1: not listed."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def other_classes(self, words: pa.Array) -> np.ndarray:
        ends = pc.binary_slice(words, -2, None).dictionary_encode()
        classes = [ending_class(end, self.endings) for end in ends.dictionary.to_pylist()]
        return np.array(classes, np.int32)[ends.indices.to_numpy()]


def ending_class(word: bytes, endings: dict[bytes, int]) -> int:
    end = word[-2:]
    found = endings.get(end)
    return len(endings) + zlib.crc32(end) % REST_CLASSES if found is None else found


def word_classes(counts: np.ndarray, classes: int = WORD_CLASSES) -> np.ndarray:
    """Bounds of classes of words, given in descending order of count, of about equal sums of square roots."""
    mass = np.cumsum(np.sqrt(counts + 1.0))
    bounds = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate([[0], np.minimum(bounds, len(counts)), [len(counts)]]))


def _most_frequent(counts: DataFrame) -> DataFrame:
    """At most ``LISTED`` of the most frequent words: those above a step of log count, found from the sizes of the steps.

    A sort with a limit would send as many rows from every task.
    """
    step = F.floor(F.log2("n") * 64)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, room = float("inf"), LISTED
    for row in sorted(sizes, key=lambda r: -r.step):
        room -= row.words
        if room < 0:
            break
        least = row.step
    return counts.filter(step >= F.lit(float(least)))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Reads the table of counts: totals, the most frequent words (bounded), and totals by two-byte ending (bounded)."""
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = sorted(_most_frequent(counts.filter(F.length("word") > 0)).collect(), key=lambda r: (-r.n, bytes(r.word)))
    end = counts.filter(F.length("word") == 0).collect()
    words = [(END, end[0].n if end else 0)] + [(bytes(r.word), r.n) for r in top]
    frequent = sorted(words[: FREQUENT + 1], key=lambda x: (-x[1], x[0]))
    words = frequent + words[FREQUENT + 1 :]
    ending = F.substring("word", -2, 2)
    sums = counts.filter(F.length("word") > 0).groupBy(ending.alias("ending")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    mass = {bytes(r.ending): [r.n, r.v] for r in sums}
    for word, n in frequent:
        if word:
            mass[word[-2:]][0] -= n
            mass[word[-2:]][1] -= 1
    largest = sorted(mass, key=lambda e: (-sum(mass[e]), e))[:ENDINGS]
    endings = {e: i for i, e in enumerate(sorted(largest))}
    totals = np.ones(len(endings) + REST_CLASSES)
    for e, (n, v) in mass.items():
        totals[ending_class(e, endings)] += n + v
    f = len(frequent)
    symbols = np.array([i if i < f else f + ending_class(w, endings) for i, (w, _) in enumerate(words)], np.int32)
    values = np.array([n for _, n in words], np.float64)
    return Vocabulary(
        pa.array([w for w, _ in words], pa.binary()),
        symbols,
        np.log10(values + 1),
        endings,
        f,
        np.log10(totals),
        values[:f],
        word_classes(values[:f]),
        int(total.n or 0),
        int(total.v or 0),
        values > 0,
    )


def network(v: Vocabulary) -> Gru:
    return Gru(v.first, v.frequent_counts, 10.0**v.class_logs)


ENCODED_SQL = (
    "row long, doc_id long, round int, symbols binary, n_tokens long, known long, base double, outside double, "
    "rare array<struct<word:binary,n:int>>"
)
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
_ENCODED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("round", pa.int32()), ("symbols", pa.binary()), ("n_tokens", pa.int64())]
    + [("known", pa.int64()), ("base", pa.float64()), ("outside", pa.float64()), ("rare", _RARE)]
)


def _encode(shared: Broadcast):
    """Symbols of every document, and what its score owes to counts: words outside the network and the base score.

    Words that are not listed are handed on, to be looked up in the table of counts.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        row = TaskContext.get().partitionId() << 33
        unseen = np.log10(v.tokens + v.types + 1)
        for piece in _pieces(batches):
            lists = words_of(piece.column("text"))
            n, edges = len(lists), lists.offsets.to_numpy()
            begins, lengths = edges[:-1], np.diff(edges).astype(np.int64)
            tokens = lists.flatten().dictionary_encode()
            words, codes = tokens.dictionary.cast(pa.binary()), tokens.indices.to_numpy()
            # Of every distinct word:
            places = v.places(words)
            listed, unlisted = places >= 0, np.flatnonzero(places < 0)
            symbols = v.symbols[places]
            symbols[unlisted] = v.frequent + v.other_classes(words.take(pa.array(unlisted)))
            logs = np.where(listed, v.logs[places], 0.0)
            outside = symbols >= v.frequent
            out = np.zeros(len(words))
            out[outside] = logs[outside] - v.class_logs[symbols[outside] - v.frequent]
            known = (listed & v.known[places]).astype(np.int64)
            # Of every document, each of which has its end at least:
            data = symbols.astype(np.uint16)[codes]
            written = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.astype(np.int32) * 2), pa.py_buffer(data)])
            known, base, out = (np.add.reduceat(x[codes], begins) for x in (known, logs, out))
            at = np.flatnonzero(~listed[codes])
            keys = np.repeat(np.arange(n), lengths)[at] * len(words) + codes[at]
            keys, times = np.unique(keys, return_counts=True)
            rare = [words.take(pa.array(keys % len(words))), pa.array(times, pa.int32())]
            rare = pa.StructArray.from_arrays(rare, fields=list(_RARE.value_type))
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(keys, np.arange(n + 1) * len(words)), pa.int32()), rare, type=_RARE)
            columns = [np.arange(row, row + n), piece.column("doc_id"), piece.column("round"), written, lengths]
            columns += [known, base - lengths * unseen, out, rare]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_ENCODED)
            row += n

    return encoded


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint16).astype(np.int32) for s in batch.column("symbols").to_pylist()]


def _train(shared: Broadcast, state: Broadcast | None, round_: int):
    """A replica: learns from documents as they come, ``TRAIN_SYMBOLS`` symbols or a little more at a time."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = network(shared.value)
        if state is not None:
            model.load(state.value)
        seed, tokens, held, size = 1000 * TaskContext.get().partitionId() + round_, 0, [], 0
        for batch in batches:
            for doc in _symbols(batch):
                held.append(doc)
                size += len(doc)
                if size > TRAIN_SYMBOLS:
                    tokens += model.train(held, seed=seed + tokens)
                    held, size = [], 0
        tokens += model.train(held, seed=seed + tokens)
        if tokens:
            columns = [pa.array([tokens], pa.int64()), pa.array([model.state().tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["tokens", "state"])

    return train


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of replicas' states, each as often as it has tokens."""
    tokens, total = 0, 0.0
    for batch in batches:
        for n, state in zip(batch.column("tokens").to_pylist(), batch.column("state")):
            total = total + n * np.frombuffer(state.as_buffer(), np.float32).astype(np.float64)
            tokens += n
    if tokens:
        columns = [pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["tokens", "state"])


def train(encoded: DataFrame, v: Vocabulary, shared: Broadcast) -> Gru:
    """Train the network on ``symbols`` of all rows, each in its ``round`` (null: not at all).

    Only averaged states come to the driver, ``ADDERS`` of them after each round.
    """
    spark = encoded.sparkSession
    model, state = network(v), None
    sizes = {r["round"]: r["count"] for r in encoded.filter("round IS NOT NULL").groupBy("round").count().collect()}
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for round_, size in sorted(sizes.items()):
        part = encoded.filter(F.col("round") == round_).select("symbols").repartition(max(1, min(most, size // PER_REPLICA)))
        trained = part.mapInArrow(_train(shared, state, round_), "tokens long, state binary")
        added = trained.repartition(ADDERS).mapInArrow(_add, "tokens long, state binary").collect()
        if added:
            tokens = sum(r.tokens for r in added)
            model.load(sum(np.frombuffer(r.state, np.float32) * (r.tokens / tokens) for r in added))
            state = spark.sparkContext.broadcast(model.state())
    return model


SCORED_SQL = "row long, doc_id long, n_tokens long, known long, base double, score double"


def _score(shared: Broadcast, weights: Broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = network(shared.value)
        model.load(weights.value)

        def scored(held: list[pa.RecordBatch], docs: list[np.ndarray]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            totals = model.score(docs) / np.log(10) + rows.column("outside").to_numpy()
            rows = rows.select(["row", "doc_id", "n_tokens", "known", "base"]).append_column("score", pa.array(totals, pa.float64()))
            return rows.combine_chunks().to_batches()[0]

        held, docs, size = [], [], 0
        for batch in batches:
            new = _symbols(batch)
            held.append(batch)
            docs += new
            size += sum(map(len, new))
            if size > GROUP_SYMBOLS:
                yield scored(held, docs)
                held, docs, size = [], [], 0
        if docs:
            yield scored(held, docs)

    return score


def score(docs: DataFrame, training: Column) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``doc_id, text``.

    ``training`` says of which rows the model learns. Scores are log10 probabilities of the whole text: its words
    and one end. A null or empty text is the end alone. ``base_score`` is that of add-one unigram counts. Repeated
    rows get equal scores; an empty table gives an empty result. Other columns are not read. Without training rows every word is unseen.
    """
    spark = docs.sparkSession
    ship(spark)
    learned = F.coalesce(training, F.lit(False))
    counts = docs.filter(learned).select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "lm-counts")
    v = vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    round_ = F.when(learned, F.pmod(F.xxhash64(F.lit("lm"), "doc_id"), F.lit(ROUNDS))).cast("int").alias("round")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), round_, "text")
    encoded = materialise(rows.mapInArrow(_encode(shared), ENCODED_SQL), "lm-encoded")
    weights = spark.sparkContext.broadcast(train(encoded, v, shared).weights())
    scored = encoded.drop("round", "rare").mapInArrow(_score(shared, weights), SCORED_SQL)
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    found = rare.join(counts, "word")
    added = found.groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more")
    )
    out = scored.join(added, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def op2_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents`` by a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = score(docs, F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), *columns)
