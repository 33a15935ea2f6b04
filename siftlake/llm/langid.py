"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A text is parsed, once against each
language, into the longest pieces that occur in that language's sample. The more pieces it takes, the worse the
fit: pieces x log2(sample) / length estimates the cross entropy, and the least wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship
from siftlake.llm.held import hold

#: The sample: so many documents of a language, so many characters of each at most, and so many characters of a
#: language and of all languages together.
FIT_DOCS, FIT_CHARS, SAMPLE_CHARS, ALL_CHARS = 40, 5_000, 16_000, 400_000
#: Characters of a long text that are parsed side by side with the next ones, and those after whose steps a parse
#: from another start is compared with the first one.
BLOCK, COMPARED = 2048, 96
#: Transitions, those that do not exist included, up to which they are kept in an array: 32 MB.
PLAIN = 1 << 23
UNKNOWN, GAP = 0, 1
UNDETERMINED = "und"


def normalised(text: str) -> str:
    """Lower case; what stands between letters is one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of ``symbols``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


class Steps:
    """Transitions of automata: ``state * symbols + symbol`` gives the next state.

    Keys below ``PLAIN`` are places of an array; with more, as alphabets are large, a hash table holds them.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, size: int) -> None:
        self.plain = size <= PLAIN
        if self.plain:
            self.targets = np.full(size, -1, np.int32)
            self.targets[keys] = targets
            return
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several the last one stays
            mine = self.keys[at] == keys
            self.targets[at[mine]] = targets[mine]
            keys, targets, at = keys[~mine], targets[~mine], (at[~mine] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        if self.plain:
            return self.targets[keys]
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.targets[at], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.targets[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out


class Parser:
    """The automata of all languages, with one alphabet: every letter of the samples, the blank, and all other letters.

    Each language has one state more, in which it starts and which every symbol leaves with a new piece.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.languages = [name for name, _ in samples]
        codes = {c: i + 2 for i, c in enumerate(sorted({c for _, text in samples for c in text if c != " "}))}
        self.symbols = np.array([UNKNOWN if chr(i).isalpha() else GAP for i in range(0x110000)], np.int32)
        for c, code in codes.items():
            self.symbols[ord(c)] = code
        self.size = len(codes) + 2
        self.logs = np.array([np.log2(max(2, len(text))) for _, text in samples])
        keys, targets, base = [], [], 0
        self.apart, self.first = np.zeros((2, len(samples)), np.int32)
        for i, (_, text) in enumerate(samples):
            moves = suffix_automaton([GAP if c == " " else codes[c] for c in text])
            keys += [(base + state) * self.size + symbol for state, out in enumerate(moves) for symbol in out]
            targets += [base + target for out in moves for target in out.values()]
            self.first[i], self.apart[i] = base, base + len(moves)
            base += len(moves) + 1
        self.steps = Steps(np.array(keys, np.int64), np.array(targets, np.int32), base * self.size)
        root = self.steps((self.first[:, None] * np.int64(self.size) + np.arange(self.size)).ravel()).reshape(len(samples), self.size)
        self.again = np.where(root >= 0, root, self.apart[:, None]).astype(np.int32)  # where a new piece goes on

    def _advance(self, flat: np.ndarray, lang: np.ndarray, begins: np.ndarray, lengths: np.ndarray, state: np.ndarray):
        """Reads ``lengths`` symbols, the longest first, from ``begins`` on: new pieces, last states, and those of the first steps."""
        state, ended = state.copy(), np.zeros(len(state), np.int32)
        steps = int(lengths[0]) if len(lengths) else 0
        seen = np.full((2, min(steps, COMPARED), len(state)), -1, np.int32)
        active = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()
        for step in range(steps):
            n = active[step]
            symbols = flat[begins[:n] + step]
            to = self.steps(state[:n] * np.int64(self.size) + symbols)
            none = np.flatnonzero(to < 0)
            to[none] = self.again[lang[none], symbols[none]]
            ended[none] += 1
            state[:n] = to
            if step < COMPARED:
                seen[0, step, :n], seen[1, step, :n] = to, ended[:n]
        return ended, state, seen

    def _parse(self, flat: np.ndarray, lang: np.ndarray, begins: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
        """New pieces of each stretch; ``before`` says which stretch a stretch continues (-1: none).

        All stretches are read from a fresh start. Then each is read again from the state in which the one before it
        ends, until both readings are in the same state, as they are the same from there on. Those that end in
        another state than thought send the next ones round again, so the result is that of one reading throughout.
        """
        ended, last, seen = self._advance(flat, lang, begins, lengths, self.apart[lang])
        entry = self.apart[lang]
        todo = np.flatnonzero((before >= 0) & (last[before] != entry))
        while len(todo):
            entry[todo] = last[before[todo]]
            short = np.minimum(lengths[todo], COMPARED)
            order = np.argsort(-short, kind="stable")
            some = todo[order]
            new, state, other = self._advance(flat, lang[some], begins[some], short[order], entry[some])
            same = other[0] == seen[0][: len(other[0]), some]
            same &= other[0] >= 0
            met = same.any(axis=0)
            at = same.argmax(axis=0)
            lanes = np.arange(len(some))
            ended[some[met]] += (other[1][at, lanes] - seen[1][at, some])[met]
            rest, begun, pieces = some[~met], state[~met], new[~met]
            seen[:, : other.shape[1], rest] = other[:, :, ~met]  # now the reading to compare with
            left = lengths[rest] - np.minimum(lengths[rest], COMPARED)
            order = np.argsort(-left, kind="stable")
            more, state, _ = self._advance(flat, lang[rest[order]], begins[rest[order]] + np.minimum(lengths[rest[order]], COMPARED), left[order], begun[order])
            ended[rest[order]] = pieces[order] + more
            last[rest[order]] = state
            todo = np.flatnonzero((before >= 0) & (last[before] != entry))
        return ended

    def pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of each text by language, symbols of each text, and whether it has a letter."""
        lowered = [(t or "").lower() for t in texts]
        flat = self.symbols[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
        letters = np.bincount(owner, flat != GAP, len(texts)) > 0
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != GAP) | (flat[:-1] != GAP) | (owner[1:] != owner[:-1])
        flat, owner = flat[keep], owner[keep]
        sizes = np.bincount(owner, minlength=len(texts))
        pieces = np.zeros((len(self.languages), len(texts)), np.int64)
        if not len(flat) or not self.languages:
            return pieces, sizes, letters
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begins = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        lengths = np.minimum(BLOCK, sizes[of] - nth * BLOCK)
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(nth[order] > 0, place[order - 1], -1)
        for i, row in enumerate(pieces):
            counts = self._parse(flat, np.full(len(of), i), begins[order], lengths[order], before)
            row += np.bincount(of[order], counts, len(texts)).astype(np.int64)
        return pieces, sizes, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and how far the best one's entropy lies below the second best's (0 to 1)."""
        if not texts or not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        pieces, sizes, letters = self.pieces(texts)
        entropy = pieces * self.logs[:, None] / np.maximum(sizes, 1)
        best = entropy.argmin(axis=0)
        ranked = np.sort(entropy, axis=0)
        second = ranked[1] if len(ranked) > 1 else np.maximum(ranked[0], self.logs[0])
        margin = np.where(letters, 1 - ranked[0] / np.maximum(second, 1e-12), 0.0)
        return [self.languages[b] if x else UNDETERMINED for b, x in zip(best, letters)], np.clip(margin, 0, 1)


def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """One per Python worker: built from the samples, which are all that is sent to it."""
    return hold(("parser", samples), lambda: Parser(samples))


def samples(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """The bounded sample of ``text`` by ``lang`` of labelled rows, the language with most rows first.

    Documents with text and the lowest hashes of doc_id are chosen by ids alone, with a limit within each task before
    they meet; then only their texts are fetched, up to ``FIT_CHARS`` characters of each. Rows without a doc_id are
    never chosen. Languages whose chosen texts have no letter are not learned.
    """
    keys = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("lang", "doc_id", F.xxhash64("doc_id").alias("hash"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    chosen = keys.withColumn("nth", first).filter(F.col("nth") <= FIT_DOCS).select(F.col("lang").alias("fit_lang"), F.col("doc_id").alias("fit_id"))
    chosen = materialise(chosen.distinct(), "langid-chosen")  # a few ids: Spark sees the size and need not shuffle the texts
    same = (F.col("doc_id") == F.col("fit_id")) & (F.col("lang") == F.col("fit_lang"))
    rows = docs.select("doc_id", "lang", "text").join(chosen, same).select("lang", "doc_id", F.substring("text", 1, FIT_CHARS).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text or "")):
        texts.setdefault(row.lang, []).append(normalised(row.text or ""))
    limit = min(SAMPLE_CHARS, ALL_CHARS // max(1, len(texts)))
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    ordered = sorted(texts.items(), key=lambda x: (-counts[x[0]], x[0]))
    joined = ((name, " ".join(dict.fromkeys(t for t in parts if t))[:limit]) for name, parts in ordered)
    return tuple((name, text) for name, text in joined if text)


def _predict(fitted: tuple[tuple[str, str], ...]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(fitted)
        for batch in batches:
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return predict


def identify(docs: DataFrame, fitted: tuple[tuple[str, str], ...]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row's whole text.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned. Ties go to the
    language first in order of the samples. Repeated rows get equal results; an empty table gives an empty one.
    Only doc_id and text are read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_predict(fitted), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows without a doc_id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all of ``documents`` by samples of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = identify(docs, samples(docs.filter(~held_out(F.col("doc_id")))))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
