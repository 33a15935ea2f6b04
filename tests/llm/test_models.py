from __future__ import annotations

import math
import random
import sys
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa

from siftlake.llm import bitsliced, gru, langid, lm, toxicity
from tests.llm.common import ROWS, documents


def test_bitsliced_block_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, d, k = rng.integers(1, 300), rng.integers(1, 9), int(rng.integers(1, 8))
        values, query = rng.integers(-9, 9, (n, d)), rng.integers(-9, 9, d)
        index, low = bitsliced.slices(values)
        ids = np.sort(rng.integers(0, 1000, n))
        own = int(rng.choice(ids))
        got = sorted(bitsliced.top_of_block(index, low, ids, query, own, k), key=lambda x: (-x[0], x[1]))
        want = sorted(((int(s), int(i)) for s, i in zip(values @ query, ids) if i != own), key=lambda x: (-x[0], x[1]))
        assert got == want[:k]


def test_bitsliced_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, []), (7, [-1.0, -0.5]), (50, [0.25, 0.25]), (None, [1.0, 1.0]), (1, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in bitsliced.top_k(df, df.filter("vec_id % 50 = 0"), 3).orderBy("query_id", "rank").collect()]
    full, low = 256 * 256 + 128 * 128, 64 * 256 + 64 * 128
    assert got == [(0, 1, 1, full), (0, 2, 1, full), (0, 3, 50, low), (50, 1, 0, low), (50, 2, 1, low), (50, 3, 1, low)]
    none = df.filter("vec_id < 0")
    assert bitsliced.top_k(none, none, 3).count() == 0


def brute_pieces(text, sample):
    at = count = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def test_cross_parsing_equals_brute_force():
    rng = random.Random(0)
    samples = (("a", "abracadabra abra"), ("b", "cabbage bad cab"))
    parser = langid.Parser(samples)
    texts = ["q" + "".join(rng.choice("abcdegr zx ") for _ in range(rng.randint(1, 40))) + "q" for _ in range(300)]
    pieces, sizes, letters = parser.pieces([*texts, None, "", "12 34"])
    for i, text in enumerate(texts):
        assert pieces[:, i].tolist() == [brute_pieces(langid.normalised(text), s) for _, s in samples]
    assert letters.tolist() == [True] * len(texts) + [False] * 3
    assert parser.predict([None, "", "12"])[0] == ["und"] * 3


def test_cross_parsing_of_long_texts_equals_brute_force(monkeypatch):
    rng = random.Random(1)
    samples = (("a", "abracadabra abra"), ("b", "cabbage bad cab"), ("c", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz"))
    for block, compared in ((2048, 96), (7, 3), (50, 1), (64, 64)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "COMPARED", compared)
        monkeypatch.setattr(langid, "PLAIN", 0 if block == 50 else 1 << 23)
        parser = langid.Parser(samples)
        texts = ["q" + "".join(rng.choice("abcdegr zx ") for _ in range(n)) + "q" for n in (10, 300, 5000)] + ["z" * 5000, "za" * 50]
        pieces, _, _ = parser.pieces(texts)
        for i, text in enumerate(texts):
            assert pieces[:, i].tolist() == [brute_pieces(langid.normalised(text), s) for _, s in samples]


def test_large_alphabets_and_languages_of_long_texts_only(spark):
    rng = random.Random(2)
    letters = lambda first: "".join(c for c in map(chr, range(first, first + 900)) if c.isalpha())
    scripts = {"zh": letters(0x4E00), "ja": letters(0x6000), "en": "abcdefghijklmnopqrstuvwxyz"}
    rows = []
    for lang, alphabet in scripts.items():
        words = ["".join(rng.choices(alphabet, k=rng.randint(1, 4))) for _ in range(300)]
        for i in range(60):
            n = 2000 if lang == "ja" else 30
            rows.append((len(rows), " ".join(rng.choices(words, k=n)), lang if i < 40 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for _, t, lang in rows if lang == "ja") > langid.FIT_CHARS
    fitted = langid.samples(docs)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, fitted).collect()}
    names = [n for n in scripts for _ in range(60)]
    assert {n for n, _ in fitted} == set(scripts) and [got[i] for i in range(len(rows))] == names


def test_languages_of_held_out_documents(spark, small):
    got = langid.op4_cross_parsing(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "n_chars").toPandas().merge(got, on="doc_id")
    judged = docs[docs["held_out"] & (docs["n_chars"] > 60)]
    assert len(got) == len(docs) and (judged["lang"] == judged["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_languages_of_odd_rows(spark):
    docs = documents(spark)
    fitted = langid.samples(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, fitted).collect()}
    assert got[1] == got[2] == got[3] == got[9] == ("und", 0.0) and got[4][0] == "en"
    assert {r.lang_pred for r in langid.identify(docs, ()).collect()} == {"und"}
    assert langid.samples(documents(spark, [], clash=False)) == ()


def test_gru_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    model = gru.Gru(np.array([0, 2, 5]), np.array([5, 4, 3, 2, 1.0]), np.array([3.0, 2.0]))
    for name in model.NAMES:
        value = getattr(model, name).astype(np.float64)
        setattr(model, name, value + rng.normal(0, 0.1, value.shape))
    x, y = rng.integers(0, 8, (6, 3)), rng.integers(0, 7, (6, 3))
    x[0], x[3, 1] = model.start, model.start

    def loss():
        h, total = np.zeros((3, gru.HIDDEN)), 0.0
        for t in range(6):
            h = model.step(np.where((x[t] == model.start)[:, None], 0, h), x[t])[0]
            total -= model.log_probability(h, y[t]).sum() / 3
        return total

    monkeypatch.setattr(gru, "CLIP", 1e9)
    monkeypatch.setattr(gru, "RATE", 0.0)
    model.sums = {n: np.zeros(getattr(model, n).shape) + 1e-30 for n in model.NAMES}
    model._learn(np.zeros((3, gru.HIDDEN)), x, y)
    for name in model.NAMES:
        value = getattr(model, name)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert abs(abs(up - down) / 2e-5 - math.sqrt(model.sums[name][at])) < 1e-6


def test_gru_probabilities_add_up_and_state_is_carried():
    model = gru.Gru(np.array([0, 2, 5]), np.array([5, 4, 3, 2, 1.0]), np.array([3.0, 2.0]))
    rng = np.random.default_rng(1)
    model.load(rng.normal(0, 0.5, len(model.weights())).astype(np.float32))
    h = rng.normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
    total = sum(math.exp(model.log_probability(h, np.array([s]))[0]) for s in range(7))
    assert abs(total - 1) < 1e-5
    docs = [rng.integers(0, 7, n) for n in (1, 3, 500, 40, 7)]
    want = []
    for doc in docs:
        h, score = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for before, token in zip([model.start, *doc[:-1]], doc):
            h = model.step(h, np.array([before]))[0]
            score += model.log_probability(h, np.array([token]))[0]
        want.append(score)
    assert np.allclose(model.score(docs), want, rtol=1e-4)


def test_lm_scores(spark, small):
    got = lm.op2_gru_scores(spark, small).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().sort_values("doc_id")
    end = object()
    counts = Counter()
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        if zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counts.update([*(text or "").encode().lower().split(), end])
    total, types = sum(counts.values()), len(counts)
    for r, text in zip(got.itertuples(), docs["text"]):
        tokens = [*(text or "").encode().lower().split(), end]
        base = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_lm_trains_on_every_document(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, i % 8, f"one two w{i % 7} three " * 5) for i in range(100)], "doc_id long, round int, text string")
    counts = docs.select("text").mapInArrow(lm._count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    v = lm.vocabulary(counts)
    seen, inner = spark.sparkContext.accumulator(0), lm._train

    def counted(*args):
        train = inner(*args)

        def run(batches):
            for out in train(batches):
                seen.add(sum(out.column("tokens").to_pylist()))
                yield out

        return run

    monkeypatch.setattr(lm, "_train", counted)
    shared = spark.sparkContext.broadcast(v)
    lm.train(docs.mapInArrow(lm._encode(shared), lm.ENCODED_SQL), v, shared)
    assert seen.value == 100 * 21 == v.tokens


def test_lm_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    got = lm.score(docs, F.lit(True)).collect()
    assert len(got) == len(ROWS) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    unlearned = lm.score(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in unlearned)
    assert lm.score(documents(spark, [], clash=False), F.lit(True)).count() == 0


def plain_words(text):
    return [*(text or "").encode().lower().split(), b""]


def calls_of(work):
    """Calls of Python and C functions that some work makes."""
    made = [0]

    def count(_frame, event, _arg):
        made[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return made[0]


def lm_batch(texts):
    n = len(texts)
    return pa.record_batch([pa.array(range(n), pa.int64()), pa.array([i % 8 for i in range(n)], pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "round", "text"])


def lm_vocabulary(counts):
    """As ``lm.vocabulary`` without Spark; the least frequent words are not listed."""
    words = [(b"", counts[b""])] + sorted(((w, n) for w, n in counts.items() if w), key=lambda x: (-x[1], x[0]))[: len(counts) // 2]
    f = max(1, len(words) // 2)
    words = sorted(words[:f], key=lambda x: (-x[1], x[0])) + words[f:]
    endings = {e: i for i, e in enumerate(sorted({w[-2:] for w in counts})[::2])}
    symbols = [i if i < f else f + lm.ending_class(w, endings) for i, (w, _) in enumerate(words)]
    values = np.array([n for _, n in words], np.float64)
    logs = np.log10(np.arange(2.0, 2 + len(endings) + lm.REST_CLASSES))
    return lm.Vocabulary(
        pa.array([w for w, _ in words], pa.binary()), np.array(symbols, np.int32), np.log10(values + 1), endings, f, logs,
        values[:f], lm.word_classes(values[:f]), sum(counts.values()), len(counts), values > 0,
    )


def test_lm_counts_and_symbols_equal_brute_force(monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 1)))
    rng = random.Random(5)
    odd = [None, "", "  ", " \t\na", "A\x1cB \x85 x y  Z ", "ÄPFEL äpfel Öl", " rare rare rare end ", "a\x0bb\x0cc\rd", "日本語　x \x00"]
    texts = odd + [" ".join(f"W{int(rng.paretovariate(0.6))}x" for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = [plain_words(t) for t in texts]
    want = Counter(w for doc in docs for w in doc)
    v = lm_vocabulary(Counter(w for doc in docs[9:] for w in doc))
    place = {w: i for i, w in enumerate(v.words.to_pylist())}
    for piece_bytes, counted in ((1 << 22, 500_000), (100, 20), (1, 1)):
        monkeypatch.setattr(lm, "PIECE_BYTES", piece_bytes)
        monkeypatch.setattr(lm, "COUNTED_WORDS", counted)
        got = Counter()
        for batch in lm._count(iter([lm_batch(texts[:50]), lm_batch([]), lm_batch(texts[50:])])):
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                got[word] += n
        assert got == want
        rows = [r for b in lm._encode(SimpleNamespace(value=v))(iter([lm_batch(texts)])) for r in b.to_pylist()]
        assert [(r["row"], r["doc_id"], r["round"]) for r in rows] == [((1 << 33) + i, i, i % 8) for i in range(len(texts))]
        for r, doc in zip(rows, docs):
            at = [place.get(w) for w in doc]
            symbols = [v.frequent + lm.ending_class(w, v.endings) if p is None else v.symbols[p] for p, w in zip(at, doc)]
            logs = [0.0 if p is None else v.logs[p] for p in at]
            assert np.frombuffer(r["symbols"], np.uint16).tolist() == symbols and r["n_tokens"] == len(doc)
            assert r["known"] == sum(p is not None and bool(v.known[p]) for p in at)
            assert {e["word"]: e["n"] for e in r["rare"]} == Counter(w for p, w in zip(at, doc) if p is None)
            assert math.isclose(r["base"], sum(logs) - len(doc) * math.log10(v.tokens + v.types + 1), rel_tol=1e-9, abs_tol=1e-9)
            outside = sum(g - v.class_logs[s - v.frequent] for g, s in zip(logs, symbols) if s >= v.frequent)
            assert math.isclose(r["outside"], outside, rel_tol=1e-9, abs_tol=1e-9)


def test_lm_handles_words_by_batch_not_one_by_one(monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    few = ["one two three four"] * 10
    many = ["one two three four " * 50] * 1000
    counts = Counter(w for t in few for w in plain_words(t))
    shared = SimpleNamespace(value=lm_vocabulary(counts))
    for work in (lm._count, lm._encode(shared)):
        calls = [calls_of(lambda: list(work(iter([lm_batch(texts)])))) for texts in (few, many)]
        assert calls[1] < 2 * calls[0]


def labelled(n, seed=0):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "an", "us", "pra", "do"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 80))], i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(["vermoid", "scumble", "grotch"]) + rng.choice(["", "en", "s"]))
        rows.append((i, " ".join(words), "xx", int(toxic)))
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "toxic"])


def test_toxicity_on_held_out_rows():
    train, other = labelled(800), labelled(300, seed=1)
    model = toxicity.fit_and_calibrate(train, {0: 600, 1: 200})
    logits, guessed = toxicity.Scorer(model).logits(other["text"].tolist())
    predicted = logits >= model.thresholds[guessed]
    assert (predicted == (other["toxic"] == 1)).mean() > 0.97


def test_toxicity_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, 1), (10, 0, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model)
    assert rows.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all(0 <= r.score <= 1 for r in rows.collect()) and rows.count() == len(ROWS)
    none = toxicity.train(docs, labels.filter("doc_id < 0"))
    kept = toxicity.without_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.without_toxic(documents(spark, [], clash=False), none).count() == 0


def test_toxicity_learns_every_labelled_row(spark, monkeypatch):
    data, kept = labelled(12_000), {}
    data["text"] = "always " + data["text"]
    docs = spark.createDataFrame(data[["doc_id", "text", "lang"]]).repartition(3)
    labels = spark.createDataFrame(data[["doc_id", "toxic"]])
    learned, judged = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    first, replica, judge = toxicity.first_model, toxicity._replica, toxicity._judge

    def counting(made, seen):
        def run(batches):
            def passed():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            yield from made(passed())

        return run

    monkeypatch.setattr(toxicity, "first_model", lambda seen, *rest: kept.update(seen=seen) or first(seen, *rest))
    monkeypatch.setattr(toxicity, "_replica", lambda *a: counting(replica(*a), learned))
    monkeypatch.setattr(toxicity, "_judge", lambda *a: counting(judge(*a), judged))
    monkeypatch.setattr(toxicity, "PER_REPLICA", 1500)
    monkeypatch.setattr(toxicity, "ROUND_ROWS", 3000)
    monkeypatch.setattr(toxicity, "LEARNED_ROWS", 1)
    model = toxicity.train(docs, labels)
    aside = [zlib.crc32(f"set aside {d}".encode()) % 5 == 0 for d in data["doc_id"]]
    fitted = data[[not a for a in aside]]
    at = toxicity.features(b"always")[0]
    assert kept["seen"][:, at].tolist() == [len(fitted), fitted["toxic"].sum()]
    assert (learned.value, judged.value) == (len(fitted), sum(aside))
    other = labelled(300, seed=1)
    logits, guessed = toxicity.Scorer(model).logits(other["text"].tolist())
    assert ((logits >= model.thresholds[guessed]) == (other["toxic"] == 1)).mean() > 0.9


def test_toxicity_learns_from_long_texts(spark):
    data = labelled(120)
    data["text"] = [t + " plain" * 4000 if y else t for t, y in zip(data["text"], data["toxic"])]
    docs, labels = spark.createDataFrame(data[["doc_id", "text", "lang"]]), spark.createDataFrame(data[["doc_id", "toxic"]])
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert data["text"].str.len().max() > 20_000 and {r.doc_id for r in rows if r.score >= 0.5} == set(data[data["toxic"] == 1]["doc_id"])
