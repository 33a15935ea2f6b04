"""The registered queries themselves, over whole small tables, against plain versions."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlake.llm import licenses, packing, token_files, toxicity
from tests.llm.test_near_and_licenses import brute_base

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts_of(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in sorted(rows, key=lambda r: r.doc_id)}


def ids_of(text, end):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, small):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op3_token_files(spark, small).collect()}
    want, at = {}, 0
    for doc_id, text in texts_of(spark, small).items():
        ids = ids_of(text, 2)
        want[doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_packing(spark, small):
    got = packing.op8_best_two_fit(spark, small).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    parts = {d: p.sort_values("piece") for d, p in got.groupby("doc_id")}
    for doc_id, text in texts_of(spark, small).items():
        ids, own = ids_of(text, 0), parts[doc_id]
        assert own["piece"].tolist() == list(range(len(own))) and (len(own) == 1 or len(ids) > 2048)
        assert own["start"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist() and own["length"].sum() == len(ids)
        assert (own["length"][1:] == 2048).all() and own["length"].max() <= 2048
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, held in got.sort_values("offset").groupby("sequence_id"):
        assert held["offset"].tolist() == np.cumsum([0, *held["length"]])[:-1].tolist() and held["length"].sum() <= 2048


def test_license_scan(spark, small):
    rows = licenses.op5_license_scan(spark, small).collect()
    texts = texts_of(spark, small)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def brute_logit(model, text):
    zero = np.zeros(toxicity.DIM)
    words = [model.embeddings[toxicity.features(w)].astype(np.float64).sum(axis=0) for w in toxicity.words_of(text)]
    rows = [zero] * toxicity.PAD + words + [zero] * toxicity.PAD
    total, at = model.bias, 0
    for width, kernel in zip(toxicity.WIDTHS, model.filters):
        for f in range(toxicity.FILTERS):
            windows = [sum(rows[i + j] @ kernel[j, :, f] for j in range(width)) for i in range(toxicity.PAD + max(1, len(words)))]
            total += max(0.0, max(windows) + model.biases[at]) * model.weights[at]
            at += 1
    return total


def test_toxicity_query(spark, small):
    got = {r.doc_id: r for r in toxicity.op10_toxicity_cnn(spark, small).collect()}
    texts = texts_of(spark, small)
    assert sorted(got) == sorted(texts)
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scorer = toxicity.Scorer(model)
    for doc_id, text in texts.items():
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    some = [d for d, t in texts.items() if len(t or "") < 1500][:12]
    logits, guessed = scorer.logits([texts[d] for d in some])
    for d, logit, lang in zip(some, logits, guessed):
        assert abs(brute_logit(model, texts[d]) - logit) < 1e-3 * max(1, abs(logit))
        want = 1 / (1 + np.exp(-np.clip(logit - model.thresholds[lang], -40, 40)))
        assert abs(got[d].score - want) < 1e-6


def test_toxicity_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    words = [b"ab", b"abcd", b"abcdefg", b"zz", b"qrstuv"]
    table = np.array([toxicity.features(w) for w in words], np.int64)
    monkeypatch.setattr(toxicity, "RATE", 0.0)
    size = toxicity.FILTERS * len(toxicity.WIDTHS)
    model = toxicity.Model(
        np.zeros((toxicity.BUCKETS, toxicity.DIM)), [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS],
        rng.normal(0, 0.3, size), rng.normal(0, 1, size), 0.1, [], np.zeros((toxicity.LANGUAGE_BUCKETS, 0)), np.zeros(1),
    )
    buckets = np.unique(table)[1:] if 0 in table else np.unique(table)
    model.embeddings[buckets] = rng.normal(0, 1, (len(buckets), toxicity.DIM))
    docs, toxic = [np.array([0, 1, 2, 1]), np.array([3]), np.array([4, 0, 3])], np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0.0
        for doc, y in zip(docs, toxic):
            logit = brute_logit(model, b" ".join(words[i] for i in doc).decode())
            total += np.log1p(np.exp(-logit)) if y else np.log1p(np.exp(logit))
        return total / len(docs)

    usable = np.ones(toxicity.BUCKETS, bool)
    usable[0] = False
    sums = {"e": np.zeros(toxicity.BUCKETS) + 1e-30, "f": [np.zeros(k.shape) + 1e-30 for k in model.filters]}
    sums |= {"b": np.zeros(size) + 1e-30, "w": np.zeros(size) + 1e-30, "c": 1e-30}
    toxicity._step(model, sums, docs, toxic, table, usable)

    def slope(array, at):
        kept = array[at]
        array[at] = kept + 1e-6
        up = loss()
        array[at] = kept - 1e-6
        down = loss()
        array[at] = kept
        return (up - down) / 2e-6

    for name, array in (("b", model.biases), ("w", model.weights)):
        for i in range(0, size, 5):
            assert abs(slope(array, i) ** 2 - sums[name][i]) < 1e-7
    for kernel, squares in zip(model.filters, sums["f"]):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in kernel.shape)
            assert abs(slope(kernel, at) ** 2 - squares[at]) < 1e-7
    for bucket in buckets[:4]:
        mean = np.mean([slope(model.embeddings, (bucket, d)) ** 2 for d in range(toxicity.DIM)])
        assert abs(mean - sums["e"][bucket]) < 1e-7
