from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from siftlake.llm import licenses, simhash, simhash_sets
from siftlake.operators.components import connected_components
from tests.llm.common import ROWS, documents, lower


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in links:
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(n)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def all_links(fps):
    fps = np.array(fps, np.uint64)
    return [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(np.bitwise_count(fps[i] ^ fps[j])) <= 3]


def test_fingerprints_and_components(spark, small):
    got = simhash.op6_simhash_pigeonring(spark, small).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().sort_values("doc_id")
    fps = [brute_fingerprint(t) for t in docs["text"]]
    assert got["fingerprint"].tolist() == [f"{f:016x}" for f in fps]
    ids = docs["doc_id"].tolist()
    assert got["component_id"].tolist() == [ids[r] for r in roots(len(ids), all_links(fps))]


def test_odd_rows_and_empty_table(spark):
    got = simhash.near_components(documents(spark)).toPandas()
    assert len(got) == len(ROWS)
    by_id = got.drop_duplicates("doc_id").set_index("doc_id")["component_id"]
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[12] == by_id[5] == by_id[4] == 4 and by_id[14] == 6
    kept = simhash_sets.first_of_each(documents(spark))
    assert {1, 4, 6} <= {r.doc_id for r in kept.collect()} and not {2, 5, 12, 14} & {r.doc_id for r in kept.collect()}
    assert simhash.near_components(documents(spark, [], clash=False)).count() == 0


def test_every_link_survives_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 900:
        x = base
        for b in rng.integers(0, 64, int(rng.integers(1, 6))):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = np.array(sorted(fps), np.uint64)
    classes = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64), "rep": np.arange(len(fps))}))
    want = roots(len(fps), all_links(fps))
    for block in (32, 4096):
        found = simhash.links(simhash.ring_keys(classes), simhash.linked, block=block).toPandas()
        assert roots(len(fps), zip(found["a"], found["b"])) == want
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"fp": fps.view(np.int64), "rep": np.arange(len(fps))}))
    keyed = pa.Table.from_batches(simhash._keys([batch])).to_pandas().assign(pair=0).sort_values(["key", "rep"], kind="stable")
    batches = pa.Table.from_pandas(keyed, preserve_index=False).combine_chunks().to_batches(max_chunksize=333)
    for small, at_once in ((512, 700), (512, 10**6), (1, 700), (8, 5000), (40, 0)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        found = pa.Table.from_batches(simhash._links(batches, simhash.linked)).to_pandas()
        assert roots(len(fps), zip(found["a"], found["b"])) == want


def test_components_of_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = sorted((i, k) for k, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p)
    first, last = (places[0][0], places[-1][0]) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted({k for _, k in places}))


def test_base_phrases(spark):
    rows = [(100, "CC\nBY cc-by; all rights. Reserved", "en", "a", 0), (101, "x " * 39 + "cc by " + "y " * 38 + "general public license", "en", "a", 0)]
    rows += [(102, "General public license " * 60, "en", "a", 0), (103, "Ccé by cc by4 all rights reservedé", "en", "a", 0)]
    docs = documents(spark, ROWS + rows)
    got = licenses.scan(docs).collect()
    texts = {r[0]: r[1] for r in ROWS + rows}
    assert len(got) == len(ROWS + rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert licenses.scan(documents(spark, [], clash=False)).count() == 0


def test_join_finds_every_block():
    rng = random.Random(2)
    templates = licenses.PHRASES + licenses.NOTICES + licenses.LICENSES
    universe = sorted({w for t in templates for w in t.words})
    for _ in range(600):
        words = [rng.choice(universe) if rng.random() < 0.4 else b"x%d" % rng.randint(0, 9) for _ in range(rng.randint(0, 150))]
        for _ in range(3):
            at = rng.randint(0, len(words))
            words[at:at] = [x for x in rng.choice(templates).words if rng.random() < 0.9]
        joined = licenses.indexes(templates, tuple((w, rng.randint(0, 5)) for w in universe))
        want = {}
        for n, t in enumerate(templates):
            if t.phrase:
                places = [(i, 1.0) for i in range(len(words)) if tuple(words[i : i + len(t.words)]) == t.words]
            else:
                whole, places = set(t.words), []
                for at in range(0, len(words), t.stride):
                    block = set(words[at : at + 2 * t.stride])
                    if len(block & whole) >= math.ceil(t.share * len(whole) - 1e-9) and {x.encode() for x in t.needs} <= block:
                        places.append((at, len(block & whole) / len(whole)))
            if places:
                want[n] = places
        assert {k: sorted(v) for k, v in licenses.scan_words(joined, words).items()} == want


def test_whole_license_texts_are_found_in_longer_ones(spark):
    rows = [(i, "before it " * 130 + t.text.replace("software", "Software") + " and after", "en", "a", 0) for i, t in enumerate(licenses.LICENSES)]
    rows.append((99, "permission to use the software is granted " * 50, "en", "a", 0))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(documents(spark, rows)).collect()}
    assert all(t.label in got[i] for i, t in enumerate(licenses.LICENSES)) and got[99] == [""]
