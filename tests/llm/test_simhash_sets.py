from __future__ import annotations

import random

import corpus_pipeline
from siftlake.llm import simhash_sets
from tests.llm.common import documents, lower
from tests.llm.test_near_and_licenses import roots


def brute_set(text):
    words = lower(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_links(sets):
    similar = lambda a, b: not (a or b) or 10 * len(a & b) >= 8 * len(a | b)
    return [(i, j) for j in range(len(sets)) for i in range(j) if similar(sets[i], sets[j])]


def varied(seed, copies=12):
    rng = random.Random(seed)
    texts = []
    for _ in range(copies):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([60, 100, 500]))]
        texts.append(" ".join(words))
        for changed in (1, 1, 2, 3, 5, 10):
            other = list(words)
            for at in rng.sample(range(len(words)), changed):
                other[at] = f"x{rng.random()}"
            texts.append(" ".join(other))
    return texts


def test_stage_drops_copies_of_similarity_08(spark):
    texts = varied(7)
    docs = documents(spark, [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], clash=False)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    parts = roots(len(texts), brute_links([brute_set(t) for t in texts]))
    assert kept == [i for i, p in enumerate(parts) if p == i]


def test_large_groups_in_blocks(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(200), rng.randint(1, 5)):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    parts = roots(len(texts), brute_links([brute_set(t) for t in texts]))
    for block in (16, 4096):
        got = {r.doc_id: r.component_id for r in simhash_sets.near_components(docs, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == parts


def short_pairs(seed, tries=12):
    """Texts of 5 to 34 words in pairs at a similarity of just 0.8 or more, and just below; a phrase is in many of them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for n in range(1, 31):
        for i in range(tries):
            words = [word() for _ in range(n + 4)]
            if n > 8 and i % 2:
                words[:7] = "all of these begin with seven words".split()
            other = list(words)
            for _ in range(1 + i % 4):
                other = other[:-1] if rng.random() < 0.5 and len(other) > 5 else [*other, word()]
            texts += [" ".join(words), " ".join(other)]
    return texts


def test_no_pair_of_small_sets_is_missed(spark):
    texts = short_pairs(11)
    sets = [brute_set(t) for t in texts]
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)], clash=False)
    parts = roots(len(texts), brute_links(sets))
    at_08 = sum(10 * len(a & b) == 8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    assert at_08 > 10 and sum(p != i for i, p in enumerate(parts)) > 100
    for block in (8, 4096):
        got = {r.doc_id: r.component_id for r in simhash_sets.near_components(docs, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == parts


def test_small_sets_are_found_at_any_layout(spark):
    """The pairs do not come from fingerprints, so nothing depends on the number of documents."""
    texts = short_pairs(12)
    sets = [simhash_sets.shingles(t) for t in texts]
    rows = [(i, [int(x) for x in s.view("int64")]) for i, s in enumerate(sets) if len(s) <= simhash_sets.PARTNERS]
    found = simhash_sets.small_links(spark.createDataFrame(rows, "rep long, small array<long>")).collect()
    assert roots(len(texts), [(r.a, r.b) for r in found]) == roots(len(texts), brute_links([brute_set(t) for t in texts]))


def test_odd_rows(spark):
    got = simhash_sets.near_components(documents(spark)).toPandas().drop_duplicates("doc_id").set_index("doc_id")["component_id"]
    assert got[1] == got[2] == got[3] == 1 and got[12] == got[5] == got[4] == 4 and got[14] == 6
    assert simhash_sets.near_components(documents(spark, [], clash=False)).count() == 0
