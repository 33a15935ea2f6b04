"""256-bit hashes against plain versions: bits, pairs, nearest rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators import hashes, neardup


def words_of(number):
    parts = [(number >> (64 * (3 - i))) & (2**64 - 1) for i in range(4)]
    return [p - 2**64 if p >= 2**63 else p for p in parts]


def near(rnd, number, bits):
    for i in rnd.sample(range(256), bits):
        number ^= 1 << i
    return number


def made(seed, centres=12):
    rnd = random.Random(seed)
    out = []
    for _ in range(centres):
        c = rnd.getrandbits(256)
        out += [("a" if rnd.random() < 0.7 else None, near(rnd, c, d)) for d in (0, 0, 1, 3, 5, 7, 9, 14, 20, 33)]
    out += [("lone", 5), ("pair", 0), ("pair", 2**256 - 1)]
    return [(i, g, h) for i, (g, h) in enumerate(rnd.sample(out, len(out)))]


def frame(spark, rows):
    return spark.createDataFrame([(i, g, None if h is None else words_of(h)) for i, g, h in rows], "id long, g string, hash array<long>")


def test_bits_of_texts(spark):
    rows = [(1, "The cat the CAT sat", "x"), (2, "", "x"), (3, None, "x"), (4, "ÄÖ  ü", None), (4, "The cat the CAT sat", "y")]
    df = spark.createDataFrame(rows, "doc long, text string, lang string")
    got = sorted((r.id, r.lang or "", r.hash) for r in hashes.wide_simhash(df, id_col="doc", text="text", keep=("lang",)).collect())
    narrow = sorted((r.id, r.hash) for r in neardup.simhash(df, id_col="doc", text="text").collect())
    want, want_narrow = [], []
    for doc, text, lang in rows:
        if text is not None:
            words = set(text.lower().split(" "))
            many = [int(hashlib.sha256(w.encode()).hexdigest(), 16) for w in words]
            few = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
            vote = lambda hs, n: sum(1 << i for i in range(n) if 2 * sum(h >> i & 1 for h in hs) > len(hs))
            want.append((doc, lang or "", words_of(vote(many, 256))))
            want_narrow.append((doc, vote(few, 60)))
    assert got == sorted(want) and narrow == sorted(want_narrow)


@pytest.mark.parametrize("threshold", [3, 6, 15, 31])
def test_pairs_are_all_pairs(spark, threshold):
    rows = made(threshold)
    classes = hashes.wide_classes(frame(spark, rows), "g")
    got = sorted((r.a, r.b, r.distance) for r in hashes.wide_pairs(classes, threshold=threshold).collect())
    first = {}
    for i, g, h in rows:
        first.setdefault((g, h), i)
    ids = [(i, g, h) for (g, h), i in first.items()]
    want = [(i, j, (h ^ k).bit_count()) for i, g, h in ids for j, o, k in ids if i < j and g == o and (h ^ k).bit_count() <= threshold]
    assert got == sorted(want)


@pytest.mark.parametrize("radii,block", [((3, 7, 15), 2048), ((3,), 7), ((0,), 5), ((31,), 2048)])
def test_nearest_of_all_rows(spark, radii, block):
    rows = made(block)
    classes = hashes.wide_classes(frame(spark, rows), "g")
    got = {r.id: r.nearest for r in hashes.wide_nearest(classes, radii=radii, block=block).collect()}
    first = {}
    for i, g, h in rows:
        first.setdefault((g, h), i)
    want = {}
    for (g, h), i in first.items():
        d = [(h ^ k).bit_count() for (o, k) in first if o == g and k != h]
        if d:
            want[i] = min(d)
    assert got == want and max(want.values()) == 256


def test_groups_with_nearest(spark):
    rows = [*made(1), (900, "a", None), (901, None, None)]
    got = {r.id: (r.component, r.nearest) for r in hashes.wide_groups(frame(spark, rows), threshold=6, by="g").collect()}
    part = {i: i for i, *_ in rows}
    for i, g, h in rows:
        for j, o, k in rows:
            if j < i and g == o and h is not None and k is not None and (h ^ k).bit_count() <= 6:
                low, high = sorted((part[i], part[j]))
                part = {x: low if p == high else p for x, p in part.items()}
    for i, g, h in rows:
        d = [(h ^ k).bit_count() for j, o, k in rows if j != i and o == g and h is not None and k is not None]
        assert got[i] == (part[i], min(d) if d else None)
    assert hashes.wide_groups(frame(spark, []), threshold=6, by="g").count() == 0


def judged(rows, least):
    """The pass in order, one row after another."""
    state, out = {}, {}
    for i, g, h, bad in rows:
        near = [(h ^ k).bit_count() for k in state.get(g, [])] if h is not None else []
        score = min(near) if near else None
        reasons = [r for r, on in (("AREA_OUT_OF_RANGE", bad), ("PHASH_DUPLICATE", score is not None and score < least)) if on]
        out[i] = (score, reasons)
        if not reasons and h is not None:
            state.setdefault(g, []).append(h)
    return out


@pytest.mark.parametrize("least,seed", [(5, 1), (8, 2), (15, 3)])
def test_filter_whose_state_is_what_it_accepted(spark, least, seed):
    from pyspark.sql import functions as F

    from siftlake.operators.rules import Rule

    rnd = random.Random(seed)
    rows = [(i, g or "n", h, rnd.random() < 0.3) for i, g, h in made(seed)] + [(800, "n", None, False), (801, "n", None, True)]
    df = spark.createDataFrame([(i, g, None if h is None else words_of(h), bad) for i, g, h, bad in rows], "id long, g string, h array<long>, bad boolean")
    rules = [Rule("area", "AREA_OUT_OF_RANGE", F.col("bad")), Rule("phash", "PHASH_DUPLICATE", F.col("phash_min_dist") < least)]
    got = {r.id: (r.phash_min_dist, r.reject_reasons) for r in neardup.filter_in_order(df, rules, least=least).collect()}
    assert got == judged(rows, least)
    assert any("PHASH_DUPLICATE" in r for _, r in got.values()) and any(s is not None and s > 40 for s, _ in got.values())


def accepted(n, edges):
    before, ok = {}, [True] * n
    for a, b in edges:
        before.setdefault(b, []).append(a)
    for b in range(n):
        ok[b] = not any(ok[a] for a in before.get(b, ()))
    return ok


def graphs():
    rnd = random.Random(9)
    shuffled = list(range(600))
    rnd.shuffle(shuffled)
    return {
        "random": (200, sorted({tuple(sorted(rnd.sample(range(200), 2))) for _ in range(420)}), 60),
        "ladder": (120, [(i, j) for i in range(120) for j in (i + 1, i + 2) if j < 120], 60),
        "chain": (20_000, [(i, i + 1) for i in range(19_999)], 500),
        "shuffled chain": (600, [tuple(sorted(e)) for e in zip(shuffled, shuffled[1:])], 40),
        "star": (300, [(0, i) for i in range(1, 300)] + [(i, 299) for i in range(1, 299)], 50),
    }


@pytest.mark.parametrize("name", list(graphs()))
def test_large_components_in_stretches(spark, name):
    n, edges, most = graphs()[name]
    rows = spark.range(n).selectExpr("id", "true AS eligible")
    got = neardup.greedy_accept(rows, spark.createDataFrame(edges, "a long, b long"), most=most).collect()
    ok = accepted(n, edges)
    assert len(got) == n and all(r.accepted == ok[r.id] for r in got)


def test_keyed_rows_are_not_broadcast(spark):
    """A table that is small without its keys is not taken for small with them."""
    rows = spark.range(500).select("id", F.lit("a").alias("g"), F.xxhash64("id").bitwiseAND(F.lit(2**60 - 1)).alias("hash"))
    pairs = neardup.banded_pairs(rows, bits=60, threshold=3, by="g")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_row_is_shuffled_a_fixed_number_of_times(spark):
    from siftlake.operators.cells import BLOCKS, cells

    for n in (3000, 9000):
        rows = spark.range(n).select("id", F.lit("a").alias("g"), F.array(F.col("id")).alias("h"))
        assert cells(rows, None, ["h"], one=100).count() == BLOCKS * n
        assert cells(rows, rows.limit(10), ["h"], one=100).count() == BLOCKS * (n + 10)


def cell_of(rows, a_block, b_block, side):
    import pyarrow as pa

    n = len(rows)
    columns = [pa.array(["a"] * n), *(pa.array([v] * n, pa.int32()) for v in (a_block, b_block, side)), pa.array([i for i, _ in rows], pa.int64()), pa.array([words_of(h) for _, h in rows], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["g", "a_block", "b_block", "side", "id", "h"])


@pytest.mark.parametrize("tile", [(12, 8), (7, 5), (1152, 1024)])
def test_differing_bits_by_products(monkeypatch, tile):
    """Three rows in one number, with the sparsest and fullest hashes and opposites among them."""
    monkeypatch.setattr(hashes, "TILE", tile)
    monkeypatch.setattr(hashes, "PACKED", 2)
    rnd, full = random.Random(5), 2**256 - 1
    made_ = {0, full, 1, full - 1, 2**128 - 1, full - 2**128 + 1, 2**64, full - 2**64, *(near(rnd, full, d) for d in (2, 3, 9)), *(near(rnd, 0, d) for d in (2, 3, 9))}
    made_ |= {near(rnd, c, d) for c in [rnd.getrandbits(256) for _ in range(9)] for d in (0, 1, 4, 6, 7)} | {full ^ h for h in list(made_)[:9]}
    rows = list(enumerate(rnd.sample(sorted(made_), len(made_))))
    a, b = rows[::2], rows[1::2]
    far = lambda h, k: (h ^ k).bit_count()

    def run(batches, threshold, **how):
        out = [r for t in hashes._close(threshold, True, **how)(iter(batches)) for r in t.to_pylist()]
        least = {}
        for r in out:
            if r["b"] is None:
                least[r["a"]] = min(least.get(r["a"], 999), r["distance"])
        return sorted((r["a"], r["b"], r["distance"]) for r in out if r["b"] is not None), least

    want = sorted((i, j, far(h, k)) for i, h in rows for j, k in rows if i < j and far(h, k) <= 6)
    assert run([cell_of(rows, 1, 1, 0)], 6) == (want, {i: min(far(h, k) for j, k in rows if j != i) for i, h in rows})
    least = {i: min(far(h, k) for _, k in y) for x, y in ((a, b), (b, a)) for i, h in x}
    pairs = sorted((min(i, j), max(i, j), far(h, k)) for i, h in a for j, k in b if far(h, k) <= 7)
    assert run([cell_of(a, 1, 2, 0), cell_of(b, 1, 2, 1)], 7) == (pairs, least)
    both = [cell_of(rows, 0, 0, 0), cell_of(b, 0, 0, 1)]
    assert run(both, None, both=True) == ([], {i: min(far(h, k) for j, k in b if j != i) for i, h in rows})
    earlier = {i: min(far(h, k) for j, k in b if j < i) for i, h in rows if i > b[0][0]}
    assert run(both, None, both=True, earlier=True) == ([], earlier)
    assert max(far(h, k) for _, h in rows for _, k in rows) == 256


def test_bits_of_long_texts(monkeypatch):
    """Counts of more words than a byte counts, and words that are unpacked in several goes."""
    import pyarrow as pa

    monkeypatch.setattr(hashes, "UNPACKED", 600)
    words = [f"w{i}é" for i in range(1200)]
    texts = [" ".join(words[:n] * 2) for n in (1, 254, 255, 256, 510, 511, 1200)] + ["", " ", "same " * 700]
    for bits, digest in ((256, lambda w: hashlib.sha256(w).digest()), (60, lambda w: hashlib.md5(w).digest()), (8, lambda w: b"\xf0" * 32)):
        got = hashes.majority_bits(pa.array(texts), digest, bits)
        for text, row in zip(texts, got):
            seen = [int.from_bytes(digest(w.encode()), "big") >> (8 * len(digest(b"")) - bits) for w in set(text.split(" "))]
            assert row.tolist() == [2 * sum(s >> (bits - 1 - i) & 1 for s in seen) > len(seen) for i in range(bits)]


@pytest.mark.parametrize("two", [False, True])
def test_cells_of_a_group_are_dealt_in_turn(spark, two):
    """A group's cells are as many in every partition, but for one."""
    from siftlake.operators.cells import BLOCKS, cells

    rows = spark.range(4000).select("id", F.lit("a").alias("g"), F.array(F.col("id")).alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cells(rows, rows if two else None, ["h"], one=100)
    held = found.select(F.spark_partition_id().alias("p"), "a_block", "b_block").distinct().groupBy("p").count().collect()
    count = BLOCKS * BLOCKS if two else BLOCKS * (BLOCKS + 1) // 2
    assert sum(r["count"] for r in held) == count and len(held) == min(parts, count)
    assert max(r["count"] for r in held) == -(-count // parts)
