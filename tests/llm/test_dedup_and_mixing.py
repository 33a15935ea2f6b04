from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siftlake.llm import dedup_exact, idset, mixing, queries
from tests.llm.common import ROWS, documents, lower


def duck(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", ["op1_bitsliced_topk", "op7_exact_dedup", "op9_pareto_mixing"])
def test_query_equals_its_sql(spark, small, name):
    got = queries.queries()[name](spark, small).toPandas()
    want = duck(small).sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [df[columns].sort_values(columns).reset_index(drop=True) for df in (got, want)]
    assert rows[0].astype(str).equals(rows[1].astype(str))


def test_golomb_rice_round_trip():
    rng = np.random.default_rng(0)
    for bits in (3, 20, 52):
        for n in (1, 2, 100, 5000):
            values = np.sort(rng.integers(0, 1 << bits, n, dtype=np.uint64))
            assert (dedup_exact.rice_decode(*dedup_exact.rice_encode(values), n) == values).all()


def test_exact_groups_on_odd_rows(spark):
    got = dedup_exact.exact_groups(documents(spark)).collect()
    by_text: dict[str, list[int]] = {}
    for doc_id, text, *_ in ROWS:
        by_text.setdefault(lower(text), []).append(doc_id)
    want = Counter()
    for text, ids in by_text.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        for doc_id in ids:
            want[(doc_id, max(ids), len(ids), doc_id == max(ids), digest)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_many_senders_and_owners(spark):
    rows = [(i, f"text {i % 700}", "en", "a", 0) for i in range(3000)]
    docs = documents(spark, rows, clash=False).repartition(5)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup_exact.exact_groups(docs, owners=16).collect()}
    members: dict[int, list[int]] = {}
    for i in range(3000):
        members.setdefault(i % 700, []).append(i)
    assert got == {i: (max(members[i % 700]), len(members[i % 700])) for i in range(3000)}


def test_kept_documents_and_ids(spark):
    docs = documents(spark)
    kept = dedup_exact.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 8, 9, 10, 11, 12, 12, 13, 14]
    gone = spark.createDataFrame([(3,), (12,)], "doc_id long")
    assert sorted(r.doc_id for r in idset.without_ids(docs, gone).collect()) == [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14]


def test_empty_tables(spark):
    docs = documents(spark, [], clash=False)
    assert dedup_exact.exact_groups(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert mixing.mixed_documents(docs).count() == 0


def water_fill(sizes, total_share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = total_share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_targets_are_water_filled(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 30):
        sizes = {f"s{i:02}": int(rng.integers(0, 500)) for i in range(n)} | {None: 50}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = water_fill(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix_reaches_targets_within_a_document(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", f"s{int(rng.integers(0, 4))}", 0) for i in range(2000)]
    got = mixing.mix(documents(spark, rows, clash=False), steps=16).toPandas()
    assert (got["copies"] <= 2).all() and (got["taken"] == got["copies"] * got["size"]).all()
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() / 2 + 1e-6
    again = mixing.mix(documents(spark, rows, clash=False).repartition(7), steps=64).toPandas()
    assert got.set_index("doc_id")["copies"].to_dict() == again.set_index("doc_id")["copies"].to_dict()


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    times = Counter(r[0] for r in ROWS)
    assert counts == Counter({d: c * times[d] for d, c in copies.items() if c})


def test_inclusion_frequencies_are_unequal_within_a_source(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.choice([3, 40, 300])), "en", f"s{i % 3}", 0) for i in range(9000)]
    got = mixing.mix(documents(spark, rows, clash=False)).toPandas()
    for _, part in got.groupby("source"):
        size, count = part["size"], len(part)
        digits = size.map(lambda n: len(f"{n:b}"))
        low, high = 0.0, 2.0
        for _ in range(60):  # the level at which expected words are the target
            level = (low + high) / 2
            low, high = (level, high) if (np.minimum(2, level * digits) * size).sum() < part["target"].iloc[0] else (low, level)
        copies = part["copies"].groupby(size).mean()
        expected = np.minimum(2, level * digits).groupby(size).mean()
        assert (abs(copies - expected) < 4 * 0.5 / np.sqrt(count / 3)).all()
        assert set(part["copies"] - np.floor(np.minimum(2, level * digits) + 1e-9)) <= {0, 1}
        assert expected.nunique() > 1 or (expected == 2).all()
