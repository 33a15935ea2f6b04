"""Clusters in rounds of mutual neighbours against the plain algorithm."""

from __future__ import annotations

import numpy as np
import pytest

from siftlake.operators import cluster, ward


def groups():
    rng = np.random.default_rng(5)
    made = {
        "three": np.concatenate([rng.normal(c, 0.3, (n, 3)) for c, n in (((0, 0, 0), 14), ((4, 0, 1), 9), ((0, 5, 2), 17))]),
        "two": np.concatenate([rng.normal(c, 0.2, (n, 3)) for c, n in ((0, 12), (3, 11))]),
        "noise": rng.normal(0, 1, (45, 3)),
        "flat": np.c_[rng.normal(0, 1, (20, 2)), np.ones(20)],
        "stray": np.concatenate([rng.normal(0, 0.1, (9, 3)), [[50.0, 50, 50]]]),
        "pair": rng.normal(0, 1, (2, 3)),
        "single": rng.normal(0, 1, (1, 3)),
    }
    return {g: x[rng.permutation(len(x))] for g, x in made.items()}


@pytest.mark.parametrize("few,block", [(1000, 1024), (4, 7)])
def test_clusters_of_all_rows(spark, few, block):
    rows, want, at = [], {}, 0
    for g, x in groups().items():
        labels, score = cluster.choose_clusters(cluster.balanced_features(x))
        for i, v in enumerate(x):
            rows.append((g, at + i, v.tolist(), "extra"))
            want[at + i] = (g, int(labels[i]), score)
        at += len(x)
    df = spark.createDataFrame([*rows, ("none", None, [1.0], ""), ("none", 999, None, ""), (None, 998, [1.0], "")], "kind string, id long, v array<double>, g string").repartition(3)
    got = {r.id: (r.kind, r.cluster, r.silhouette) for r in ward.ward_clusters(df, by="kind", few=few, block=block).collect()}
    assert set(got) == set(want)
    for i, (g, label, score) in want.items():
        assert got[i][:2] == (g, label)
        assert (got[i][2] is None) if score is None else abs(got[i][2] - score) < 1e-9
    assert {g: max(w[1] for w in want.values() if w[0] == g) for g in ("three", "two")} == {"three": 2, "two": 1}


def test_copies_and_no_rows(spark):
    rows = [("a", i, [float(i % 2), 1.0]) for i in range(20)] + [("b", 100 + i, [2.0, 2.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>")
    for few in (1000, 1):
        got = {r.id: (r.cluster, r.silhouette) for r in ward.ward_clusters(df, by="g", few=few, block=5).collect()}
        assert len(got) == 26 and all(got[i][0] == i % 2 and abs(got[i][1] - 1) < 1e-6 for i in range(20))
    assert ward.ward_clusters(df.limit(0), by="g").count() == 0


def test_rows_are_not_shuffled_by_block(spark, monkeypatch):
    made, dealt = {"rows": 0}, ward.cells

    def counted(rows, *args, **kwargs):
        out = dealt(rows, *args, **kwargs)
        made["rows"] = max(made["rows"], out.count() / max(1, rows.count()))
        return out

    monkeypatch.setattr(ward, "cells", counted)
    x = np.random.default_rng(2).normal(0, 1, (200, 3))
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, v array<double>")
    labels, score = cluster.choose_clusters(cluster.balanced_features(x))
    got = {r.id: (r.cluster, r.silhouette) for r in ward.ward_clusters(df, by="g", few=20, block=4).collect()}
    assert made["rows"] == 6 and [got[i][0] for i in range(200)] == labels.tolist() and abs(got[0][1] - score) < 1e-9
