from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.operators import bundle, kernels

SCHEMA = "object string, input_name string, type string, passed boolean, id long, v array<double>"


def rows_at_random(seed, n, d):
    draw = np.random.default_rng(seed)
    kinds = [("ab"[i % 2], ["in0", "in1"][i // 2 % 2], f"t{int(draw.integers(4))}", bool(draw.integers(2)), i) for i in range(n)]
    return [(*k, v) for k, v in zip(kinds, draw.normal(size=(n, d)).round(3).tolist())]


def metrics(x, r, biased=False):
    """Of matrices with rows by id."""
    ux, ur = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, r))
    c = ux @ ur.T
    nn = c.max(axis=1)
    forth, back = c.argmax(axis=1), c.argmax(axis=0)
    k = lambda a, b: (a @ b.T / a.shape[1] + 1) ** 3
    off = lambda a: (k(a, a).sum() - np.trace(k(a, a))) / (len(a) * (len(a) - 1))
    kid = fid = None
    if biased:
        kid = k(x, x).mean() + k(r, r).mean() - 2 * k(x, r).mean()
    elif min(len(x), len(r)) > 1:
        kid = off(x) + off(r) - 2 * k(x, r).mean()
    if min(len(x), len(r)) > 1:
        a, b = ((m - m.mean(axis=0)).T / np.sqrt(len(m) - 1) for m in (x, r))
        overlap = np.linalg.svd(a.T @ b, compute_uv=False).sum()
        fid = max(0.0, ((x.mean(axis=0) - r.mean(axis=0)) ** 2).sum() + (a**2).sum() + (b**2).sum() - 2 * overlap)
    return dict(nn_mean=nn.mean(), nn_min=nn.min(), nn_median=np.median(nn), nn_p05=np.quantile(nn, 0.05), nn_p95=np.quantile(nn, 0.95), mnn_score=np.mean(forth[back] == np.arange(len(r))), kid=kid, fid=fid)


def by_hand(x, r, inputs, views, biased=False):
    out = {}
    of = lambda rows: np.array([p[-1] for p in sorted(rows, key=lambda p: p[-2])])
    for view in views:
        for name in inputs:
            for o in {p[0] for p in r}:
                for label in [*{p[2] for p in x if p[0] == o and p[1] == name}, bundle.ALL]:
                    own = [p for p in r if p[0] == o and p[1] == label]
                    scope, refs = (f"type:{label}", own) if own else (bundle.OBJECT_ALL, [p for p in r if p[0] == o])
                    mine = [p for p in x if p[0] == o and p[1] == name and label in (p[2], bundle.ALL) and (view == "unfiltered" or p[3])]
                    out[(view, name, o, label)] = (scope, len(refs), len(mine), metrics(of(mine), of(refs), biased) if mine else None)
    return out


def same(found, want):
    assert {tuple(r[g] for g in bundle.GROUP) for r in found} == set(want) and len(found) == len(want)
    for row in found:
        scope, n_real, n, values = want[tuple(row[g] for g in bundle.GROUP)]
        assert (row.real_scope, row.n_real, row.n_generated, row.status) == (scope, n_real, n, "ok" if n else "empty")
        for name in ("nn_mean", "nn_min", "nn_median", "nn_p05", "nn_p95", "mnn_score", "kid", "fid"):
            value = values and values[name]
            assert (row[name] is None) == (value is None), (name, row)
            if value is not None:
                assert row[name] == pytest.approx(value, rel=1e-9, abs=2e-6 if name == "fid" else 1e-9), (name, row)


@pytest.mark.parametrize("d", [1, 2, 5, 12])
def test_features_are_the_kernel(d):
    draw = np.random.default_rng(d)
    x, y = draw.normal(size=(7, d)), draw.normal(size=(9, d))
    assert kernels.features(x) @ kernels.features(y) == pytest.approx(((x @ y.T / d + 1) ** 3).sum(), rel=1e-12)
    assert len(kernels.features(x)) == (d + 1) * (d + 2) * (d + 3) // 6


@pytest.mark.parametrize("biased, block, d", [(False, 4, 6), (True, 2048, 6), (False, 2048, 40)])
def test_all_groups(spark, biased, block, d):
    x = rows_at_random(1, 90, d)
    r = [(o, t, i, v) for o, _, t, _, i, v in rows_at_random(2, 25, d) if t != "t3"]
    r.append(("c", "t0", 99, [1.0] * d))  # one reference, no generated rows
    odd = [("a", "other", "t0", True, 900, [1.0] * d), ("z", "in0", "t0", True, 901, [1.0] * d), (None, "in0", "t0", True, 902, [1.0] * d), ("a", "in0", "t0", True, 903, None)]
    generated = spark.createDataFrame(x + odd, SCHEMA).withColumn("similarity", F.lit("clash"))
    real = spark.createDataFrame(r, "object string, type string, id long, v array<double>")
    inputs = ["in0", "in1", "in2"]
    found = bundle.quality_bundle(generated, real, inputs=inputs, biased=biased, block=block).collect()
    same(found, by_hand(x, r, inputs, bundle.VIEWS, biased))


def test_no_rows(spark):
    real = spark.createDataFrame([("a", "t0", 1, [1.0, 2.0])], "object string, type string, id long, v array<double>")
    none = spark.createDataFrame([], SCHEMA)
    found = bundle.quality_bundle(none, real, inputs=["in0"], views=["filtered"]).collect()
    assert [(r.view, r.defect_type, r.real_scope, r.n_real, r.n_generated, r.status, r.nn_mean, r.kid, r.fid) for r in found] == [("filtered", "__all__", "object_all", 1, 0, "empty", None, None, None)]
    assert bundle.quality_bundle(none, real.filter("id < 0"), inputs=["in0"]).count() == 0
    with pytest.raises(ValueError):
        bundle.quality_bundle(none, real, inputs=["in0"], views=["all"])


def test_sanity(spark):
    r = [(o, t, i, v) for o, _, t, _, i, v in rows_at_random(3, 40, 6)]
    real = spark.createDataFrame(r, "object string, type string, id long, v array<double>")
    noise = real.withColumn("v", F.transform("v", lambda x, i: F.when(i == 0, 10.0).otherwise(-x)))
    tau = spark.createDataFrame([("a", 0.9), ("b", -0.9)], "object string, tau_low double")
    found = {(c.object, c.defect_type): c for c in bundle.sanity_checks(real, noise, tau).collect()}
    assert set(found) == {p[:2] for p in r}
    of = lambda rows: np.array([p[-1] for p in sorted(rows, key=lambda p: p[-2])])
    moved = [(o, t, i, [10.0, *[-x for x in v[1:]]]) for o, t, i, v in r]
    for key, check in found.items():
        own, other = (of([p for p in rows if p[:2] == key]) for rows in (r, moved))
        want = metrics(other, own, biased=True)
        assert check.n == len(own) and check.self_nn_min == pytest.approx(1) and check.self_mnn == 1 and check.self_kid == pytest.approx(0, abs=1e-9)
        assert check.noise_nn_mean == pytest.approx(want["nn_mean"]) and check.noise_kid == pytest.approx(want["kid"])
        assert check.passed == (len(own) > 1 and key[0] == "a" and want["nn_mean"] <= 0.9)
