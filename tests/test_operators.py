from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftlake.functions import scalars
from siftlake.operators import cluster, expect, imaging, lineage, metrics, neardup, replicate, rules, sampling, scan, vectors

PASSING = (1.0, 0.02, 0.01, 0.08, 0.1, -0.2, None, 0.8, 0.6, 1.0, 2.0, 0.9)
SCORES = (
    "roi_containment double, area_ratio double, area_p05 double, area_p95 double, area_zscore double, aspect_zscore double, phash_min_dist int, "
    "nn_score double, tau_low double, outlier_score double, tau_outlier double, seam_score double"
)


def reasons(spark, row, disabled=()):
    df = spark.createDataFrame([row], SCORES)
    return rules.decide(df, rules.geometry_rules(), disabled).first()["reject_reasons"]


def test_rules_keep_order_and_strictness(spark):
    assert reasons(spark, PASSING) == []
    bad = (0.9, 0.5, 0.01, 0.08, 3.0, -3.0, 2, 0.1, 0.6, 3.0, 2.0, 0.1)
    assert reasons(spark, bad) == [
        "ROI_OVERFLOW", "AREA_OUT_OF_RANGE", "ASPECT_OUT_OF_RANGE", "PHASH_DUPLICATE", "NN_TOO_LOW", "EMBEDDING_OUTLIER", "SEAM_POOR"
    ]
    edge = (1.0, 0.08, 0.01, 0.08, 2.5, -2.5, 5, 0.6, 0.6, 2.0, 2.0, 0.85)
    assert reasons(spark, edge) == []
    assert reasons(spark, (*PASSING[:7], 0.98, *PASSING[8:])) == ["NN_TOO_HIGH_COPY"]
    assert "AREA_OUT_OF_RANGE" not in reasons(spark, bad, ["area"])
    with pytest.raises(ValueError, match="unknown rules"):
        rules.reject_reasons(rules.geometry_rules(), ["colour"])


def test_funnel_counts(spark):
    rows = [("g", ["A"]), ("g", ["B"]), ("g", []), ("g", ["A", "B"])]
    df = spark.createDataFrame(rows, "k string, reject_reasons array<string>")
    got = rules.funnel(df, [("a", ["A"]), ("b", ["B"])], ["k"]).first()
    assert (got.total, got.after_a, got.after_b, got.accepted) == (4, 2, 1, 1)
    counts = {r.reason: (r.triggers, r.first_reason) for r in rules.reason_counts(df).collect()}
    assert counts == {"A": (2, 2), "B": (2, 1)}


def test_quantiles_and_log_z(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],)], "v array<double>")
    assert df.select(rules.lower_quantile(F.col("v"), 0.5)).first()[0] == 2.0
    z = spark.createDataFrame([(math.e, 0.0, 0.5), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)], "x double, m double, s double")
    assert [r[0] for r in z.select(scalars.log_z(F.col("x"), F.col("m"), F.col("s"))).collect()] == [2.0, 0.0, math.inf]


def test_near_duplicate_groups(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 3)], "id long, hash long")
    pairs = neardup.banded_pairs(df, bits=60, threshold=1)
    got = neardup.groups(df, pairs).orderBy("id").collect()
    assert [r.group_id for r in got] == [0, 0, 0] and [r.nearest for r in got] == [1, 1, 1] and pairs.count() == 2


def test_banded_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**60, 40)
    hashes = [int(b) ^ int(sum(1 << int(x) for x in set(rng.integers(0, 60, 3)))) for b in base for _ in range(4)]
    rows = [(i, h, "ab"[i % 2]) for i, h in enumerate(hashes)] + [(999, None, "a")]
    df = spark.createDataFrame(rows, "id long, hash long, g string")
    for t in (0, 2, 5):
        got = sorted((r.a, r.b, r.distance) for r in neardup.banded_pairs(df, bits=60, threshold=t, by="g").collect())
        want = [
            (i, j, (h ^ k).bit_count()) for i, h in enumerate(hashes) for j, k in enumerate(hashes) if i < j and i % 2 == j % 2 and (h ^ k).bit_count() <= t
        ]
        assert got == sorted(want)


def test_greedy_accept_equals_a_sequential_pass(spark):
    rng = np.random.default_rng(5)
    n = 120
    edges = sorted({tuple(sorted(map(int, rng.integers(0, n, 2)))) for _ in range(260)} - {(i, i) for i in range(n)})
    eligible = [bool(rng.random() < 0.8) for _ in range(n)]
    accepted: list[int] = []
    for i in range(n):
        if eligible[i] and not any((a, i) in set(edges) for a in accepted):
            accepted.append(i)
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(eligible)], "id long, eligible boolean")
    got = neardup.greedy_accept(rows, spark.createDataFrame(edges, "a long, b long"))
    assert sorted(r.id for r in got.filter("accepted").collect()) == accepted and got.count() == n


def test_copies_make_no_pairs_among_themselves(spark, monkeypatch):
    from siftlake.plans import duplicates

    base = 0b1011 << 40
    texts = [base] * 80 + [base ^ 1] * 3 + [base ^ 0b1111] * 4 + [base ^ (0b111 << 20)] * 2 + [1 << 55]
    rows = [(i * 7 % 90, "ab"[i % 2], h) for i, h in enumerate(texts)]
    eligible = {i: i % 3 != 0 for i, _, _ in rows}
    made, inner = [], neardup.materialise

    def counted(df, name="step"):
        out = inner(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(neardup, "materialise", counted)
    monkeypatch.setattr(duplicates, "materialise", counted)
    monkeypatch.setattr(duplicates, "hashes", lambda *_: spark.createDataFrame(rows, "id long, lang string, hash long"))
    docs = spark.createDataFrame([(i, 500 if e else 1) for i, e in eligible.items()], "doc_id long, n_chars long")
    monkeypatch.setattr(duplicates, "table", lambda *_: docs)
    groups = {r.id: r for r in duplicates.neardup_groups(spark, "").collect()}
    kept = {r.id for r in duplicates.greedy_dedupe(spark, "").collect() if r.accepted}
    close = {(i, j): (h ^ k).bit_count() for i, g, h in rows for j, f, k in rows if i != j and g == f and (h ^ k).bit_count() <= 3}
    part = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, j in close:
            part[i] = part[j] = min(part[i], part[j])
    want: list[int] = []
    for i in sorted(part):
        if eligible[i] and not any((i, j) in close for j in want):
            want.append(i)
    assert {i: r.component for i, r in groups.items()} == part and kept == set(want)
    assert {i: r.nearest for i, r in groups.items()} == {i: min((d for (x, _), d in close.items() if x == i), default=-1) for i in part}
    assert max(n for _, n in made) <= len(rows)


def test_group_safe_split(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (3, "b", "train")], "id long, g string, split string")
    got = {r.id: (r.final_split, r.moved) for r in neardup.group_safe_split(df, group="g", split="split").collect()}
    assert got == {1: ("test", True), 2: ("test", False), 3: ("train", False)}


def test_sampling_is_exact_and_order_free(spark):
    rows = [(f"image-{i:02}.png", "g") for i in range(20)]
    draw = lambda r: sorted(x.key for x in sampling.k_sample(spark.createDataFrame(r, "key string, g string"), by=["g"], key="key", k=10, seed=42).collect())
    assert draw(rows) == draw(rows[::-1]) and len(draw(rows)) == 10
    strata = [(f"a{i}", "source_a", "0") for i in range(6)] + [(f"b{i}", "source_b", "1") for i in range(4)]
    df = spark.createDataFrame(strata, "key string, input string, kind string")
    counts = {r.input: r["count"] for r in sampling.stratified(df, strata=["input", "kind"], key="key", count=5, seed=1).groupBy("input").count().collect()}
    assert counts == {"source_a": 3, "source_b": 2}
    with pytest.raises(PySparkException, match="larger than the population"):
        sampling.stratified(df, strata=["input", "kind"], key="key", count=11, seed=1).collect()


def test_places_in_a_group_that_holds_most_rows(spark):
    from siftlake.operators.ordering import range_bucket, with_place

    rows = [("hot", i * 7 % 5000) for i in range(5000)] + [("cold", 3), ("cold", 1), (None, 9)]
    df = spark.createDataFrame(rows, "g string, n long")
    got = {(r.g, r.n): r.place for r in with_place(df, by=["g"], bucket=range_bucket(F.col("n"), 64), order=[F.col("n")]).collect()}
    assert got == {("hot", i): i for i in range(5000)} | {("cold", 1): 0, ("cold", 3): 1, (None, 9): 0}
    few = sampling.k_sample(df.na.drop(), by=["g"], key="n", k=F.when(F.col("g") == "hot", 700).otherwise(1), seed=3)
    same = sampling.k_sample(df.filter("g = 'hot'"), by=["g"], key="n", k=700, seed=3)
    assert {r.n for r in few.filter("g = 'hot'").collect()} == {r.n for r in same.collect()} and few.count() == 701


def quotas(spark, sizes, total, minimum):
    df = spark.createDataFrame([("g", k, n) for k, n in sizes.items()], "g string, k string, n long")
    rows = sampling.quotas_with_floor(df, by="g", key="k", size="n", total=total, minimum=minimum).collect()
    return {r.k: r.quota for r in rows}


def test_quotas_with_a_floor(spark):
    assert quotas(spark, {"s": 16, "t": 7}, 500, 50) == {"s": 348, "t": 152}
    assert quotas(spark, {"s": 9, "t": 3}, 500, 50) == {"s": 375, "t": 125}
    assert quotas(spark, {"s": 100, "t": 1, "u": 1}, 200, 50) == {"s": 100, "t": 50, "u": 50}
    assert quotas(spark, {}, 10, 1) == {} and quotas(spark, {"s": 0, "t": None}, 4, 2) == {"s": 2, "t": 2}
    with pytest.raises(PySparkException, match="minimum"):
        quotas(spark, {"s": 1, "t": 1}, 10, 6)


def test_quotas_and_turns_against_sql_on_odd_sizes(spark):
    import duckdb

    from siftlake.plans.registry import oracle_sql

    rng = np.random.default_rng(5)
    rows = [(f"g{g}", f"k{k}", int(n)) for g in range(12) for k, n in enumerate((rng.pareto(0.6, rng.integers(1, 25)) * 3).astype(int) + 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE sizes(lang VARCHAR, source VARCHAR, n BIGINT)")
    con.executemany("INSERT INTO sizes VALUES (?, ?, ?)", rows)
    con.execute("CREATE VIEW documents AS SELECT lang, source FROM sizes, range(n)")
    df = spark.createDataFrame(rows, "lang string, source string, n long")
    got = sampling.quotas_with_floor(df, by="lang", key="source", size="n", total=200, minimum=5)
    want = con.sql(oracle_sql()["quota_with_floor"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    steps = sampling.weighted_schedule(got, by="lang", key="source", quota="quota")
    want = con.sql(oracle_sql()["weighted_interleave"]).fetchall()
    assert sorted(map(tuple, steps.collect())) == sorted(want)


def test_turns_are_handed_on_in_chunks():
    whole, chunks = (np.concatenate(list(sampling.turns(np.array([12, 5]), chunk))) for chunk in (100, 3))
    assert whole.tolist() == chunks.tolist() and np.bincount(whole).tolist() == [12, 5]
    assert list(sampling.turns(np.zeros(0, np.int64))) == []
    assert sampling.even_quota(4, 10) == [3, 3, 2, 2]


def test_domain_shares_in_draws(spark):
    rows = [(i, "good") for i in range(100)] + [(100 + i, "bad") for i in range(10)] + [(200 + i, "synth") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, d string")
    shares = {"good": 0.5, "bad": 0.375, "synth": 0.125}
    weights = sampling.domain_weights(df, domain=F.col("d"), shares=shares)
    draws = sampling.weighted_draws(weights, key="id", weight="weight", draws=4000, seed=1).join(df, "id")
    found = {r.d: r["count"] / 4000 for r in draws.groupBy("d").count().collect()}
    assert all(abs(found[d] - s) < 0.025 for d, s in shares.items())
    with pytest.raises(PySparkException, match="every domain"):
        sampling.domain_weights(df.filter("d <> 'bad'"), domain=F.col("d"), shares=shares).collect()


def embeddings(spark, rows):
    return spark.createDataFrame([("g", i, [float(x) for x in v]) for i, v in enumerate(rows)], "k string, id long, v array<double>")


def test_neighbours_and_mutual_share(spark):
    real, generated = embeddings(spark, [[1, 0], [0, 1]]), embeddings(spark, [[0.9, 0.1], [0.1, 0.9], [0.8, 0.2]])
    got = [r.similarity for r in vectors.nearest_neighbours(generated, real, by="k").orderBy("id").collect()]
    assert np.allclose(got, [0.9938837, 0.9938837, 0.9701425])
    assert vectors.mutual_share(generated, real, by="k").first().mutual == 1.0
    basis, few = embeddings(spark, np.eye(3)), embeddings(spark, [[1, 0, 0], [0.9, 0.1, 0]])
    assert abs(vectors.mutual_share(few, basis, by="k").first().mutual - 1 / 3) < 1e-12


def test_distances_against_formulas(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, y = rng.normal(0, 1, (9, 5)), rng.normal(0.3, 1.2, (11, 5))
    k = lambda a, b: (a @ b.T / a.shape[1] + 1) ** 3
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    real, generated = embeddings(spark, x), embeddings(spark, y)
    for largest, size in ((5, 2048), (4, 2048), (4, 4)):  # from sums of features, and from pairs of blocks
        monkeypatch.setattr(vectors, "LARGEST", largest)
        monkeypatch.setattr(vectors.blocks, "__defaults__", (size,))
        assert abs(vectors.kernel_distance(real, generated, by="k").first().kid - (off(k(x, x)) + off(k(y, y)) - 2 * k(x, y).mean())) < 1e-9
        biased = vectors.kernel_distance(real, generated, by="k", biased=True).first().kid
        assert abs(biased - (k(x, x).mean() + k(y, y).mean() - 2 * k(x, y).mean())) < 1e-9
    c1, c2 = np.cov(x.T), np.cov(y.T)
    a, b = x - x.mean(0), y - y.mean(0)
    nuclear = np.linalg.svd(a @ b.T, compute_uv=False).sum() / math.sqrt((len(x) - 1) * (len(y) - 1))
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * nuclear
    assert abs(vectors.frechet_distance(real, generated, by="k").first().fid - want) < 1e-6


def test_kernel_distance_of_odd_sets(spark):
    real = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, None), (None, 3, [1.0, 1.0]), ("b", 4, [0.0, 1.0]), ("b", 5, [0.0, 1.0])], "k string, id long, v array<double>")
    other = spark.createDataFrame([("a", 1, [0.0, 2.0]), ("a", 6, [1.0, 0.0]), ("b", 7, [0.0, 1.0]), ("b", 8, [0.0, 1.0]), ("c", 9, [1.0, 1.0])], "k string, id long, v array<double>")
    got = {r.g: r for r in vectors.kernel_distance(real, other, by="k").collect()}
    assert set(got) == {"a", "b"} and (got["a"].n_real, got["a"].n_generated, got["a"].kid) == (1, 2, None) and abs(got["b"].kid) < 1e-12
    assert vectors.kernel_distance(real.limit(0), other, by="k").count() == 0


def test_calibration(spark):
    v = np.random.default_rng(1).normal(0, 1, (8, 3))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    c = u.mean(0) / np.linalg.norm(u.mean(0))
    got = vectors.calibrate(embeddings(spark, v), by="k").first()
    assert abs(got.tau_low - np.quantile(s.max(1), 0.05)) < 1e-9 and abs(got.tau_outlier - np.quantile(1 - u @ c, 0.95)) < 1e-9
    assert vectors.calibrate(embeddings(spark, v[:2]), by="k").count() == 0


def test_binary_metrics(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.9), ("a", 1, 0.8), ("a", 1, 0.2), ("b", 1, 0.3)], "g string, y int, s double")
    rows = {r.g: r for r in metrics.binary_metrics(df, by=["g"], label="y", score="s").collect()}
    a = rows["a"]
    assert (a.tp, a.fp, a.fn, a.tn) == (1, 1, 1, 1) and a.macro_f1 == a.positive_f1 == a.auroc == a.fpr == 0.5
    assert rows["b"].auroc is None


def test_perfect_masks(spark):
    pixels = [(i, y, x, 0.99 if 2 <= y < 5 and 2 <= x < 5 else 0.01) for i in range(2) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(pixels, "image int, y int, x int, prob double")
    masks = spark.createDataFrame([(i, [[2 <= y < 5 and 2 <= x < 5 for x in range(8)] for y in range(8)]) for i in range(2)], "image int, mask array<array<boolean>>")
    regions = imaging.mask_components(masks, image="image", mask="mask")
    joined = df.join(regions, ["image", "y", "x"], "left").select("prob", F.col("region").isNotNull().alias("t"), (F.col("prob") >= 0.5).alias("p"), F.lit(0).alias("g"))
    got = metrics.region_overlap_metrics(joined, by=["g"], truth="t", predicted="p").first()
    assert got.dice == got.miou == 1.0
    thresholds = np.linspace(1 + 1e-7, -1e-7, 64).tolist()
    curve = metrics.per_region_curve(df, regions, thresholds).withColumn("g", F.lit(0))
    assert abs(metrics.limited_area(curve, by=["g"], x="fpr", y="pro", limit=0.3).first().area - 1) < 1e-9
    box = imaging.bounding_boxes(regions, by=["image"]).filter("image = 0").first()
    assert (box.x0, box.y0, box.x1, box.y1, box.area, box.aspect) == (2, 2, 5, 5, 9, 1.0)


def test_pixel_components():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 0, 0]], bool)
    assert imaging.label_components(mask).tolist() == [[1, 0, 0, 2], [0, 1, 0, 2], [0, 0, 0, 0], [3, 0, 0, 0]]
    assert imaging.label_components(mask, 2)[3, 0] == 0
    image = np.random.default_rng(0).random((40, 56))
    assert (imaging.perceptual_hash(image) ^ imaging.perceptual_hash(image + 0.001)).bit_count() <= 2


def test_box_conflicts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        x, y, w, h = (int(v) for v in rng.integers([0, 0, 1, 1], [300, 300, 90, 90]))
        rows.append((i % 2, i, x, y, x + w, y + h))
    df = spark.createDataFrame(rows, "g int, id int, x0 int, y0 int, x1 int, y1 int")
    for margin in (0, 5):
        want = sorted(
            (a[1], b[1]) for a in rows for b in rows
            if a[0] == b[0] and a[1] < b[1] and all(a[k] < b[k + 2] + margin and b[k] < a[k + 2] + margin for k in (2, 3))
        )
        got = [tuple(r) for r in imaging.box_conflicts(df, by="g", margin=margin).collect()]
        assert sorted(got) == want


def test_forbidden_inputs(spark, tmp_path):
    path = str(tmp_path / "secret")
    spark.range(3).write.parquet(path)
    with pytest.raises(expect.ContractError, match="must not be read"):
        expect.forbid_inputs(spark.read.parquet(path), [path])
    assert expect.forbid_inputs(spark.read.parquet(path), [str(tmp_path / "other")]).count() == 3


def test_replicates_gates_and_verdicts(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 3.0), ("h", 1, 5.0)], "k string, seed int, m double")
    assert [(r.k, r.mean, round(r.std, 6)) for r in replicate.mean_std(df, by=["k"], metric="m").collect()] == [("g", 2.0, 1.414214)]
    table = [("base", "o1", 0.5, 0.5), ("base", "o2", 0.5, 0.5), ("c1", "o1", 0.6, 0.5), ("c1", "o2", 0.6, 0.5), ("c2", "o1", 0.9, 0.5), ("c2", "o2", 0.4, 0.5)]
    runs = spark.createDataFrame(table, "g string, o string, m1 double, m2 double")
    gate = replicate.non_inferiority(runs, group="g", baseline="base", object_="o", m1="m1", m2="m2", tolerance=0.02, gain=0.01).first()
    assert (gate.g, gate.non_inferior, gate.passed) == ("c2", False, False)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert replicate.pearson(flat, "x", "y").first().r is None
    effects = spark.createDataFrame([(0.2,), (-0.2,), (0.0,)], "e double")
    assert [r[0] for r in effects.select(replicate.verdict(F.col("e"), 0.1)).collect()] == ["helps", "harms", "no_effect"]
    signs = spark.createDataFrame([("o", 1, 1.0), ("o", 2, -1.0), ("o", 3, 0.0)], "o string, s int, d double")
    other = signs.withColumn("d", -F.col("d"))
    got = replicate.sign_conflicts(signs, other, object_="o", seed="s", delta="d").first()
    assert (got.n_seeds, got.n_opposite, got.conflict) == (3, 2, True)
    blind = spark.createDataFrame([("o", 42, 9.0, True), ("o", 43, 0.3, True), ("o", 44, 0.1, False)], "o string, s int, e double, ok boolean")
    one = replicate.confirmed_effect(blind, by="o", seed="s", effect="e", informative="ok", disclosed=[42], threshold=0.25).first()
    assert (one.effect, one.n_blind, one.disclosed_effect, one.verdict) == (0.3, 1, 9.0, "helps")


def test_attribution_needs_one_answer_everywhere(spark):
    def overall(*rows):
        df = spark.createDataFrame([(f"o{i}", *r) for i, r in enumerate(rows)], "o string, b double, r double, g double")
        got = replicate.attribution(df, object_="o", baseline="b", real="r", generated="g").orderBy("o").collect()
        return [r.attribution for r in got], got[0].overall, [r.discriminates for r in got]

    assert overall((0.9, 0.5, 0.4), (0.8, 0.5, 0.3)) == (["placement"] * 2, "placement_dominates", [True, True])
    assert overall((0.9, 0.8, 0.4), (0.8, 0.7, 0.3)) == (["appearance"] * 2, "appearance_dominates", [True, True])
    assert overall((0.8, 0.6, 0.4), (0.5, 0.5, 0.5)) == (["tie"] * 2, "object_dependent", [True, False])
    assert overall((0.9, 0.5, 0.4), (0.9, 0.8, 0.4))[1] == "object_dependent"
    with pytest.raises(PySparkException, match="missing"):
        overall((0.9, None, 0.4))


def test_area_from_zero_to_the_limit(spark):
    def area(points, limit=0.3):
        df = spark.createDataFrame([("g", *p) for p in points], "g string, x double, y double")
        return metrics.limited_area(df, by=["g"], x="x", y="y", limit=limit).first().area

    assert abs(area([(0.1, 0.5), (0.2, 0.8)]) - (0.025 + 0.065 + 0.08) / 0.3) < 1e-9
    assert abs(area([(0.0, 1.0), (1.0, 1.0)]) - 1) < 1e-9
    assert abs(area([(0.0, 0.0), (0.0, 0.4), (0.6, 1.0)]) - (0.3 * (0.4 + 0.7) / 2) / 0.3) < 1e-9
    assert abs(area([(0.5, 0.6), (1.0, 1.0)]) - 0.3 * 0.6 / 2 / 0.3) < 1e-9
    assert area([(0.1, None), (0.2, 1.0)]) is None


def test_zero_overlap_diagnoses(spark):
    rows = [(0.0, None, None, None, 0.5), (0.1, 0.9, 0.9, 0.1, 0.9), (0.0, 0.6, 0.1, 0.6, 0.9), (0.0, 0.4, 0.4, 0.3, 0.5), (0.0, 0.4, 0.3, 0.4, 0.8), (0.0, 0.4, 0.3, 0.4, 0.79), (0.0, 0.4, None, 0.4, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, overlap double, top double, inside double, outside double, auroc double")
    columns = [F.col(c) for c in ("overlap", "top", "inside", "outside", "auroc")]
    got = [r.d for r in df.orderBy("i").select(replicate.zero_diagnosis(*columns, threshold=0.5).alias("d")).collect()]
    low = "underconfident_peak_outside_ranking_near_random"
    assert got == ["no_pixels", "non_zero_overlap", "positive_pixels_never_overlap", "underconfident_peak_inside", "underconfident_peak_outside_ranking_informative", low, low]


def test_running_best_in_a_group_that_holds_most_rows(spark):
    rng = np.random.default_rng(3)
    values = rng.random(500).round(2)
    rows = [("hot", i, float(v)) for i, v in enumerate(values)] + [("cold", 7, 1.0), (None, 3, 2.0)]
    df = spark.createDataFrame(rows, "g string, n long, v double")
    got = replicate.best_so_far(df, by=["g"], step="n", score="v", patience=5, width=16).filter("g = 'hot'").orderBy("n").collect()
    best, since, stopped = -1.0, 0, False
    for r, v in zip(got, values, strict=True):
        best, since = (v, 0) if v > best else (best, since + 1)
        stopped = stopped or since >= 5
        assert (r.best, r.stale, r.stopped) == (best, since, stopped)


def test_secret_kinds(spark):
    lines = ["gho_" + "a" * 20, "hf_" + "b" * 20, "sk-" + "c-_" * 7, "AIza" + "d" * 20, r"see c:\\users\\jo doe\\x", "D:/Users/<name>/x", "gho_short", r"C:\Users\x\y"]
    df = spark.createDataFrame([(0, "\n".join(lines))], "id int, t string")
    got = {(r.line, r.kind) for r in scan.scan_lines(df, key="id", text="t", patterns=scan.SECRETS).collect()}
    assert got == {(1, "github_token"), (2, "huggingface_token"), (3, "openai_key"), (4, "google_api_key"), (5, "windows_user_path"), (8, "windows_user_path")}


def test_long_chains_of_conflicts(spark):
    n = 1000
    rows = spark.createDataFrame([(i, i != 7) for i in range(n)] + [(5000, True)], "id long, eligible boolean")
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(0, 400)], "a long, b long")
    want, accepted = {5000}, set()
    for i in range(n):
        near = {i - 1} | ({0} if i == 400 else set())
        if i != 7 and not near & accepted:
            accepted.add(i)
    got = {r.id for r in neardup.greedy_accept(rows, chain).filter("accepted").collect()}
    assert got == want | accepted
    few = rows.filter("id < 12 OR id > 4000")
    got = {r.id for r in neardup.greedy_accept(few, chain, most=3).filter("accepted").collect()}
    assert got == {i for i in want | accepted if i < 12 or i > 4000}


def test_alias_resolution():
    assert replicate.resolve_alias("a", {"a": "b", "b": "c"}, ["c"]) == "c"
    with pytest.raises(ValueError, match="cycle"):
        replicate.resolve_alias("a", {"a": "b", "b": "a"})
    with pytest.raises(ValueError, match="unknown"):
        replicate.resolve_alias("a", {}, ["c"])


def test_contracts_fail_closed(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, v string")
    with pytest.raises(expect.ContractError, match="repeated"):
        expect.require_none(expect.duplicates(df, "k"), "repeated k")
    with pytest.raises(PySparkException, match="exactly one row for 1"):
        expect.exactly_one(df, ["k"]).collect()
    checks = spark.createDataFrame([("a", True), ("b", False)], "name string, ok boolean")
    waived = spark.createDataFrame([("b",)], "name string")
    assert {r.passed for r in expect.named_checks(checks, waived).collect()} == {True}
    with pytest.raises(expect.ContractError, match="unknown check"):
        expect.named_checks(checks, spark.createDataFrame([("c",)], "name string"))
    manifest = spark.createDataFrame([(1, "h1")], "m long, h string")
    rows = spark.createDataFrame([(1, "h1"), (2, "h2")], "r long, e string")
    with pytest.raises(PySparkException, match="no matching manifest entry for 2"):
        lineage.provenance(rows, manifest, key="r", manifest_key="m", expected="e", actual="h").collect()
    with pytest.raises(PySparkException, match="two origins"):
        lineage.merged_pool(df, key="k", origin="v").collect()


def test_digest_ignores_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "k long, v string")
    c = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "k long, v string")
    one, two, three = (lineage.relation_digest(d, ["k", "v"]).first().digest for d in (a, b, c))
    assert one == two != three


def test_scan_reports_lines_not_matches(spark):
    df = spark.createDataFrame([(1, "fine\nmail me@example.org\nAKIA" + "A" * 16), (2, "a\0me@example.org"), (3, None)], "id long, t string")
    got = sorted((r.id, r.line, r.kind) for r in scan.scan_lines(df, key="id", text="t", patterns=scan.SECRETS | scan.PERSONAL).collect())
    assert got == [(1, 2, "email"), (1, 3, "aws_key")]
    paths = spark.createDataFrame([("src/a.py",), (".env",), (".env.example",)], "p string")
    audit = scan.path_audit(paths, path="p", required=["src/", "LICENSE"], denied=[".env", ".env.example"], excepted=[".env.example"])
    assert sorted(tuple(r) for r in audit.collect()) == [("denied", ".env"), ("missing", "LICENSE")]


def test_clusters_and_fits():
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [5.2], [9.0]])
    assert cluster.ward_labels(x, 3).tolist() == [0, 0, 0, 1, 1, 1, 2]
    labels, score = cluster.choose_clusters(x[:6])
    assert labels.tolist() == [0, 0, 0, 1, 1, 1] and score > 0.9
    assert cluster.choose_clusters(x[:4])[1] is None
    assert cluster.isotonic(np.array([1.0, 3.0, 2.0, 4.0])).tolist() == [1.0, 2.5, 2.5, 4.0]
    assert cluster.equivalent_x(np.array([1, 2, 3]), np.array([1.0, 2.0, 4.0]), 3.0) == (2.5, "at")
    assert cluster.equivalent_x(np.array([1, 2, 3]), np.array([1.0, 1.0, 4.0]), 1.0) == (2.0, "at")
    assert cluster.equivalent_x(np.array([1, 2]), np.array([1.0, 2.0]), 0.0) == (1.0, "below")


def test_scalars(spark):
    df = spark.createDataFrame([("a/b", 0, 10)], "p string, a long, b long")
    paths = {"ok/x.png": True, "/abs": False, "C:\\x": False, "a/../b": False, "..": False}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", scalars.safe_relative_path(F.col("p")).alias("ok")).collect()
    assert {r.p: r.ok for r in rows} == paths
    box = df.select(scalars.square_box(F.lit(90), F.lit(40), F.lit(100), F.lit(44), F.lit(100), F.lit(60), 2.0).alias("b")).first().b
    assert (box.x0, box.y0, box.x1, box.y1) == (80, 32, 100, 52)
    words = df.select(scalars.hamming_words(F.array(F.lit(1), F.lit(7)), F.array(F.lit(0), F.lit(0)))).first()[0]
    assert words == 4
    assert df.select(scalars.cosine_schedule(F.lit(50), 100, 1.0)).first()[0] == pytest.approx(0.5)
    with pytest.raises(PySparkException, match="no direction"):
        df.select(scalars.unit(F.array(F.lit(0.0)))).collect()


def test_all_boxes_are_placed_in_order(spark, small):
    from siftlake.plans import duplicates

    got = {r.id: r.accepted for r in duplicates.nonoverlapping_boxes(spark, small).collect()}
    placed: dict[int, list] = {}
    want = {}
    for r in sorted(duplicates.boxes(spark, small).dropDuplicates(["id"]).collect(), key=lambda r: r.id):
        own = placed.setdefault(r.g, [])
        want[r.id] = not any(r.x0 < o.x1 and o.x0 < r.x1 and r.y0 < o.y1 and o.y0 < r.y1 for o in own)
        if want[r.id]:
            own.append(r)
    assert got == want and len(got) == spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_boxes_are_placed_without_pairs(spark, small, monkeypatch):
    from siftlake.plans import duplicates

    df = duplicates.boxes(spark, small).withColumn("g", F.when(F.col("g") % 5 > 0, F.col("g") % 5)).withColumn("x1", F.when(F.col("id") % 97 > 0, F.col("x1"))).cache()
    placed: dict[int, list] = {}
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        own = placed.setdefault(r.g, [])
        want[r.id] = r.g is None or r.x1 is None or not any(r.x0 < o.x1 and o.x0 < r.x1 and r.y0 < o.y1 and o.y0 < r.y1 for o in own)
        if want[r.id] and r.x1 is not None:
            own.append(r)
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    got = imaging.place_in_order(df, by="g", most=sorted(n for g, n in sizes.items() if g is not None)[1]).collect()  # small and large ones
    assert len(got) == len(want) and {r.id: r.accepted for r in got} == want

    def none(*args, **kwargs):
        raise AssertionError("pairs of a small background")

    monkeypatch.setattr(imaging, "box_conflicts", none)
    assert {r.id: r.accepted for r in imaging.place_in_order(df, by="g").collect()} == want
    assert duplicates.nonoverlapping_boxes(spark, small).count() == len(want)
