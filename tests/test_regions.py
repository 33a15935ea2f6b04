"""Regions and segmentation measures against a plain version, on tiles of several sizes."""

from __future__ import annotations

import numpy as np
import pytest

from siftlake.operators import imaging, regions


def images(seed, n=5, h=17, w=23):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        noise = rng.random((h, w))
        mask = noise < (0.0, 0.25, 0.45, 0.6, 1.1)[i % 5]
        out.append((f"im{i}", "ab"[i % 2], mask, np.round(np.clip(0.5 * mask + 0.6 * rng.random((h, w)), 0, 1), 3)))
    return out


def pixels(spark, data):
    rows = [(name, obj, y, x, bool(m[y, x]), float(s[y, x])) for name, obj, m, s in data for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "image string, object string, y long, x long, mask boolean, score double")


def plain_area(data, levels, limit):
    """The area by cutting the curve at the limit, from all regions and clean pixels one by one."""
    values = regions.thresholds(levels)
    clean = np.concatenate([s[~m] for _, _, m, s in data])
    parts = []
    for _, _, mask, score in data:
        labels = imaging.label_components(mask)
        parts += [score[labels == k] for k in range(1, labels.max() + 1)]
    if not parts or not len(clean):
        return len(parts), None
    curve = sorted((float((clean >= t).mean()), float(np.mean([(p >= t).mean() for p in parts]))) for t in values)
    curve = [(0.0, 0.0), *curve] if curve[0][0] > 0 else curve
    fine = np.linspace(0, limit, 200_001)
    x, y = np.array(curve).T
    last = {}
    for a, b in zip(x, y):  # at a step the curve has its highest point
        last[a] = max(b, last.get(a, 0.0))
    return len(parts), float(np.trapezoid(np.interp(fine, list(last), list(last.values())), fine) / limit)


@pytest.mark.parametrize("tile", [1, 3, 8, 1024])
def test_regions_in_tiles(spark, tile):
    data = images(tile)
    runs = regions.mask_runs(pixels(spark, data), [0.5], tile=tile)
    got = {(r.image, r.y0, r.x0, r.y1, r.x1, r.area, round(r.aspect, 9)) for r in regions.region_boxes(regions.label_regions(runs, tile=tile, least_area=2)).collect()}
    want = set()
    for name, _, mask, _ in data:
        labels = imaging.label_components(mask)
        for k in range(1, labels.max() + 1):
            y, x = np.nonzero(labels == k)
            if len(y) >= 2:
                box = (int(y.min()), int(x.min()), int(y.max()) + 1, int(x.max()) + 1)
                want.add((name, *box, len(y), round((box[2] - box[0]) / (box[3] - box[1]), 9)))
    assert got == want and len(want) > 5


def test_one_region_of_many_rows(spark):
    """A snake through an image: one region, whatever the tile."""
    rows = [("s", y, x, True, 0.5) for y in range(0, 40) for x in range(12) if y % 2 == 0 or x == (0 if y % 4 == 1 else 11)]
    df = spark.createDataFrame(rows, "image string, y long, x long, mask boolean, score double")
    found = regions.region_boxes(regions.label_regions(regions.mask_runs(df, [0.5], tile=4), tile=4)).collect()
    assert [(r.y0, r.x0, r.y1, r.x1, r.area) for r in found] == [(0, 0, 40, 12, len(rows))]


@pytest.mark.parametrize("tile", [4, 1024])
def test_area_from_scores_and_masks(spark, tile):
    data = images(40 + tile)
    got = {r.object: r for r in regions.segmentation_metrics(pixels(spark, data), by="object", limit=0.3, levels=41, tile=tile).collect()}
    for obj in "ab":
        own = [d for d in data if d[1] == obj]
        number, area = plain_area(own, 41, 0.3)
        mask, score = (np.concatenate([d[i].ravel() for d in own]) for i in (2, 3))
        hit = score >= 0.5
        assert got[obj].n_images == len(own) and got[obj].n_regions == number
        assert got[obj].aupro == pytest.approx(area, abs=1e-4)
        assert got[obj].dice == pytest.approx(2 * (mask & hit).sum() / (mask.sum() + hit.sum()))
        iou = [(a & b).sum() / (a | b).sum() for a, b in ((mask, hit), (~mask, ~hit))]
        assert got[obj].miou == pytest.approx(np.mean(iou))


def test_no_regions_or_no_clean_pixels(spark):
    data = [("p", "none", np.zeros((3, 3), bool), np.full((3, 3), 0.2)), ("q", "all", np.ones((3, 3), bool), np.full((3, 3), 0.7))]
    got = {r.object: r for r in regions.segmentation_metrics(pixels(spark, data), by="object", levels=11).collect()}
    assert got["none"].aupro is None and got["none"].pixel_auroc is None and got["none"].n_regions == 0
    assert got["all"].aupro is None and got["all"].n_regions == 1 and got["all"].dice == 1.0


def test_thresholds_reached(spark):
    from pyspark.sql import functions as F

    ordered = regions.thresholds(37)
    values = [*ordered, *[t + 1e-12 for t in ordered], *[t - 1e-12 for t in ordered], -5.0, 0.0, 0.5, 1.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "s double").withColumn("n", regions.reached(F.col("s"), ordered))
    assert all(r.n == sum(t <= r.s for t in ordered) for r in df.collect())
