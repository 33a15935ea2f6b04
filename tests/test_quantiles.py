"""Selection by counts against sorted lists."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from siftlake.operators.quantiles import group_quantiles, ordered_bits

INF = float("inf")


def at(values, q):
    """The linear quantile of a list, NaN last."""
    rows = sorted(values, key=lambda x: (math.isnan(x), x))
    place = q * (len(rows) - 1)
    low, high = rows[math.floor(place)], rows[math.ceil(place)]
    return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high


def test_bits_are_ordered_as_the_doubles(spark):
    rnd = random.Random(4)
    xs = [0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 1.7976931348623157e308, INF]
    xs += [2.0**e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0**e, 0) for e in range(-1000, 1024, 7)]
    xs += [abs(struct.unpack("d", rnd.randbytes(8))[0]) for _ in range(3000)]
    xs = sorted({x for x in xs if not math.isnan(x)})
    xs = [-x for x in reversed(xs) if x] + xs
    got = dict(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", ordered_bits(F.col("x"))).collect())
    keys = [got[i] for i in range(len(xs))]
    assert all(a < b for a, b in zip(keys, keys[1:]))
    odd = spark.createDataFrame([(0.0,), (-0.0,), (math.nan,), (INF,), (None,)], "x double").select(ordered_bits(F.col("x"))).collect()
    assert odd[0][0] == odd[1][0] == 0 and odd[2][0] > odd[3][0] and odd[4][0] is None


@pytest.mark.parametrize("small", [0, 3, 40, 20_000])
def test_quantiles_of_groups(spark, small):
    rnd = random.Random(7)
    kinds = {
        "continuous": [rnd.gauss(0, 1) for _ in range(500)],
        "near": [1.0 + i * 2.220446049250313e-16 for i in range(60)],
        "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(200)],
        "ties": [float(rnd.randint(0, 3)) for _ in range(400)],
        "one": [4.5],
        "two": [-1.0, 2.0],
        "ends": [-INF, 1.0, INF],
        None: [float(i) for i in range(30)],
    }
    rows = [(g, x, 2 * x if i % 3 else None) for g, xs in kinds.items() for i, x in enumerate(xs)] + [("nulls", None, 1.0), ("ties", None, None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    shares = {"least": 0.0, "p05": 0.05, "median": 0.5, "p999": 0.999, "most": 1.0}
    got = {r.g: r for r in group_quantiles(df, by=["g"], values={"": F.col("x"), "y": F.col("y")}, at=shares, small=small).collect()}
    assert set(got) == {*kinds, "nulls"} and got["nulls"].median is None and got["nulls"].y_median == 1.0
    for g, xs in kinds.items():
        for label, q in shares.items():
            want = at(xs, q)
            assert got[g][label] == want or (math.isnan(want) and math.isnan(got[g][label])), (g, label)
            ys = [2 * x for i, x in enumerate(xs) if i % 3]
            if ys and not math.isnan(at(ys, q)):
                assert got[g][f"y_{label}"] == at(ys, q), (g, label)


def test_no_groups_no_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert group_quantiles(empty, by=["g"], values={"": F.col("x")}, at={"median": 0.5}).count() == 0
    df = spark.createDataFrame([("a", 1.0, 9), ("a", 3.0, 9)], "q_what string, q_x double, q_key int")
    assert group_quantiles(df, by=["q_what"], values={"": F.col("q_x")}, at={"median": 0.5}).collect()[0].asDict() == {"q_what": "a", "median": 2.0}
    whole = group_quantiles(df, by=[], values={"v": F.col("q_x")}, at={"p25": 0.25}, small=1).collect()
    assert [r.asDict() for r in whole] == [{"v_p25": 1.5}]
    with pytest.raises(ValueError):
        group_quantiles(df, by=[], values={"v": F.col("q_x")}, at={"p": 1.5})
