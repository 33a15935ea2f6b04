from __future__ import annotations

import json
import random
import threading

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftlake.operators.expect import ContractError
from siftlake.operators.file_order import first_rows, ordinals
from siftlake.sources import readers, sinks


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of some lines, several of them a task."""
    names = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "50", "spark.sql.files.minPartitionNum": "3"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def lines_in(folder, sizes, seed):
    """Files of so many lines each, of different lengths, ids in no order; the ids as they stand."""
    draw, out = random.Random(seed), []
    folder.mkdir(parents=True)
    ids = draw.sample(range(10_000), sum(sizes))
    for i, size in enumerate(sizes):
        own = [ids.pop() for _ in range(size)]
        out += own
        (folder / f"part-{i:03}.json").write_text("".join(json.dumps({"id": x, "v": "x" * draw.randrange(120)}) + "\n" + "\n" * draw.randrange(2) for x in own))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_order_of_lines(spark, tmp_path, small_blocks, seed):
    ids = lines_in(tmp_path / "d", [0, 40, 1, 120, 0, 7], seed)
    rows = readers.read_jsonl(spark, str(tmp_path / "d"), "id long, v string", "id", places=True)
    assert rows.select("at_file", "at_block").distinct().count() > 10 and rows.rdd.getNumPartitions() > 3
    assert [r.id for r in sorted(ordinals(rows).collect(), key=lambda r: r.ordinal)] == ids
    assert sorted(r.ordinal for r in ordinals(rows).collect()) == list(range(len(ids)))
    even = [x for x in ids if x % 2 == 0]
    for n in (1, 33, len(even), len(ids) + 5):
        assert {r.id for r in first_rows(rows.filter("id % 2 = 0"), n).collect()} == set(even[:n])
    assert ordinals(rows.filter("id < 0")).count() == 0 and first_rows(rows.filter("id < 0"), 3).count() == 0
    with pytest.raises(ValueError):
        first_rows(rows, 0)


def test_first_of_each_input(spark, tmp_path, small_blocks):
    ids = {name: lines_in(tmp_path / name, sizes, 5) for name, sizes in {"a": [30, 30], "b": [3], "c": [50]}.items()}
    rows = readers.read_inputs(spark, {n: str(tmp_path / n) for n in ids}, "id long, v string", key="id", keep=F.col("id") % 3 != 0, limit=12)
    assert rows.columns == ["id", "v", "input_name"]
    want = {(name, x) for name, own in ids.items() for x in [y for y in own if y % 3][:12]}
    assert {(r.input_name, r.id) for r in rows.collect()} == want


def test_exact_prefix_fails_closed(spark, tmp_path, small_blocks):
    folder = tmp_path / "d"
    ids = lines_in(folder, [20, 20], 1)
    (folder / "part-009.json").write_text(json.dumps({"id": ids[0], "v": ""}) + "\n")  # repeats a key after the prefix
    noted = spark.createDataFrame(readers.inventory(spark, str(folder)).collect())
    prefix = lambda n, **k: readers.exact_prefix(spark, str(folder), "id long, v string", n, key="id", **k)
    assert [r.id for r in sorted(prefix(25, expected=noted).collect(), key=lambda r: r.ordinal)] == ids[:25]
    assert prefix(40).count() == 40
    with pytest.raises(ContractError, match="repeated or null id"):
        prefix(41)
    with pytest.raises(ContractError, match="42 rows wanted, 41 found"):
        prefix(42)
    with pytest.raises(ContractError, match="rows wanted, 0 found"):
        prefix(1, keep=F.col("id") < 0)
    with open(folder / "part-001.json", "a") as f:
        f.write("\n")
    with pytest.raises(ContractError, match="not the expected files"):
        prefix(5, expected=noted)


def test_conditions_reach_the_scan(spark, tmp_path, capsys):
    path = tmp_path / "m.jsonl"
    path.write_text("".join(json.dumps({"id": i, "object": "ab"[i % 2], "v": "x", "more": 1}) + "\n" for i in range(10)))
    rows = readers.scan_jsonl(spark, str(path), "id long, object string, v string", (F.col("object") == "a") & (F.col("id") > 3)).select("id")
    assert sorted(r.id for r in rows.collect()) == [4, 6, 8]
    rows.explain("formatted")
    plan = capsys.readouterr().out
    pushed, schema = (next(x for x in plan.splitlines() if x.startswith(k)) for k in ("PushedFilters", "ReadSchema"))
    assert "EqualTo(object,a)" in pushed and "GreaterThan(id,3)" in pushed and "v:" not in schema
    path.write_text('{"id": "word"}\n')
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD"):
        readers.scan_jsonl(spark, str(path), "id long").collect()


def test_decisions_and_sidecars(spark, tmp_path):
    path, schema = tmp_path / "d.jsonl", "id long, reject_reasons array<string>"
    path.write_text('{"id": 1, "reject_reasons": []}\n{"id": 2, "reject_reasons": ["A"]}\n')
    assert sorted(r.reject_reasons for r in readers.read_decisions(spark, str(path), schema).collect()) == [[], ["A"]]
    path.write_text('{"id": 1, "reject_reasons": []}\n{"id": 2}\n')
    with pytest.raises(PySparkException, match="a decision without reject_reasons"):
        readers.read_decisions(spark, str(path), schema).collect()
    folder, schema = tmp_path / "s" / "deep", "place int, record struct<object: string, n: int>"
    folder.mkdir(parents=True)
    for i, (o, p) in enumerate([("b", 1), ("a", 2), ("a", 1)]):
        (folder / f"{i}.json").write_text(json.dumps({"place": p, "record": {"object": o, "n": i}}, indent=1))
    (folder / "other.txt").write_text("no record")
    sidecars = readers.read_sidecars(spark, str(tmp_path / "s"), schema)
    assert [r.n for r in readers.sidecar_records(sidecars, ["record.object", "place"]).collect()] == [2, 1, 0]
    (folder / "9.json").write_text('{"place": 1}')
    with pytest.raises(PySparkException, match="no record"):
        readers.read_sidecars(spark, str(tmp_path / "s"), schema).collect()


def keyed(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("key"), (F.col("id") * 2).alias("m"))


def test_ledger_versions(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with pytest.raises(ContractError, match="no ledger"):
        sinks.read_ledger(spark, path)
    with pytest.raises(ContractError, match="repeated key"):
        sinks.append_unique(keyed(spark, 0, 3).union(keyed(spark, 2, 4)), path, "key")
    assert sinks.committed(spark, path) == []
    sinks.append_unique(keyed(spark, 0, 3), path, "key")
    sinks.append_unique(keyed(spark, 0, 0), path, "key")
    sinks.append_unique(keyed(spark, 3, 5), path, "key")
    with pytest.raises(ContractError, match="key is in the ledger"):
        sinks.append_unique(keyed(spark, 4, 6), path, "key")
    assert sorted(r.key for r in sinks.read_ledger(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert len(sinks.committed(spark, path)) == 3 and len(list((tmp_path / "ledger").glob("data-*"))) == 3


@pytest.mark.parametrize("apart", [False, True])
def test_two_writers_at_once(spark, tmp_path, monkeypatch, apart):
    """Both have checked the empty ledger before either commits."""
    path, commit, ready = str(tmp_path / "ledger"), sinks._commit, threading.Barrier(2)
    waited = threading.local()

    def late(*args):
        if not hasattr(waited, "once"):
            waited.once = ready.wait(60)
        return commit(*args)

    monkeypatch.setattr(sinks, "_commit", late)
    raised = []

    def write(low):
        try:
            sinks.append_unique(keyed(spark, low, low + 10), path, "key")
        except ContractError as e:
            raised.append(str(e))

    threads = [threading.Thread(target=write, args=(low,)) for low in (0, 10 if apart else 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    keys = sorted(r.key for r in sinks.read_ledger(spark, path).collect())
    if apart:
        assert not raised and keys == list(range(20)) and len(sinks.committed(spark, path)) == 2
    else:
        assert len(raised) == 1 and "key is in the ledger" in raised[0] and keys in (list(range(10)), list(range(9, 19)))
        assert len(list((tmp_path / "ledger").glob("data-*"))) == 1


def test_documents_are_written_by_all_tasks(spark, tmp_path):
    folder = tmp_path / "documents"
    sinks.write_documents(spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("value")), str(folder))
    files = list(folder.glob("*.txt"))
    assert sorted(int(f.read_text()) for f in files) == list(range(40))
    assert len({f.name.split("-")[1] for f in files}) > 1
