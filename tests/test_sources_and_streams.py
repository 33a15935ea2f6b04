from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftlake.operators.expect import ContractError
from siftlake.sources import readers, sinks
from siftlake.streaming import incremental


def test_csv_header_must_fit(spark, tmp_path):
    good, bad, empty = tmp_path / "good.csv", tmp_path / "bad.csv", tmp_path / "empty.csv"
    good.write_text("b,a\nx,1\n")
    bad.write_text("a,c\n1,x\n")
    empty.write_text("a,b\n")
    assert readers.read_csv(spark, str(good), "a int, b string").collect()[0].asDict() == {"a": 1, "b": "x"}
    for path in (bad, empty):
        with pytest.raises(ContractError):
            readers.read_csv(spark, str(path), "a int, b string")


def test_jsonl_fields_and_keys(spark, tmp_path):
    def file(name, rows):
        path = tmp_path / name
        path.write_text("\n".join(json.dumps(r) for r in rows))
        return str(path)

    schema = "id long, v string"
    good = file("a.jsonl", [{"id": i, "v": "x"} for i in range(5)])
    assert readers.read_jsonl(spark, good, schema, "id").count() == 5
    for name, rows in {"more": [{"id": 1, "v": "x", "w": 1}], "less": [{"id": 1}], "twice": [{"id": 1, "v": "x"}] * 2}.items():
        with pytest.raises(ContractError):
            readers.read_jsonl(spark, file(name, rows), schema, "id")
    both = readers.read_inputs(spark, {"one": good, "two": good}, schema, key="id", keep=F.col("id") > 1, limit=2)
    assert sorted((r.input_name, r.id) for r in both.collect()) == [("one", 2), ("one", 3), ("two", 2), ("two", 3)]


def test_document_with_sidecar_and_blocks(spark, tmp_path):
    doc, side = tmp_path / "m.json", tmp_path / "m.sha256"
    doc.write_text(json.dumps({"images": [{"p": "a"}]}))
    side.write_text(f"{hashlib.sha256(doc.read_bytes()).hexdigest()}  m.json\n")
    schema = "images array<struct<p:string>>"
    assert readers.read_document(spark, str(doc), schema, str(side)).first().images[0].p == "a"
    doc.write_text("{}")
    with pytest.raises(ContractError):
        readers.read_document(spark, str(doc), schema, str(side))
    page = tmp_path / "r.md"
    page.write_text('x\n<!-- table:begin -->\n| a |\n<!-- table:end -->\n<!-- summary: {"n": 3} -->\n')
    assert readers.read_marked_block(spark, str(page), "table") == "| a |"
    assert readers.read_embedded_json(spark, str(page), "summary", "n long").first().n == 3
    with pytest.raises(ContractError):
        readers.read_marked_block(spark, str(page), "other")


def test_inventory_and_caches(spark, tmp_path):
    folder = tmp_path / "d"
    (folder / "x").mkdir(parents=True)
    (folder / "x" / "a.bin").write_bytes(b"abc")
    row = readers.inventory(spark, str(folder)).first()
    assert (row.path, row.bytes, row.sha256) == ("x/a.bin", 3, hashlib.sha256(b"abc").hexdigest())
    a, b = spark.createDataFrame([(1, 2.0)], "k long, v double"), spark.createDataFrame([(1, 3.0)], "k long, v double")
    assert readers.merge_caches([a, a], key="k", value="v").first().v == 2.0
    with pytest.raises(PySparkException, match="two values"):
        readers.merge_caches([a, b], key="k", value="v").collect()


def test_sinks_refuse(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1.0, True), ("r2", None, False)], "name string, m double, passed boolean")
    ledger = str(tmp_path / "ledger")
    sinks.append_unique(rows, ledger, "name")
    with pytest.raises(ContractError, match="is in the ledger"):
        sinks.append_unique(rows.limit(1), ledger, "name")
    with pytest.raises(ContractError, match="the ledger has"):
        sinks.append_unique(rows.drop("m"), ledger, "name")
    views = str(tmp_path / "views")
    sinks.publish_views(rows, views)
    assert sinks.read_view(spark, views, "unfiltered").count() == 2 and sinks.read_view(spark, views, "filtered").first().name == "r1"
    frozen = str(tmp_path / "frozen")
    assert sinks.freeze(rows, frozen) == sinks.freeze(rows.repartition(3), frozen)
    with pytest.raises(ContractError, match="frozen"):
        sinks.freeze(rows.limit(1), frozen)
    sinks.write_csv(rows.orderBy("name").coalesce(1), str(tmp_path / "csv"), ["m", "name"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()) == [",r2", "1.0,r1", "m,name"]
    sinks.write_jsonl(rows, str(tmp_path / "json"))
    assert json.loads(sorted(r[0] for r in spark.read.text(str(tmp_path / "json")).collect())[0])["m"] == 1.0
    plan = spark.createDataFrame([(1, "s1"), (2, "s2")], "id long, signature string")
    assert [r.id for r in sinks.pending(plan, plan.filter("id = 1"), "id").collect()] == [2]
    with pytest.raises(PySparkException, match="other signature"):
        sinks.pending(plan, plan.withColumn("signature", F.lit("x")), "id").collect()


def test_streams_equal_batches(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "ts timestamp, key string, step long, score double, passed boolean"
    rows = [(f"2024-01-01 00:{m:02}:00", "ab"[m % 2], m, float((m * 7) % 11), m % 3 == 0) for m in range(30)]
    df = spark.createDataFrame([(r[0], *r[1:]) for r in rows], "ts string, key string, step long, score double, passed boolean").withColumn("ts", F.to_timestamp("ts"))
    df.filter("step < 15").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: incremental.stream_table(spark, source, schema)
    run = lambda make, name: incremental.run_available(make(stream()), str(tmp_path / name), str(tmp_path / f"{name}-state"))
    best = lambda s: incremental.running_best(s, key="key", step="step", score="score")
    first = lambda s: incremental.first_seen(s, "key", "ts", "1 hour").select("key", "step")
    funnel = lambda s: incremental.windowed_funnel(s, time="ts", window="10 minutes", delay="0 minutes", by="key")
    for make, name in ((best, "best"), (first, "first"), (funnel, "funnel")):
        run(make, name)
    df.filter("step >= 15").coalesce(1).write.mode("append").parquet(source)
    for make, name in ((best, "best"), (first, "first"), (funnel, "funnel")):
        run(make, name)
    want = []
    for key in "ab":
        top = float("-inf")
        for _, k, step, score, _ in rows:
            if k == key and score > top:
                top = score
                want.append((key, step, score))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "best")).collect()) == sorted(want)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "first")).collect()) == ["a", "b"]
    counted = {(r.start.minute, r.key): (r.total, r.accepted) for r in spark.read.parquet(str(tmp_path / "funnel")).collect()}
    assert counted[(0, "a")] == (5, sum(m % 3 == 0 for m in range(0, 10, 2)))
