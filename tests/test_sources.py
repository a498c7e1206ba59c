import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import controls
from millrace.sources import records


def test_json_lines_policies(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k": 1, "v": "x"}\n\n{bad\n{"k": 2}\n')
    path, schema = str(p), "k int, v string"
    assert sorted(r.k for r in records.json_lines(spark, path, schema, "drop").select("k").collect()) == [1, 2]
    kept = records.json_lines(spark, path, schema, "keep").cache()
    assert kept.filter("_corrupt_record IS NOT NULL").count() == 1 and kept.first().source_file.endswith("a.jsonl")
    with pytest.raises(Exception, match="(?i)malformed"):
        records.json_lines(spark, path, schema).collect()


def test_bom_csv_and_shards(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("﻿id,v\n1,2\n".encode())
    assert records.csv_strings(spark, str(tmp_path / "b.csv")).first().asDict() == {"id": "1", "v": "2"}
    (tmp_path / "t.txt").write_bytes("﻿a\n\n b\n".encode())
    assert [r.value for r in records.text_lines(spark, str(tmp_path / "t.txt")).collect()] == ["a", " b"]
    d = tmp_path / "s"
    for i in range(3):
        (d / f"r{i}").mkdir(parents=True)
        (d / f"r{i}" / f"{i}.jsonl").write_text(json.dumps({"k": i}) + "\n")
    (d / "summary.jsonl").write_text('{"k": 9}\n')
    got = records.shards(spark, str(d), "k int", "*.jsonl", expected=3)
    assert sorted((r.k, r.s) for r in got.select("k", records.step_of(F.col("source_file")).alias("s")).collect()) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(ValueError, match="shards"):
        records.shards(spark, str(d), "k int", "*.jsonl", expected=4)


def test_envelopes_children_and_manifest(spark, tmp_path):
    texts = ['{"tracks": [{"a": 1}, {"a": 2}]}', '[{"a": 3}]', '{"videos": [{"a": 4}]}', '{"x": {"a": 5}}']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert sorted(r.a for r in records.envelope(df, ["tracks", "videos"], "struct<a:int>").collect()) == [1, 2, 3, 4, 5]
    parents = spark.createDataFrame([("v", "p", [("c1", None), ("c2", "own")])], "video string, fps string, kids array<struct<id:string,fps:string>>")
    assert [r.asDict() for r in records.flatten_children(parents, "kids", ["video", "fps"]).collect()] == [{"id": "c1", "fps": "p", "video": "v"}, {"id": "c2", "fps": "own", "video": "v"}]
    (tmp_path / "x.MP4").write_bytes(b"123")
    r = records.file_manifest(spark, str(tmp_path)).first()
    assert r.size == 3 and r.suffix == ".mp4" and r.path == "x.MP4" and len(r.video_id) == 20


def test_sinks_and_ledger(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a"], None), (1, [], "y")], "id int, tags array<string>, note string")
    records.write_csv(df, str(tmp_path / "c"), ["id"])
    back = records.csv_strings(spark, str(tmp_path / "c"))
    assert back.columns == ["id", "note", "tags"] and {r.tags for r in back.collect()} == {'["a"]', "[]"}
    same = records.ledger({"x": df, "y": df.repartition(3).orderBy("id")}, {}).collect()
    assert same[0].digest == same[1].digest and same[0].records == 2
    new = spark.createDataFrame([("b", 2)], "name string, v int")
    old = spark.createDataFrame([("a", 1), ("b", 1)], "name string, v int")
    assert {r.name: r.v for r in records.registry_upsert(old, new, "name").collect()} == {"a": 1, "b": 2}
    wide = records.wide_by_step(spark.createDataFrame([(1, "l", 0.5), (2, "r", 0.7)], "step int, tag string, value double"), "step", "tag", "value", ["l", "r"])
    assert {r.step: (r.l, r.r) for r in wide.collect()} == {1: (0.5, None), 2: (None, 0.7)}


def test_variants_and_interleave(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert controls.variants(df, {"a": F.lit("x"), "b": F.lit("y")}).count() == 4
    assert [(r.place, r.side) for r in controls.interleave(df, df, "k").orderBy("place", "side").collect()] == [(1, 0), (1, 1), (2, 0), (2, 1)]
