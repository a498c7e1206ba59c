import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import geom, text
from millrace.operators import gates
from millrace.sources import records


def test_index_in_three_shapes_with_bad_fields(spark):
    texts = ['[{"id": 1, "d": " EN ", "c": "0.4"}]', '{"items": [{"id": 2, "d": "xx", "c": "7"}]}', '{"k": {"id": 3}}', "not json", None]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = records.index_rows(df, ["videos", "items"], "struct<id:bigint,d:string,c:string>", {"d": (["en"], "other")}, {"c": (0.0, 1.0, 0.5)})
    assert sorted((r.id, r.d, r.c) for r in got.collect()) == [(1, "en", 0.4), (2, "other", 1.0), (3, "other", 0.5)]


def test_inventory_inherits_only_what_is_missing(spark):
    nested = {"videos": [{"v": 1, "d": "x", "kids": [{"k": 1}, {"k": 2, "d": "own"}]}, {"v": 2, "d": "y", "kids": []}, {"v": 3}]}
    flat = {"kids": [{"v": 9, "k": 3, "d": None}]}
    df = spark.createDataFrame([(json.dumps(nested),), (json.dumps(flat),), ("{}",), ("[]",), (None,)], "value string")
    got = records.inventory(df, "videos", "kids", "v:long,d:string", "v:long,d:string,k:long", ["v", "d"])
    assert sorted((r.v, r.d or "", r.k) for r in got.collect()) == [(1, "own", 2), (1, "x", 1), (9, "", 3)]


def test_ranks_fall_back_and_other_errors_pass(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.json").write_text('{"k": 1}\n')
    (tmp_path / "deep" / "summary.json").write_text('{"k": 2}\n')
    got = records.ranked_shards(spark, str(tmp_path), "k long", ["rank_*.jsonl", "rank_*/*.json"])
    assert [r.k for r in got.collect()] == [1]
    (tmp_path / "rank_0.jsonl").write_text('{"k": 3}\n')
    got = records.ranked_shards(spark, str(tmp_path), "k long", ["rank_*.jsonl", "rank_*/*.json"])
    assert [r.k for r in got.collect()] == [3]
    with pytest.raises(Exception, match="(?i)parse|syntax"):
        records.ranked_shards(spark, str(tmp_path), "no such ( type", ["rank_*.jsonl"])


def test_documents_below_read_whole_files_and_refuse_broken_ones(spark, tmp_path):
    for n, folder in enumerate(("a", "a/b", "c")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "manifest.json").write_text(json.dumps({"n": n}, indent=1))
    (tmp_path / "c" / "other.json").write_text('{"n": 9}')
    roots = [str(tmp_path / "a"), str(tmp_path / "c")]
    assert sorted(r.n for r in records.documents_below(spark, roots, "n long", "manifest.json").collect()) == [0, 1, 2]
    (tmp_path / "c" / "manifest.json").write_text('{"n": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.documents_below(spark, roots, "n long", "manifest.json").collect()


def test_csv_keeps_quotes_lists_and_empty_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a,b", 'c"d'], 'say "x", y'), (2, None, None), (3, [], "")], "id int, tags array<string>, note string")
    records.write_csv(df, str(tmp_path / "c"), ["id"])
    back = {r.id: (json.loads(r.tags) if r.tags else None, r.note) for r in records.csv_strings(spark, str(tmp_path / "c")).collect()}
    assert back == {"1": (["a,b", 'c"d'], 'say "x", y'), "2": (None, ""), "3": ([], "")}


def test_split_takes_the_first_predicate_and_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "ab")], "k int, v string")
    records.write_split(df, str(tmp_path / "s"), [("x", F.contains("v", F.lit("a"))), ("y", F.contains("v", F.lit("b")))])
    got = spark.read.parquet(str(tmp_path / "s"))
    assert {r.k: r.output for r in got.collect()} == {1: "x", 2: "y", 3: "rest", 4: "x"}


def test_manifest_faults_of_nulls_blanks_and_repeats(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", " "), (None, "x"), ("c", "x")], "k string, f string")
    got = sorted((r.k or "", r.fault) for r in gates.manifest_faults(df, "k", ["f", "k"]).collect())
    assert got == [("", "missing k"), ("a", "missing f"), ("a", "repeated"), ("b", "missing f")]
    assert gates.manifest_faults(df.limit(0), "k", ["f"]).count() == 0


def test_sides_pass_over_what_decides_nothing(spark):
    rows = [("REAL ", "k:fake", None, None), ("?", "k:FAKE", None, None), (None, None, ["x\\real\\1"], None), (None, None, ["a/real/1", "a/fake/1"], "<Answer>fake</answer>"), (None, None, None, "none"), ("", "", [], "")]
    df = spark.createDataFrame(rows, "e string, k string, p array<string>, a string")
    value, source = text.pair_side(F.col("e"), F.col("k"), F.col("p"), F.col("a"), ("real", "fake"))
    assert [(r[0], r[1]) for r in df.select(value, source).collect()] == [("real", "stated"), ("fake", "key"), ("real", "path"), ("fake", "answer"), (None, None), (None, None)]


def test_whole_boxes_clip_round_and_refuse_empty_ones(spark):
    df = spark.createDataFrame([(-5.0, 0.5, 1.5, 9.0, 4, 8), (1.0, 1.0, 1.2, 5.0, 4, 8), (0.0, 0.0, 1.0, 1.0, 0, 8), (None, 0.0, 1.0, 1.0, 4, 8)], "x1 double, y1 double, x2 double, y2 double, w int, h int")
    b = geom.whole_box(F.struct("x1", "y1", "x2", "y2"), F.col("w"), F.col("h"))
    got = [tuple(r.b) if r.b else None for r in df.select(b.alias("b")).collect()]
    assert got == [(0, 0, 500, 1000), None, None, None]
