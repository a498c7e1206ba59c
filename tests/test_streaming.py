import json
import os
import random

from millrace.streaming.folds import fold_status, last_state, stream_status, stream_windows
from pyspark.sql import functions as F

SCHEMA = "k string, ts timestamp, n int, status string"


def test_stream_folds_like_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"k": f"k{rng.randrange(5)}", "ts": f"2024-01-01T00:{rng.randrange(60):02d}:00", "n": i, "status": rng.choice("abc")} for i in range(200)]
    rng.shuffle(rows)
    src = tmp_path / "in"
    src.mkdir()
    for i in range(4):  # out of order over files
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows[i::4])))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    stream_status(stream, "k", ["ts", "n"], "status", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = fold_status(spark.read.schema(SCHEMA).json(str(src)), "k", ["ts", "n"], "status")
    assert sorted(map(tuple, last_state(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_closed_windows_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, minute in enumerate((1, 30, 59)):
        (src / f"{i}.json").write_text(json.dumps({"k": "a", "ts": f"2024-01-01T{i:02d}:{minute:02d}:00", "n": i, "status": "x"}))
        os.utime(src / f"{i}.json", (1_700_000_000 + 60 * i,) * 2)  # files are read in this order
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    stream_windows(stream, "ts", "10 minutes", "1 hour", [F.count("*").alias("n")], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(str(r.window_start) for r in got) == ["2024-01-01 00:00:00", "2024-01-01 01:00:00"]
