import random
from datetime import datetime, timedelta


from millrace.streaming.flush import replay, stream_flushes

START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, id long"


def plain(rows, most, seconds):
    out, first = [], {}
    for k, t, i in rows:
        if None not in (k, t, i) and ((k, i) not in first or t < first[k, i]):
            first[k, i] = t
    for key in {k for k, _ in first}:
        opened, items = None, []
        for t, i in sorted((t, str(i)) for (k, i), t in first.items() if k == key):
            if opened and t >= opened + timedelta(seconds=seconds):
                out.append((key, "time", ",".join(items)))
                opened, items = None, []
            opened = opened or t
            items.append(i)
            if len(items) == most:
                out.append((key, "count", ",".join(items)))
                opened, items = None, []
        if items:
            out.append((key, "open", ",".join(items)))
    return sorted(out)


def events(seed, n):
    rng = random.Random(seed)
    return [(rng.choice("aaab"), START + timedelta(milliseconds=rng.randrange(0, 400_000)), rng.randrange(0, n)) for _ in range(n)]


def test_replay_against_a_plain_fold(spark):
    rows = events(1, 300) + [(None, START, 1), ("a", None, 2), ("a", START, None)]
    got = replay(spark.createDataFrame(rows, SCHEMA), "k", "ts", "id", 3, 5).collect()
    assert sorted((r.key, r.reason, r["items"]) for r in got) == plain(rows, 3, 5)
    assert all(r.closed - r.opened <= 5_000_000 and r.n == len(r["items"].split(",")) for r in got)
    assert replay(spark.createDataFrame([], SCHEMA), "k", "ts", "id", 3, 5).collect() == []


def test_stream_equals_replay_over_a_restart(spark, tmp_path):
    rows = sorted(events(2, 120), key=lambda r: r[1])
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    late = [("z", START + timedelta(hours=h), 10_000 + h) for h in (1, 2, 3)]  # moves the watermark past all others
    for step, part in enumerate((rows[:50], rows[45:90], rows[90:] + late)):  # some come again in the next step
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{step}"))
        for f in (tmp_path / f"part{step}").glob("*.parquet"):
            f.rename(source / f"{step}.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        stream_flushes(stream, "k", "ts", "id", 3, 5, "1 second", out, str(tmp_path / "checkpoint")).awaitTermination(120)
    got = sorted((r.key, r.reason, r["items"]) for r in spark.read.parquet(out).collect() if r.key != "z")
    want = [(k, "time" if r == "open" else r, i) for k, r, i in plain(rows, 3, 5)]
    assert got == sorted(want)
