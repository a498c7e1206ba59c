import gzip
import hashlib
import io
import json
from pathlib import Path

import pytest

from millrace.llm import warc

PAGES = [(5, "http://a/x y", "é" * 60), (3, None, "é" * 60), (9, "http://a", "é" * 60), (3, "http://b", "é" * 60), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (None, "u", "é" * 60), (8, "u", "a\r\n\r\nb" * 5000)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS size", "2 AS first")
    got = warc.round_trip(df, folder=str(tmp_path)).collect()
    assert len(got) == len(PAGES)
    want = sorted(((k if k is not None else -1), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if k in (5, 9) else "response", 3 if k in (5, 9) else None) for k, _, h in PAGES)
    assert sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.url for r in got if r.page_id == 5} == {"http://a/x%20y"}
    for path in Path(tmp_path, "normal").glob("*.gz"):  # every member stands alone
        data = path.read_bytes()
        for offset, length, name, kind in map(json.loads, Path(f"{path}.idx").read_text().splitlines()):
            text = gzip.decompress(data[offset : offset + length])
            assert text.startswith(b"WARC/1.1\r\n") and name.encode() in text and f"WARC-Type: {kind}".encode() in text


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df, folder=str(tmp_path)).collect() == []


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_streams_of_one_or_many_members(block, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", block)
    made = [warc.record(i, "u", b"x\r\n\r\n" * i, 5 * i, "d", "response", None) for i in range(5)]
    for packed in (gzip.compress(b"".join(made)), b"".join(map(gzip.compress, made))):
        assert [whole for _, whole in warc.records(io.BytesIO(packed).read)] == made
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records(io.BytesIO(gzip.compress(made[3][:-9])).read))


def test_several_archives_a_task(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "z" * 500) for i in range(40)], "page_id long, url string, html string")
    raw = warc.write_archives(warc.record_types(pages, least=10_000), str(tmp_path), roll=3000).collect()
    assert sum(r.n for r in raw) == 40 and len(raw) > 5
