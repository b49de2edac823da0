import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from verdictframe.llm import warc


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 64, 129])
def test_loser_tree_merges_in_order(count):
    rng = random.Random(count)
    runs = [sorted((rng.choice("abc"), rng.randint(0, 50), k) for _ in range(rng.choice([0, 1, 5, 40]))) for k in range(count)]
    tree = warc.LoserTree([list(r) for r in runs])
    assert [runs[r][k] for r, k in tree] == list(heapq.merge(*runs))


def test_url_keys():
    assert warc.url_key("HTTP://me@Www.Example.com:80/A/b?Q=1#x") == "com,example,www)/a/b?q=1"
    assert warc.url_key("https://example.com") == "com,example)/"
    assert warc.url_key("no address") == "no address"


BODY = "<html>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "é" * 60
ROWS = [
    (5, "http://a.example/x", BODY), (3, "http://a.example/x", BODY), (9, "http://b.example/", BODY), (3, "http://a.example/x", BODY),
    (None, "http://a.example/x", BODY), (1, None, "short"), (2, "http://c.example\r\nWARC-Type: x", "short"), (4, "", None), (6, "u v", ""),
    (7, "http://a.example/x", "z" * 99), (8, "http://a.example/x", "z" * 99), (10, "http://a.example/x", "y" * 100), (11, "q", "y" * 100),
    (None, "http://n.example/", "n" * 200), (None, "http://n.example/", "n" * 200), (12, "http://l.example/", "long " * 400_000),
]


def plainly(rows):
    out = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if r[2] == html and r[0] is not None] if len(data) >= 100 else []
        first = min(same, default=None)
        revisit = first is not None and first != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def pages(spark, rows, parts=4):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    frame = pages(spark, ROWS).withColumns({c: F.lit("own") for c in ("digest", "bytes", "payload", "captured", "part")})
    got = warc.archived(frame)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == plainly(ROWS)
    warc.write_archives(frame, f"{tmp_path}/warc")
    payloads = {(r.page_id, bytes(r.payload)) for r in warc.read_payloads(spark, f"{tmp_path}/warc").collect()}
    assert payloads == {(r[0], (r[2] or "").encode()) for r, kind in zip(ROWS, [next(p for p in plainly([*ROWS]) if p[0] == r[0] and p[1] == len((r[2] or "").encode()))[3] for r in ROWS]) if kind == "response"}
    assert spark.read.format("binaryFile").load(f"{tmp_path}/warc").count() > 3


def test_histories_are_ordered_over_ranges(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    hot = [(k, "http://hot.example/", f"{k % 7}" * 150) for k in range(200)]
    rows = hot + [(k, f"http://h{rng.randint(0, 30)}.example/{rng.randint(0, 2)}", "x" * rng.randint(0, 200)) for k in range(200, 400)]
    got = warc.archived(pages(spark, rows, 6)).orderBy("part", "number").collect()
    assert len({r.part for r in got}) > 5
    keys = [(r.urlkey, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == 400
    ranks = {}
    for r in got:
        ranks[r.urlkey] = ranks.get(r.urlkey, 0) + 1
        assert r.capture_rank == ranks[r.urlkey]


def test_own_capture_times_and_damage(spark, tmp_path):
    frame = pages(spark, [(1, "http://a.example/", "one"), (2, "http://a.example/", "two")], 1)
    warc.write_archives(frame, f"{tmp_path}/w", captured=F.timestamp_seconds(F.lit(1_000_000_000) - F.col("page_id")))
    got = warc.merged_index(warc.read_archives(spark, f"{tmp_path}/w")).orderBy("number").collect()
    assert [r.page_id for r in got] == [2, 1] and got[0].captured == "20010909014638"
    data = spark.read.format("binaryFile").load(f"{tmp_path}/w").collect()[0].content
    assert len(list(warc.records_of(memoryview(data)))) == 2
    with pytest.raises(ValueError, match="digest"):
        [warc.capture(own, http, payload) for *_, own, http, payload in warc.records_of(memoryview(bytes(data).replace(b"two", b"tow")))]
    with pytest.raises(ValueError):
        list(warc.records_of(memoryview(b"x" + data)))


def test_empty(spark):
    assert warc.archived(pages(spark, [])).count() == 0
