import gzip
import hashlib
import io
import os
import random

import pytest

from skyspine.llm import warc
from skyspine.session import scratch


def archive(seed, n=60):
    rng = random.Random(seed)
    bodies = [rng.randbytes(rng.choice([0, 3, 500, 9000])) + warc.MAGIC * rng.randrange(3) for _ in range(n)]
    bodies[7] = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx", compresslevel=0)  # a record inside a payload
    bodies[8] = rng.randbytes(200_000)
    parts = [warc.member("response", k, f"http://h/é {k}", warc.digest_of(b), len(b), None, b) for k, b in enumerate(bodies)]
    return bodies, parts


@pytest.mark.parametrize("step", [1000, 4096, 65_536, 10 ** 7])
def test_any_ranges_give_each_record_once(step):
    bodies, parts = archive(step)
    data = b"".join(parts)
    got = []
    for start in range(0, len(data), step):
        got += list(warc.records_in(io.BytesIO(data), start, start + step, len(data)))
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    assert [(a, f["WARC-Record-ID"], b) for a, f, b in got] == [(a, f"<urn:row:{k}>", b) for (k, b), a in zip(enumerate(bodies), starts)]


def test_broken_bytes_are_passed_over():
    bodies, parts = archive(2, 20)
    data = parts[0] + warc.MAGIC + b"no gzip" + parts[1] + parts[2][:30] + parts[3]
    got = [f["WARC-Record-ID"] for _, f, _ in warc.records_in(io.BytesIO(data), 0, len(data), len(data))]
    assert got == ["<urn:row:0>", "<urn:row:1>", "<urn:row:3>"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id LONG, url STRING, html STRING, size INT, digest STRING").repartition(3)


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/é?x=1 2", "same"), (2, None, "same"), (3, "", "same"), (3, "u", "same"), (4, "http://b\r\nX: y", None), (5, "v", ""), (6, "w", "ä" * 300_000),
            (None, "n", "alone"), (8, "z", "only")]
    back = warc.read_archives(spark, warc.write_archives(pages(spark, rows), scratch(spark, "warc")), range_bytes=100)
    got = sorted((r["id"] is None, r["id"] or 0, r["url"] or "", r["record_type"], r["refers_to"], bytes(r["payload"]).decode()) for r in back.collect())
    same = {"same": 3, "": 5}
    want = []
    for i, u, h in rows:
        h = h or ""
        first = same.get(h, i)
        want.append((i is None, i or 0, u or "", "response" if first == i else "revisit", None if first == i else first, h if first == i else ""))
    assert got == sorted(want)
    for r in warc.query(pages(spark, rows)).collect():
        payload = next((h or "") for i, _, h in rows if i == r["page_id"]).encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == warc.digest_of(payload)
        assert r["payload_sha1"] in (None, hashlib.sha1(payload).hexdigest())
    assert warc.query(pages(spark, [])).collect() == []


def test_small_payloads_may_be_left_whole(spark):
    files = warc.write_archives(pages(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "longer"), (4, "d", "longer")]), scratch(spark, "warc"), min_bytes=3)
    kinds = {r["id"]: r["record_type"] for r in warc.read_archives(spark, files).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archives_are_plain_gzip(spark):
    for r in warc.write_archives(pages(spark, [(1, "a", "xx"), (2, "b", "yy")]), scratch(spark, "warc")).collect():
        assert os.path.getsize(r["path"].removeprefix("file:")) == r["size"]
        assert gzip.open(r["path"].removeprefix("file:")).read().count(b"WARC/1.1\r\n") == r["records"]
