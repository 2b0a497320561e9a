"""Line logs cut into byte ranges, against a plain reading of each file."""

import hashlib
import json

import pyarrow.parquet as pq
import pytest

from pairlight.plans import catalog
from pairlight.sources import linelog


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 37)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(data: bytes) -> tuple:
    end = data.rfind(b"\n") + 1
    return len(data), data.count(b"\n"), len(data) - end, data[end:].hex(), hashlib.sha256(data[end:]).hexdigest()


LOGS = {
    "a/x.jsonl": b"".join(b'{"i":%d}\n' % i for i in range(60)) + b'{"i":',
    "b/x.jsonl": b"".join(b'{"i":%d}\n' % i for i in range(60)),
    "long.jsonl": b'{"s":"' + b"y" * 500 + b'","i":1}\n{"s":"' + b"z" * 300,
    "only_tail.jsonl": b'{"i":7',
    "newlines.jsonl": b"\n\n\n",
    "carriage.jsonl": b'{"i":1}\r\n{"i":2}\r',
    "not_text.jsonl": b"\xff\xfe\n\x00\xc3\n\xc3",
    "same.jsonl": b'{"i":5}\n{"i":5}\n{"i":5}',
}


def test_tails_across_byte_ranges(spark, small_ranges, tmp_path):
    for name, data in LOGS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    assert linelog.log_lines(spark, str(tmp_path / "a")).select("start").distinct().count() > 5
    got = {r.path.split(f"{tmp_path.name}/")[1]: (r.bytes, r.complete_lines, r.tail_bytes, r.tail_hex, r.tail_sha256) for r in linelog.torn_tails(spark, str(tmp_path)).collect()}
    assert got == {name: plain(data) for name, data in LOGS.items()}


def test_a_byte_order_mark_is_no_tail(spark, tmp_path):
    for name, data in {"whole": b'\xef\xbb\xbf{"i":1}\n', "torn": b'\xef\xbb\xbf{"i":1}\n{"i'}.items():
        (tmp_path / name).write_bytes(data)
    assert {r.file: r.tail_bytes for r in linelog.torn_tails(spark, str(tmp_path)).collect()} == {"whole": 0, "torn": 3}


def test_only_the_tail_is_dropped(spark, small_ranges, tmp_path):
    logs, evidence = tmp_path / "logs", tmp_path / "evidence"
    logs.mkdir()
    for name in ("same.jsonl", "only_tail.jsonl", "carriage.jsonl"):
        (logs / name).write_bytes(LOGS[name])
    rows = linelog.recovered(spark, str(logs), "i int", str(evidence)).collect()
    assert sorted(r.i for r in rows) == [1, 5, 5]
    kept = [json.loads(r.value) for r in spark.read.text(str(evidence)).collect()]
    assert sorted(k["discarded_tail_hex"] for k in kept) == sorted(plain(LOGS[n])[3] for n in ("same.jsonl", "only_tail.jsonl", "carriage.jsonl"))
    assert all(k["sha256"] == hashlib.sha256(bytes.fromhex(k["discarded_tail_hex"])).hexdigest() and k["utc"] for k in kept)


def test_the_queries_against_the_table(spark):
    sf = "/root/testdata/sf0.001"
    events = pq.read_table(f"{sf}/events.parquet").to_pylist()
    kept = [e for e in events for _ in range(2 if e["event_id"] % 1000 == 0 else 1)]
    rows = catalog.QUERIES["recovered_log"](spark, sf).collect()
    assert sorted((r.event_id, r.user_id, r.event_type, r.value) for r in rows) == sorted((e["event_id"], e["user_id"], e["event_type"], e["value"]) for e in kept)
    torn = catalog.QUERIES["torn_tail"](spark, sf).collect()
    assert len(torn) == sum(e["event_id"] % 1000 == 0 for e in events) and all(r.complete_lines == 2 and r.tail_bytes > 1 for r in torn)
