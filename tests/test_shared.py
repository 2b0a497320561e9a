"""Documents, leases and trees on the shared file system."""

import hashlib
import json
import os
import threading
import uuid
from collections import Counter

import pyarrow.parquet as pq
import pytest

from pairlight.operators import integrity
from pairlight.plans import catalog
from pairlight.sources import shared
from pairlight.streaming import runlog
from pairlight.streaming.lease import Lease


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_a_document_is_replaced_whole(spark, tmp_path, prefix):
    path = f"{prefix}{tmp_path}/more/d.json"
    for document in ({"a": 1, "é": None}, {"b": [1.5]}):
        shared.write_document(spark, path, document)
        assert shared.read_document(path) == document
    assert (tmp_path / "more/d.json").read_text() == json.dumps({"b": [1.5]}, indent=2) + "\n"
    assert shared.names(f"{prefix}{tmp_path}/more") == ["d.json"] and shared.read_document(f"{path}x") is None


def test_a_document_is_created_once(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append((shared.create_once(spark, f"{tmp_path}/n/1.json", {"i": i}), i))) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (first,) = [i for ok, i in won if ok]
    assert shared.read_document(f"{tmp_path}/n/1.json") == {"i": first} and os.listdir(tmp_path / "n") == ["1.json"]


def test_a_dead_writer_is_replaced(spark, tmp_path):
    now = [0.0]
    run, clock = f"run-{uuid.uuid4().hex}", lambda: now[0]
    dead = Lease(spark, run, 10, clock).take()
    with pytest.raises(ValueError, match="being written"):
        Lease(spark, run, 10, clock).take()
    now[0] = 8.0
    dead.check()  # renewed to 18
    now[0] = 12.0
    with pytest.raises(ValueError, match="being written"):
        Lease(spark, run, 10, clock).take()
    now[0] = 19.0
    heir = Lease(spark, run, 10, clock).take()
    assert (dead.number, heir.number) == (1, 2)
    cases, out = spark.range(5).selectExpr("concat('c', id) as case_id", "id as ordinal", "concat('p', id) as prompt"), str(tmp_path / "run")
    with pytest.raises(ValueError, match="lease 1 is lost"):
        runlog.write_run(cases, out, "case_id", 3, lease=dead)
    assert spark.read.parquet(out).count() == 0
    assert runlog.write_run(cases, out, "case_id", 3, lease=heir) == ("complete", 0) and spark.read.parquet(out).count() == 5
    dead.release()  # changes nothing for the heir
    heir.check()
    heir.release()
    assert Lease(spark, run, 10, clock).take().number == 3


def test_a_lease_that_ran_out_is_not_renewed(spark, tmp_path):
    now = [0.0]
    lease = Lease(spark, f"late-{uuid.uuid4().hex}", 10, lambda: now[0]).take()
    now[0] = 11.0
    with pytest.raises(ValueError, match="is lost"):
        lease.check()


def test_a_tree_is_hashed_in_chunks(spark, tmp_path):
    data = {"a.json": b"x\n", "in/a.json": b"", "in/deep er/é.bin": os.urandom(3 * shared.CHUNK + 5), "_hidden": b"1"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.name: (r.bytes, r.sha256, r.ends_with_newline) for r in shared.tree_files(spark, str(tmp_path)).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest(), c.endswith(b"\n")) for n, c in data.items() if n != "_hidden"}
    assert [r.name for r in shared.tree_files(spark, f"file://{tmp_path}/a.json").collect()] == ["a.json"]


def test_tree_check(spark):
    schema = "name string, bytes long, sha256 string"
    manifest = spark.createDataFrame([("same", 1, "a"), ("gone", 1, "a"), ("size", 1, "a"), ("hash", 1, "a"), ("w.bin", 1, "a"), ("big", 99 << 20, "a"), (None, None, None)], schema)
    files = spark.createDataFrame([("same", 1, "a"), ("more", 1, "a"), ("size", 2, "b"), ("hash", 1, "b"), ("w.bin", 1, "a"), ("big", 99 << 20, "a"), (None, None, None)], schema)
    want = {"same": None, "gone": "missing", "more": "extra", "size": "size", "hash": "hash", "w.bin": "barred", "big": "large", None: None}
    assert {r.name: r.problem for r in integrity.tree_check(manifest, files).collect()} == want
    nothing = files.where("false")
    assert integrity.tree_check(nothing, nothing).count() == 0


def test_the_query_against_the_table(spark):
    sf = "/root/testdata/sf0.01"
    want = Counter()
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    hive = "__HIVE_DEFAULT_PARTITION__"
    for lang, block in {(d["lang"] or hive, d["doc_id"] // 1000) for d in docs}:
        want[lang, str(block), {1: "size", 2: "hash"}.get(block % 7)] += 1
        want[lang, str(block), "missing"] += block % 7 == 3
    for lang, block in {(d["lang"] or hive, d["doc_id"] // 1000) for d in docs if d["doc_id"] % 7000 == 0}:
        want[lang, f"late-{block}", "extra"] += 1
    assert Counter(map(tuple, catalog.QUERIES["release_tree"](spark, sf).collect())) == +want
