"""The co-bucketed pair against the same rules in Python, over the files as they lie there."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pairlight.llm import cobucket
from pairlight.llm.cobucket import crc_bucket, deal, surrogates


def brute(name, rows, sales, buckets):
    """bucket -> (rows in order, ids_sha256, lineage_sha256, rewritten)."""
    crc = lambda s: zlib.crc32(s.encode()) % buckets
    home = lambda r: buckets + 1 if r["sale_id"] is None else crc(f"line{r['sale_id']}")
    have = {r["sale_id"] for r in sales}
    if name == "sales":
        final, start = home, lambda r: home(r) - (home(r) % 3 == 1)
    else:
        final = lambda r: buckets if r["sale_id"] is not None and r["sale_id"] not in have else home(r)
        start = lambda r: 0 if r["item_id"] is None else crc(str(r["item_id"]))
    order = lambda r: [(0, 0) if r[c] is None else (1, r[c].encode() if isinstance(r[c], str) else r[c]) for c in ["sale_id", *(c for c in r if c != "sale_id")]]
    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    dealt, sizes = defaultdict(list), Counter(map(start, rows))
    for r in rows:
        dealt[final(r)].append(r)
    out = {}
    for b, own in dealt.items():
        own.sort(key=order)
        line = Counter(map(start, own))
        stays = len(line) == 1 and sizes[next(iter(line))] == len(own)
        out[b] = own, sha("" if r["sale_id"] is None else str(r["sale_id"]) for r in own), sha(f"{s}:{n}" for s, n in sorted(line.items())), not stays
    return out


def compare(spark, sales, lines, buckets, folder):
    data = {"sales": sales.collect(), "sale_lines": lines.collect()}
    data = {n: [r.asDict() for r in rows] for n, rows in data.items()}
    got = cobucket.cobucket(sales, lines, "sale_id", "item_id", ("sales", "sale_lines"), folder=folder, buckets=buckets).collect()
    have = Counter(r["sale_id"] for r in data["sales"] if r["sale_id"] is not None)
    joined = Counter()
    for r in data["sale_lines"]:
        if have[r["sale_id"]]:
            joined[zlib.crc32(f"line{r['sale_id']}".encode()) % buckets] += have[r["sale_id"]]
    wanted = {n: brute(n, rows, data["sales"], buckets) for n, rows in data.items()}
    assert len(got) == sum(map(len, wanted.values()))
    for r in got:
        rows, ids, lineage, rewritten = wanted[r.table_name].pop(r.bucket)
        assert (r.ids_sha256, r.lineage_sha256, r.n_rows, r.rewritten, r.n_joined) == (ids, lineage, len(rows), rewritten, joined.get(r.bucket, 0))
        read = pq.read_table(r.path.removeprefix("file://"))
        assert read.to_pylist() == rows and ",".join(read.column_names) == r.columns
    for n in data:
        there = {f for f in os.listdir(f"{folder}/{n}") if f.startswith("part-")}
        assert there == {r.path.rsplit("/", 1)[-1] for r in got if r.table_name == n}
    assert os.listdir(folder) and not os.path.exists(f"{folder}-placed")
    return got


def test_surrogates_are_one_to_one(spark):
    keys = surrogates(spark, 29)
    assert len(set(keys)) == 29
    at = deal(spark.range(500), F.col("id") % 29, keys).select("id", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.id % 29 for r in at)


def test_pair(spark, tmp_path):
    draw = random.Random(2)
    pick = lambda *v: draw.choice([*v, None])
    sales = spark.createDataFrame([(i, pick("é", "z", "Z", ""), pick(1.5, -2.0)) for i in range(80)], "sale_id long, file_path_of string, bucket_no double")
    lines = spark.createDataFrame([(pick(7, 7, 7, *range(100)), pick(1, 2, 3, 40), pick("a", "ä", "b")) for _ in range(900)], "sale_id long, item_id long, is_there string")
    got = compare(spark, sales, lines.unionByName(lines.limit(20)), 9, str(tmp_path / "pair"))
    assert {r.bucket for r in got} >= {9, 10}


def test_files_that_stay(spark, tmp_path):
    """Buckets of a single start: sales of one bucket, lines whose start holds just the nulls, whatever its number."""
    own = [i for i in range(2000) if zlib.crc32(f"line{i}".encode()) % 30 == 4][:5]
    sales = spark.createDataFrame([(i, "s") for i in own], "sale_id long, status string")
    lines = spark.createDataFrame([(None, 5), (None, 5), (own[0], 8)], "sale_id long, item_id long")
    got = compare(spark, sales, lines, 30, str(tmp_path / "stay"))
    assert all(not r.rewritten for r in got) and {r.bucket for r in got} == {4, 31}
    assert all(int(r.path.rsplit("part-", 1)[1].split("-")[0]) != r.bucket for r in got)


def test_empty(spark, tmp_path):
    sales = spark.createDataFrame([], "sale_id long, status string")
    lines = spark.createDataFrame([], "sale_id long, item_id long")
    assert compare(spark, sales, lines, 6, str(tmp_path / "none")) == []
    some = spark.createDataFrame([(3, 4), (None, None)], "sale_id long, item_id long")
    assert {r.bucket for r in compare(spark, sales, some, 6, str(tmp_path / "lines"))} == {6, 7}


def test_bucket_numbers(spark):
    got = spark.range(50).select("id", crc_bucket(F.col("id"), "line").alias("b")).collect()
    assert all(r.b == zlib.crc32(f"line{r.id}".encode()) % 300 for r in got)
