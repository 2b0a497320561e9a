"""Replicates that draw every cluster: against hashlib and NumPy, and against SQL where results are missing."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlight.functions.dims import BOOTSTRAP_SEED, CONDITIONS, FAMILIES
from pairlight.functions.hashing import four_draws
from pairlight.operators import paired
from pairlight.plans import catalog, views
from tests.test_all_lines import SCHEMA, lines  # noqa: F401

NAMES = ["bootstrap_delta_ci", "break_rate_ci"]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def ends(x):
    return np.quantile(x, [0.025, 0.975]).tolist() if len(x) else [None, None]


@pytest.mark.parametrize("family", ["addition", "", "é" * 20, "x" * 43, "x" * 44, "x" * 45, "long" * 50])
def test_four_draws_are_md5s(family):
    ids, blocks = np.array([[10], [99]], dtype=np.uint32), np.array([[1_000_000, 4_294_967, 9_999_999]], dtype=np.uint32)
    drawn = four_draws(["7:", (ids, 2), f":{family}:", (blocks, 7)], (2, 3))
    for i, r in enumerate(ids[:, 0]):
        for k, b in enumerate(blocks[0]):
            h = md5(f"7:{r}:{family}:{b}")
            assert [int(x[i, k]) for x in drawn] == [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]


@pytest.fixture(scope="module")
def drawn(spark, lines):  # noqa: F811
    """A replicate a row: right answers, then lost ones, of each condition; and the number of clusters."""
    found = [(r.family, int(md5(f"part:{r.question_id}")[:8], 16) % 256, r.question_id, [r[c] for c in CONDITIONS]) for r in paired.wide(paired.paired(views.runs(spark, lines[0]))).collect()]
    sums = np.zeros((10_000, 14), dtype=int)
    for family in FAMILIES:
        own = np.array([v for *_, v in sorted(x for x in found if x[0] == family)])
        each = np.hstack([own, own[:, :1] * (1 - own)])
        for r in range(10_000):
            text = "".join(md5(f"{BOOTSTRAP_SEED}:{r}:{family}:{b}") for b in range(-(-len(own) // 4)))
            sums[r] += each[[int(text[8 * i : 8 * i + 8], 16) % len(own) for i in range(len(own))]].sum(axis=0)
    return sums, len(found)


@pytest.mark.parametrize("name", NAMES)
def test_every_cluster_is_drawn(spark, lines, drawn, name):  # noqa: F811
    sums, n = drawn
    rows = catalog.QUERIES[name](spark, lines[0]).collect()
    assert len(rows) == 7
    for r in rows:
        j = CONDITIONS.index(r.condition)
        s, b, clean = sums[:, j], sums[:, 7 + j], sums[:, 0]
        want = ends((s - clean) / n) if name == "bootstrap_delta_ci" else [*ends(b[clean > 0] / clean[clean > 0]), (clean == 0).sum()]
        assert np.allclose(r[1:], want, rtol=0, atol=1.5e-9)


def test_replicates_in_any_tasks_and_blocks(spark, lines, monkeypatch):  # noqa: F811
    """However replicates and draws are shared out, and whatever is last in a block."""
    pairs = paired.paired(views.runs(spark, lines[0]))
    whole = sorted(map(tuple, paired.drawn_bootstrap(pairs, 120).collect()))
    assert len(whole) == 120 and {r[1] for r in whole} == {paired.wide(pairs).count()}
    some = F.col("question_id").startswith("1-")
    parted = paired.drawn_bootstrap(pairs.withColumn("family", F.when(~some, F.col("family"))), 3).collect()  # clusters of no family aren't drawn
    assert {r.total for r in parted} == {paired.wide(pairs.where(~some)).count()}
    own = np.arange(131, dtype=np.uint8)
    ids = np.array([0, 9, 10, 99, 100, 4_321])
    wanted = [np.bincount([int((h := md5(f"5:{r}:f:{i // 4}"))[8 * (i % 4) : 8 * (i % 4) + 8], 16) % 131 for i in range(131)], minlength=131).tolist() for r in ids]
    for block in (1, 7, 40, 1 << 14):
        monkeypatch.setattr(paired, "BLOCK", block)
        assert paired._times(5, ids, "f", own, 131).tolist() == wanted
    monkeypatch.setattr(paired, "DRAWS", 1_000)
    assert sorted(map(tuple, paired.drawn_bootstrap(pairs, 120).collect())) == whole


@pytest.mark.parametrize("where", ["l_suppkey % 300 = 2", "l_linenumber = 3", "l_linenumber = 1", "l_partkey % 2 = 0", "true"])
@pytest.mark.parametrize("name", NAMES)
def test_clusters_with_missing_results_count(spark, lines, tmp_path, name, where):  # noqa: F811
    """A cluster that lacks one condition's result is drawn and counts for the other conditions, as in SQL."""
    flag = F.when(~F.coalesce(F.expr(where), F.lit(False)), F.col("l_returnflag"))
    spark.createDataFrame(lines[1], SCHEMA).withColumn("l_returnflag", flag).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLES[name]).fetchall())
    assert len(rows) == 7
    for got, row in zip(rows, want, strict=True):
        assert got[0] == row[0] and [x is None for x in got] == [x is None for x in row]
        assert all(x is None or abs(x - y) < 1.5e-9 for x, y in zip(got[1:], row[1:], strict=True))


def test_no_complete_cluster(spark, lines, tmp_path):  # noqa: F811
    spark.createDataFrame([r for r in lines[1] if r[3] != 4], SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert all(not catalog.QUERIES[name](spark, str(tmp_path)).collect() for name in NAMES)
