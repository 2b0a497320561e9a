"""The gate over whole pilots, at its own thresholds."""

from pairlight.plans import catalog
from tests.test_all_lines import SCHEMA


def pilot(supplier, extracted, n=42):
    """``n`` responses a format; shapes 0 and 6 of the view are extracted and unsupported."""
    return [(8 * i + (0 if i < extracted else 6), 1, supplier, f, 5.0, 1.0, 0.01, 0.01, "A", "O") for f in (1, 2, 3) for i in range(n)]


def test_whole_pilots_at_34(spark, tmp_path):
    rows = pilot(1, 34) + pilot(2, 33) + pilot(3, 40, 43) + pilot(4, 40, 41) + pilot(5, 40)[:84]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.pilot: (r.complete, r.selected, r.decision) for r in catalog.QUERIES["gate_select"](spark, str(tmp_path)).collect()}
    assert got == {1: (True, "integer", "pass"), 2: (True, None, "fail"), **dict.fromkeys((3, 4, 5), (False, None, "incomplete"))}
    passed = {r.pilot: (r.n, r.passed) for r in catalog.QUERIES["gate_threshold"](spark, str(tmp_path)).collect()}
    assert (passed[1], passed[3]) == ((42, False), (43, False)) and sum(n for n, _ in passed.values()) == len([r for r in rows if r[3] % 3 == 0])
