"""Queries that take every line, on a table where one part has a third of them."""

import random

import pytest

from pairlight.functions.dims import CONDITIONS
from pairlight.plans import catalog

SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    r = random.Random(5)
    rows = [(i // 7, 1 if i % 3 == 0 else r.randrange(2, 40), i, i % 7 + 1, float(r.randrange(1, 50)), 1.0 + i, 0.05, 0.01, r.choice("ARN"), "O") for i in range(2100)]
    sf = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{sf}/lineitem.parquet")
    return sf, rows


def test_every_line_counts(spark, lines):
    sf, rows = lines
    seen, questions = {}, {}
    for row in sorted(rows):
        n = seen[row[1], row[3]] = seen.get((row[1], row[3]), 0) + 1
        questions.setdefault(f"{row[1]}-{n}", {})[CONDITIONS[row[3] - 1]] = row[8] == "A"
    got = {r.question_id: (r.records, r.complete) for r in catalog.QUERIES["complete_clusters"](spark, sf).collect()}
    assert got == {q: (len(c), len(c) == 7) for q, c in questions.items()}
    assert sum(n for n, _ in got.values()) == len(rows)
    whole = [c for c in questions.values() if len(c) == 7]
    accuracy = {r.condition: (r.correct, r.denominator) for r in catalog.QUERIES["paired_accuracy"](spark, sf).collect()}
    assert accuracy == {c: (sum(q[c] for q in whole), len(whole)) for c in CONDITIONS}
    assert len(whole) > len({q.split("-")[0] for q in questions})
