"""Benchmark items without an id."""

import hashlib

import pytest

from pairlight.llm import decontaminate
from tests.llm.test_operators import DOCS, words


@pytest.mark.parametrize("block", [1, 10**6])
def test_items_without_an_id_hit_but_are_not_listed(spark, block):
    item, other, short = (" ".join(words(n, s, 900)) for n, s in ((15, 3), (20, 4), (3, 5)))
    docs = [(1, f"ahead {item} after"), (2, f"{other} {short} x"), (3, "clean"), (4, short)]
    items = [(None, item), (None, short), (7, other), (None, other)]
    out = decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()}
    assert got == {1: (15, 0, sha(""), True), 2: (23, 1, sha("7"), True), 3: (0, 0, sha(""), False), 4: (3, 0, sha(""), True)}
