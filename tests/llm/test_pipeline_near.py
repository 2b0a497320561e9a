"""The near_dedup stage against a brute force at its own threshold, 0.8."""

import corpus_pipeline as pipeline
from pairlight.llm import near_dedup
from tests.llm.test_operators import words
from tests.llm.test_pipeline import frame


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows, share):
    """Ids that are the smallest of their component, linked at ``share`` of 100."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= share * len(sets[a] | sets[b]):
                p, q = sorted((root[a], root[b]))
                root = {i: p if r == q else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def corpus():
    """Bases of 124 words (120 shingles), each with a copy whose first k words differ: similarity (120 - k) / (120 + k)."""
    rows = []
    for k in range(2, 22):
        base = words(124, 500 + k, 2000)
        rows += [(k * 10, " ".join(base)), (k * 10 + 1, " ".join([f"new{k}x{j}" for j in range(k)] + base[k:]))]
    return rows


def test_the_stage_links_at_80(spark):
    rows = corpus()
    want = brute_kept(rows, 80)
    assert len(brute_kept(rows, 85)) > len(want) > len(rows) // 2
    stage = dict(pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, frame(spark, rows), "").collect()} == want


def test_bands_keep_the_miss_rate():
    for share in (0.8, 0.85, 0.95):
        n = near_dedup.bands_for(share)
        assert (1 - share**near_dedup.ROWS) ** n < 1e-6 <= (1 - share**near_dedup.ROWS) ** (n - 1)
    assert near_dedup.bands_for(0.85) == 24
