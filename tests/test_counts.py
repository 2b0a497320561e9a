"""Counts from counters: the binomial law, the multinomial's sums, the SQL twin, the cost."""

import math

import duckdb
import numpy as np
import pytest

from pairlight.functions import counts

CASES = [(1170, 300, 1170), (1170, 3, 1170), (50, 10, 77), (10**9, 5, 10**9), (10**9, 4 * 10**8, 10**9), (7, 1, 3), (100, 99, 100), (24, 5, 12), (5000, 4990, 5000)]


def keys(n, hits, of, many=20_000):
    return [f"law:{n}:{hits}:{of}:{i}" for i in range(many)]


@pytest.mark.parametrize("case", CASES)
def test_binomial_law(case):
    n, hits, of = case
    drawn, p = counts.binomial(keys(*case), np.full(20_000, n), hits, of), hits / of
    assert drawn.min() >= 0 and drawn.max() <= n
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    middle, spread = n * p, math.sqrt(n * p * (1 - p))
    if n > 10**6 and spread > 100:  # as good as normal
        assert abs(drawn.mean() - middle) < 4 * spread / math.sqrt(20_000) and abs(drawn.var() / spread**2 - 1) < 0.05
        return
    low, high = max(0, int(middle - 8 * spread)), min(n, int(middle + 8 * spread + 10))
    wanted = np.array([math.exp(log(k)) for k in range(low, high + 1)]) * 20_000
    met = np.bincount(np.clip(drawn - low, 0, high - low), minlength=high - low + 1)
    groups, w, m = [], 0.0, 0
    for a, b in zip(wanted, met, strict=True):  # at least 20 expected in each
        w, m = w + a, m + b
        if w >= 20:
            groups.append((w, m))
            w, m = 0.0, 0
    square = sum((m - w) ** 2 / w for w, m in groups)
    assert square < len(groups) + 5 * math.sqrt(2 * len(groups)) + 5


def test_multinomial_adds_up():
    cells = [(3, 900), (0, 50), (7, 50), (5, 1)]
    drawn = counts.multinomial([f"m:{i}" for i in range(20_000)], 1001, cells)
    assert (drawn.sum(axis=1) == 1001).all() and drawn.min() >= 0
    share = np.array([w / 1001 for _, w in cells])
    assert (abs(drawn.mean(axis=0) - 1001 * share) < 5 * np.sqrt(1001 * share / 20_000)).all()
    # Cells of a multinomial: covariance -n p q.
    assert abs(np.cov(drawn[:, 0], drawn[:, 1])[0, 1] + 1001 * share[0] * share[1]) < 3


def test_sql_twin():
    cases = " UNION ALL ".join(f"SELECT {n}::BIGINT AS n, {h}::BIGINT AS h, {o}::BIGINT AS o" for n, h, o in CASES)
    rows = duckdb.sql("SELECT n, h, o, i, drawn FROM (" + counts.binomial_sql(f"SELECT n, h, o, i, n AS draws, h AS hits, o AS of_, 'law:' || n || ':' || h || ':' || o || ':' || i AS key_ FROM ({cases}), range(2000) r(i)") + ")").fetchall()
    known = {tuple(r[:4]): r[4] for r in rows}
    for case in CASES:
        drawn = counts.binomial(keys(*case, 2000), np.full(2000, case[0]), *case[1:])
        assert all(known[(*case, i)] == k for i, k in enumerate(drawn.tolist()))


def test_cost_is_free_of_clusters(monkeypatch):
    asked, own = [], counts.uniforms
    monkeypatch.setattr(counts, "uniforms", lambda keys, attempt: asked.append(len(keys)) or own(keys, attempt))
    cost = []
    for times in (1, 100, 10_000):
        asked.clear()
        counts.multinomial([str(i) for i in range(500)], 1000 * times, [(i, 8 * times) for i in range(125)])
        cost.append(sum(asked))
    assert cost[1] < 1.7 * cost[0] and cost[2] < 1.1 * cost[1]
