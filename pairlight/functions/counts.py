"""Binomial and multinomial counts from counters: the same in any engine, at a cost that doesn't depend on how many are drawn.

A draw is named by its key; MD5 of the key and the attempt gives two uniform numbers of 52 bits. Counts below ten are
expected: inversion, one number a draw. Else: transformed rejection (Hörmann 1993), some 1.3 attempts a draw. A
multinomial is a chain of conditional binomials over its cells, so it takes as many draws as there are cells.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Expected counts from which rejection is used; attempts until one counts as broken (some 1e-20 of the draws).
FEW, ATTEMPTS, STEPS = 10.0, 40, 200
#: What Stirling's formula lacks of ln k! for k below ten; the series does for the others.
SMALL = [math.lgamma(k + 1) - ((k + 0.5) * math.log(k + 1) - (k + 1) + 0.5 * math.log(2 * math.pi)) for k in range(10)]


def uniforms(keys: list[str], attempt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for each key."""
    end = f":{attempt}".encode()
    words = np.frombuffer(b"".join([hashlib.md5(k.encode() + end).digest() for k in keys]), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    # The first 13 hex digits, and the next 13.
    u, v = words[:, 0] >> np.uint64(12), (words[:, 0] & np.uint64(0xFFF)) << np.uint64(40) | words[:, 1] >> np.uint64(24)
    return (u.astype(np.float64) + 0.5) / 2.0**52, (v.astype(np.float64) + 0.5) / 2.0**52


def _missing(k: np.ndarray) -> np.ndarray:
    square = (k + 1.0) * (k + 1.0)
    series = (1.0 / 12.0 - (1.0 / 360.0 - 1.0 / 1260.0 / square) / square) / (k + 1.0)
    return np.where(k < 10, np.array(SMALL)[np.clip(k, 0, 9).astype(np.int64)], series)


def _inverted(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    ratio = p / (1.0 - p)
    mass = np.exp(n * (-2.0 * math.atanh(p / (2.0 - p))))  # (1 - p)^n
    left, k = u.copy(), np.zeros(len(n))
    for _ in range(STEPS):
        more = (left > mass) & (k < n)
        if not more.any():
            break
        left = np.where(more, left - mass, left)
        mass = np.where(more, mass * ((n - k) * ratio / (k + 1.0)), mass)
        k = k + more
    return k


def _rejected(u: np.ndarray, v: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Counts; NaN where the attempt fails."""
    q = 1.0 - p
    ratio, spread = p / q, np.sqrt(n * p * q)
    b = 1.15 + 2.53 * spread
    a = -0.0873 + 0.0248 * b + 0.01 * p
    mode = np.floor((n + 1.0) * p)
    side, near = u - 0.5, 0.5 - np.abs(u - 0.5)
    k = np.floor((2.0 * a / near + b) * side + (n * p + 0.5))
    inside = (k >= 0) & (k <= n)
    at = np.where(inside, k, mode)
    bound = (mode + 0.5) * np.log((mode + 1.0) / (ratio * (n - mode + 1.0))) + (n + 1.0) * np.log((n - mode + 1.0) / (n - at + 1.0)) + (at + 0.5) * np.log(ratio * (n - at + 1.0) / (at + 1.0)) + _missing(mode) + _missing(n - mode) - _missing(at) - _missing(n - at)
    high = np.log(v * ((2.83 + 5.1 / b) * spread) / (a / (near * near) + b))
    good = ((near >= 0.07) & (v <= 0.92 - 4.2 / b)) | (inside & (high <= bound))
    return np.where(good, k, np.nan)


def binomial(keys: list[str], n: np.ndarray, hits: int, of: int) -> np.ndarray:
    """For each key a count of successes in ``n`` draws (an array) with the chance ``hits / of``."""
    if not hits or hits == of or not len(n):
        return np.zeros(len(n), dtype=np.int64) if not hits else n.astype(np.int64)
    turned = 2 * hits > of
    p = (of - hits) / of if turned else hits / of
    m = n.astype(np.float64)
    u, v = uniforms(keys, 0)
    few = m * p < FEW
    k = np.empty(len(m))
    if few.any():
        k[few] = _inverted(u[few], m[few], p)
    open_ = np.flatnonzero(~few)
    for attempt in range(ATTEMPTS):
        if not len(open_):
            break
        if attempt:
            u, v = uniforms([keys[i] for i in open_], attempt)
        else:
            u, v = u[open_], v[open_]
        k[open_] = _rejected(u, v, m[open_], p)
        open_ = open_[np.isnan(k[open_])]
    if len(open_):
        raise ArithmeticError("no attempt of a draw held")
    return (m - k if turned else k).astype(np.int64)


def multinomial(keys: list[str], total: int, cells: list[tuple[int, int]]) -> np.ndarray:
    """For each key (rows) how often each cell (its code and weight) is met in ``total`` draws, by conditional binomials."""
    left, mass = np.full(len(keys), total, dtype=np.int64), sum(w for _, w in cells)
    out = np.zeros((len(keys), len(cells)), dtype=np.int64)
    for j, (code, weight) in enumerate(cells):
        out[:, j] = binomial([f"{k}:{code}" for k in keys], left, weight, mass)
        left = left - out[:, j]
        mass -= weight
    return out


# The same as DuckDB SQL, for twins.

#: Steps and attempts that the SQL writes out for all rows; what is open then takes lists.
PLAIN_STEPS, PLAIN_ATTEMPTS = 24, 4


def _missing_sql(k: str) -> str:
    square = f"(({k} + 1) * ({k} + 1))"
    small = "[" + ", ".join(f"{x!r}::DOUBLE" for x in SMALL) + "]"
    return f"(CASE WHEN {k} < 10 THEN {small}[CAST({k} AS INT) + 1] ELSE (1::DOUBLE / 12 - (1::DOUBLE / 360 - 1::DOUBLE / 1260 / {square}) / {square}) / ({k} + 1) END)"


def _half_sql(h: str, at: int) -> str:
    return f"((CAST('0x' || substr({h}, {at}, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)"


def _tried_sql(u: str, v: str) -> str:
    """An attempt's count, or null."""
    near = f"(0.5::DOUBLE - abs({u} - 0.5::DOUBLE))"
    k = f"floor((2 * a_ / {near} + b_) * ({u} - 0.5::DOUBLE) + (n_ * p_ + 0.5::DOUBLE))"
    bound = f"(m_ + 0.5::DOUBLE) * ln((m_ + 1) / (r_ * (n_ - m_ + 1))) + (n_ + 1) * ln((n_ - m_ + 1) / (n_ - {k} + 1)) + ({k} + 0.5::DOUBLE) * ln(r_ * (n_ - {k} + 1) / ({k} + 1)) + mm_ - {_missing_sql(k)} - {_missing_sql(f'(n_ - {k})')}"
    return f"CASE WHEN {near} >= 0.07::DOUBLE AND {v} <= 0.92::DOUBLE - 4.2::DOUBLE / b_ THEN {k} WHEN {k} < 0 OR {k} > n_ THEN NULL WHEN ln({v} * ((2.83::DOUBLE + 5.1::DOUBLE / b_) * s_) / (a_ / ({near} * {near}) + b_)) <= {bound} THEN {k} END"


def binomial_sql(source: str) -> str:
    """``source`` (a query with columns key_, draws, hits and of_) with a column ``drawn``."""
    q = f"SELECT *, CAST(draws AS DOUBLE) AS n_, CASE WHEN 2 * hits > of_ THEN (of_ - hits) / of_::DOUBLE ELSE hits / of_::DOUBLE END AS p_, md5(key_ || ':0') AS h_ FROM ({source})"
    q = f"SELECT *, p_ / (1 - p_) AS r_, sqrt(n_ * p_ * (1 - p_)) AS s_, n_ * p_ < {FEW!r} AS few_, {_half_sql('h_', 1)} AS u_, {_half_sql('h_', 14)} AS v_ FROM ({q})"
    q = f"SELECT *, 1.15::DOUBLE + 2.53::DOUBLE * s_ AS b_, floor((n_ + 1) * p_) AS m_, u_ AS left_, exp(n_ * (-2 * atanh(p_ / (2 - p_)))) AS f_, 0::DOUBLE AS c_ FROM ({q})"
    q = f"SELECT *, -0.0873::DOUBLE + 0.0248::DOUBLE * b_ + 0.01::DOUBLE * p_ AS a_, {_missing_sql('m_')} + {_missing_sql('(n_ - m_)')} AS mm_, NULL::DOUBLE AS k_ FROM ({q})"
    for _ in range(PLAIN_STEPS):
        q = f"SELECT * EXCLUDE (go_) REPLACE (CASE WHEN go_ THEN left_ - f_ ELSE left_ END AS left_, CASE WHEN go_ THEN f_ * ((n_ - c_) * r_ / (c_ + 1)) ELSE f_ END AS f_, CASE WHEN go_ THEN c_ + 1 ELSE c_ END AS c_) FROM (SELECT *, few_ AND left_ > f_ AND c_ < n_ AS go_ FROM ({q}))"
    for i in range(PLAIN_ATTEMPTS):
        if i:
            open_ = f"NOT few_ AND k_ IS NULL THEN md5(key_ || ':{i}')"
            q = f"SELECT * REPLACE ({_half_sql('h_', 1)} AS u_, {_half_sql('h_', 14)} AS v_) FROM (SELECT * REPLACE (CASE WHEN {open_} END AS h_) FROM ({q}))"
        q = f"SELECT * REPLACE (CASE WHEN few_ THEN NULL WHEN k_ IS NOT NULL THEN k_ ELSE {_tried_sql('u_', 'v_')} END AS k_) FROM ({q})"
    digest = "md5(key_ || ':' || j_)"
    later = f"list_filter(list_transform(range({PLAIN_ATTEMPTS}, {ATTEMPTS}), lambda j_: {_tried_sql(_half_sql(digest, 1), _half_sql(digest, 14))}), lambda x_: x_ IS NOT NULL)[1]"
    step = "CASE WHEN s.u > s.f AND s.k < n_ THEN {'u': s.u - s.f, 'f': s.f * ((n_ - s.k) * r_ / (s.k + 1)), 'k': s.k + 1} ELSE s END"
    state = "{'u': left_, 'f': f_, 'k': c_}"
    more = f"list_reduce(list_resize([{state}], {STEPS - PLAIN_STEPS + 1}, {state}), lambda s, x: {step}).k"
    count = f"CAST(CASE WHEN few_ THEN CASE WHEN left_ > f_ AND c_ < n_ THEN {more} ELSE c_ END WHEN k_ IS NOT NULL THEN k_ ELSE {later} END AS BIGINT)"
    return f"SELECT *, CASE WHEN hits = 0 OR draws = 0 THEN 0 WHEN hits = of_ THEN draws WHEN 2 * hits > of_ THEN draws - {count} ELSE {count} END AS drawn FROM ({q})"


def multinomial_sql(cells: str, replicates: int, seed: int) -> str:
    """CTE bodies ``walk`` after ``cells`` (a CTE: family, j from 1, code, hits, of_): replicate, family, code, times, for WITH RECURSIVE."""
    joined = f"SELECT w.family, w.replicate, c.j, c.code, w.rest AS draws, c.hits, c.of_, '{seed}:' || w.replicate || ':' || w.family || ':' || c.code AS key_ FROM walk w JOIN {cells} c ON c.family = w.family AND c.j = w.j + 1"
    return f"""walk(family, replicate, j, code, rest, times) AS (
  SELECT family, replicate, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(of_ AS BIGINT), CAST(0 AS BIGINT) FROM {cells}, range({replicates}) r(replicate) WHERE j = 1
  UNION ALL SELECT family, replicate, j, code, draws - drawn, drawn FROM ({binomial_sql(joined)}))"""
