"""Subsets of a cell: all ways of the search against brute force, cells of many sums."""

import random
from itertools import combinations

import numpy as np
import pytest

from matchbook.operators import cell_search, partial_bucket
from test_partial_bucket import brute, groups, row, rule


def quality(v, width):
    def q(x, total):
        delta = np.abs(v[x] - total).astype(float)
        if not width:
            return np.full(len(x), 100), delta == 0
        return np.floor(np.clip(100 - delta / width * 20, 80, 100) + 0.5).astype(np.int64), delta <= width
    return q


@pytest.mark.parametrize("room,listed,alone", [(10 ** 6, 30, False), (12, 30, False), (12, 0, True), (30, 0, False)])
def test_small_cells_against_brute_force(room, listed, alone):
    rng = np.random.default_rng(5)
    found = 0
    for case in range(150):
        n, width = int(rng.integers(2, 11)), 6 * (case % 2)
        amounts = [-7, 3, 5, 5, 8, 13, 21, 40] if case % 3 == 0 else [3, 5, 5, 8, 13, 21, 40, 55, 77]
        u, v = rng.choice(amounts, n).astype(np.int64), np.unique(rng.integers(1, 200, 4))
        q, want = quality(v, width), {}
        for t in range(len(v)):
            for k in range(2, n + 1):
                for part in combinations(range(n), k):
                    score, ok = q(np.array([t]), np.array([u[list(part)].sum()]))
                    if ok[0]:
                        want[t] = max(want.get(t, (0,)), (int(score[0]), -k, part[::-1]))
        best, back = cell_search.search(np.arange(n), u, v, np.full(len(v), width), q, listed, room, alone)
        assert {t: b[:3] for t, b in best.items()} == {t: w for t, w in want.items() if t not in back}
        assert not (back and alone)
        found += len(best)
    assert found > 50


def test_many_equal_rows_of_a_small_total():
    """72 rows of 12 amounts, of which a total takes up to 50: no list of all sums is grown."""
    u = np.repeat(380800 + 70001 * np.arange(12) ** 2, 6)
    v = np.array([int(u[:6].sum() + 2 * u[6] + 3 * u[20] + u[40]), 19778756])
    for t in range(2):
        best, back = cell_search.search(np.arange(72), u, v[t:t + 1], np.zeros(1, np.int64),
                                        quality(v[t:t + 1], 0), 30, 1 << 16, True)
        assert not back
        if t == 0:
            taken = best[0][2]
            assert sum(u[list(taken)]) == v[0] and len(taken) <= 12


@pytest.mark.parametrize("name,value", [("IN_TASK", 3), ("ROOM", 2)])
def test_other_ways_of_the_matcher(spark, monkeypatch, name, value):
    """By growing sums, and targets handed back by a task."""
    monkeypatch.setattr(partial_bucket, name, value)
    monkeypatch.setattr(partial_bucket, "LISTED", 2)
    rng, rows = random.Random(4), []
    for b in range(20):
        for s, n in (("L", rng.randint(1, 3)), ("R", rng.randint(3, 8))):
            rows += [row(len(rows) + i, s, rng.choice([5, 10, 10.25, 20, 31, 40.5, 61]), acct=f"B{b}")
                     for i in range(n)]
    for tol in ({}, dict(tolerance_amount=0.5)):
        got = groups(spark, rows, rule(**tol))
        assert got == brute(rows, None, tol.get("tolerance_amount", 0.0), 0.0)
        assert got
