"""Optimal 1:1 pairs against brute force, and the proof by prices."""

import random
from itertools import permutations

import pytest

from helpers import ledger_df, row
from matchbook.operators import assignment, one_to_one
from matchbook.operators.populations import pass_populations
from matchbook.plans.configs import o2o_pass
from matchbook.spec import Attribute, SpecError


def cells(seed, n_cells, rows=5):
    rng, pairs = random.Random(seed), []
    for c in range(n_cells):
        lefts = [100 * c + i for i in range(rng.randint(1, rows))]
        rights = [100 * c + 50 + j for j in range(rng.randint(1, rows))]
        pairs += [(i, j, rng.choice([0, 60, 80, 90, 91, 100])) for i in lefts for j in rights if rng.random() < 0.6]
    return pairs


def best_total(pairs):
    """(total, number) of the best choice, by trying all."""
    lefts, rights = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    q = {(i, j): q for i, j, q in pairs}
    best = (0, 0)
    for order in permutations(rights + [None] * len(lefts), len(lefts)):
        used = [q[i, j] for i, j in zip(lefts, order) if (i, j) in q]
        best = max(best, (sum(used), len(used)))
    return best


def check(pairs, got):
    assert len({p[0] for p in got}) == len(got) == len({p[1] for p in got}) and set(got) <= set(pairs)
    for c in sorted({p[0] // 100 for p in pairs}):
        here = [p for p in got if p[0] // 100 == c]
        assert (sum(p[2] for p in here), len(here)) == best_total([p for p in pairs if p[0] // 100 == c]), c


def test_total_equals_brute_force(spark):
    pairs = cells(1, 60, 4)
    got = assignment.optimal_pairs(spark.createDataFrame(pairs, "l_id long, r_id long, q long"))
    check(pairs, [tuple(r) for r in got.collect()])


def test_large_components_by_rounds(spark):
    pairs = [(0, 50, 90), (0, 51, 80), (1, 50, 95), (2, 51, 90), (2, 52, 60)]
    got = assignment.optimal_pairs(spark.createDataFrame(pairs, "l_id long, r_id long, q long"), in_task=1)
    check(pairs, [tuple(r) for r in got.collect()])


@pytest.mark.parametrize("seed", range(40))
def test_prices_prove_the_optimum(seed):
    pairs = cells(seed, 1, 6)
    if not pairs:
        return
    wish, n = assignment.balanced(pairs)
    taken, price = assignment.auction(wish)
    assert len(taken) == n == len(set(taken.values()))
    total = sum(wish[p][o] for p, o in taken.items())
    bound = sum(max(b - price[o] for o, b in options.items()) for options in wish.values()) + sum(price.values())
    assert 0 <= bound - total <= n                         # less than one unit of n + 1
    best, count = best_total(pairs)
    assert total == (best * (n + 1) + count) * (n + 1)


def test_optimal_pass_beats_the_greedy_one(spark):
    rows = [row(1, "L", 100), row(2, "L", 104), row(3, "R", 101), row(4, "R", 96)]
    make = lambda kind: o2o_pass(quality=0, assignment=kind, attributes=(
        Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=5),))
    pairs = {}
    for kind in ("greedy", "optimal"):
        left, right = pass_populations(ledger_df(spark, rows), make(kind))
        pairs[kind] = sorted((r.l_id, r.r_id) for r in one_to_one.best_pairs(left, right, make(kind)).collect())
    assert pairs == {"greedy": [(1, 3)], "optimal": [(1, 4), (2, 3)]}
    with pytest.raises(SpecError):
        one_to_one.best_pairs(left, left, o2o_pass(assignment="optimal", left=(), right=()))
    with pytest.raises(SpecError):
        o2o_pass(assignment="best")
