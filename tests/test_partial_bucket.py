"""1:N against parts of a bucket: brute force on small buckets, 30 and more rows."""

import random
from itertools import combinations

import pytest

from helpers import ledger_df, row
from matchbook.operators import partial_bucket
from matchbook.operators.populations import pass_populations
from matchbook.plans.configs import m2o_pass, o2m_pass
from matchbook.spec import Aggregation, Attribute, MatchPass, SpecError


def rule(side="RIGHT", days=None, **tol):
    amount = Attribute("AMOUNT", "AMOUNT", "WITHIN" if tol else "EQUALS", mandatory=True,
                       aggregation=Aggregation(side, "SUM"), **tol)
    dates = (Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=days),) if days else ()
    make = o2m_pass if side == "RIGHT" else m2o_pass
    return make(quality=0, partial_bucket=True, attributes=(amount, *dates))


def groups(spark, rows, p):
    left, right = pass_populations(ledger_df(spark, rows), p)
    got = partial_bucket.groups(left, right, p).collect()
    return sorted((r["one_id"], r["q"], tuple(sorted(r["ids"]))) for r in got)


def brute(rows, days, tol_abs, tol_pct):
    made = []
    for one in (r for r in rows if r[1] == "GL" and r[4] is not None):
        v, best = float(one[4]), None
        many = [r for r in rows if r[1] == "STMT" and r[7] == one[7] and r[4] is not None
                and (days is None or abs((r[6] - one[6]).days) <= days)]
        for k in range(2, len(many) + 1):
            for part in combinations(many, k):
                delta = abs(v - float(sum(r[4] for r in part)))
                tol = max(tol_abs, abs(v) * tol_pct)
                if delta > tol + 1e-9 or (tol == 0 and delta):
                    continue
                q = int(max(80.0, min(100.0, 100 - delta / max(tol, 1e-12) * 20)) + 0.5) if tol else 100
                ids = sorted((r[0] for r in part), reverse=True)
                best = max(best or (0, 0, []), (q, -k, ids))
        if best:
            made.append((best[0], best[1], -one[0], best[2]))
    taken, out = {}, []
    for m in sorted(made, reverse=True):
        for i in m[3]:
            taken.setdefault(i, m)
    for m in made:
        if all(taken[i] is m for i in m[3]):
            out.append((-m[2], m[0], tuple(sorted(m[3]))))
    return sorted(out)


@pytest.mark.parametrize("listed", [30, 3])
def test_small_buckets_against_brute_force(spark, monkeypatch, listed):
    """By halves, and by growing sums."""
    monkeypatch.setattr(partial_bucket, "LISTED", listed)
    rng, rows, rid = random.Random(9), [], 1
    for b in range(40):
        for s, n in (("L", rng.randint(1, 3)), ("R", rng.randint(0, 7))):
            for _ in range(n):
                amount = rng.choice([None, -10, 5, 10, 10.25, 20, 31, 40.5]) if s == "R" or rng.random() < 0.3 \
                    else rng.choice([15, 20.25, 30, 61, 25, 45])
                rows.append(row(rid, s, amount, d=f"2024-02-{rng.randint(1, 5):02d}", acct=f"B{b}"))
                rid += 1
    for days, tol in ((None, {}), (2, {}), (2, dict(tolerance_amount=0.5, tolerance_percent=0.02))):
        got = groups(spark, rows, rule(days=days, **tol))
        assert got == brute(rows, days, tol.get("tolerance_amount", 0.0), tol.get("tolerance_percent", 0.0))
        assert len(got) > 5


def test_thirty_rows_by_halves(spark):
    """One of the 2**30 subsets has the total: distinct powers of two."""
    rows = [row(i, "R", 2 ** i / 16) for i in range(30)]
    part = [1, 4, 5, 9, 12, 16, 20, 21, 28]
    rows += [row(100, "L", sum(2 ** i for i in part) / 16), row(101, "L", 2 ** 31 / 16)]
    assert groups(spark, rows, rule()) == [(100, 100, tuple(part))]


def test_many_rows_by_growing_sums(spark):
    rows = [row(i, "R", 16 * (1000 + i * i % 997)) for i in range(1, 200)]
    rows += [row(300, "R", 7.5), row(301, "R", 1005.25), row(302, "R", 9011.25), row(400, "L", 10024)]
    assert groups(spark, rows, rule()) == [(400, 100, (300, 301, 302))]


def test_mirror_and_empty(spark):
    rows = [row(1, "L", 100), row(2, "L", 200), row(3, "L", 7), row(4, "R", 300)]
    assert groups(spark, rows, rule("LEFT")) == [(4, 100, (1, 2))]
    assert groups(spark, rows[:1], rule()) == []
    with pytest.raises(SpecError):
        MatchPass(id="X", match_type="ONE_TO_ONE", partial_bucket=True,
                  attributes=(Attribute("CURRENCY", "CURRENCY", "EQUALS"),))
