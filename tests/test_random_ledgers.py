"""Ambiguous ledgers: many equal amounts, duplicate references, close dates,
shared buckets, nulls.  The full four-pass Spark run must equal the
independent DuckDB SQL formulation row for row (ids, passes, qualities).

Each seed gets its own accounts, so the seeds are independent cases inside
one run (BANK_ACCOUNT is always a hard key)."""

import random
from datetime import date, timedelta
from decimal import Decimal

import duckdb
import pandas as pd

from helpers import LEDGER_SCHEMA
from matchbook.plans import oracle
from matchbook.plans.configs import standard_spec
from matchbook.plans.run import run_passes

SEEDS = range(40)


def random_rows():
    """Per seed: a few matchable structures (pairs, duplicate pairs, 1:N, N:1,
    2+2 splits, orphans) from a small amount palette, mixed in 1-2 accounts so
    they collide, plus closed rows and nulls."""
    rows = []
    rid = [1]

    def add(rng, gl, amt, d, acct, ccy, ref=None):
        rows.append((rid[0], "GL" if gl else "STMT", "CR" if gl else "DR",
                     "CLOSED" if rng.random() < 0.04 else "OPEN",
                     None if amt is None or rng.random() < 0.02 else
                     Decimal(str(round(amt, 4))).quantize(Decimal("0.0001")),
                     ccy, d, acct, ref if rng.random() > 0.1 else None))
        rid[0] += rng.randint(1, 3)

    for seed in SEEDS:
        rng = random.Random(seed)
        accounts = [f"S{seed}-A{i}" for i in range(rng.randint(1, 2))]
        for _ in range(rng.randint(2, 6)):
            acct, ccy = rng.choice(accounts), rng.choice(["USD", "USD", "EUR"])
            d0 = date(2024, 1, 10) + timedelta(days=rng.randint(0, 3))
            dd = lambda: d0 + timedelta(days=rng.randint(0, 2))
            a, b = rng.choice([10, 20, 30, 50]), rng.choice([10, 20, 40, 60])
            ref = rng.choice(["R1", "R2", "R3"])
            kind = rng.choice(["pair", "dup", "o2m", "m2o", "m2m", "orphan"])
            if kind == "pair":
                add(rng, True, a, d0, acct, ccy, ref); add(rng, False, a, dd(), acct, ccy, ref)
            elif kind == "dup":
                add(rng, True, a, d0, acct, ccy, ref); add(rng, True, a, dd(), acct, ccy, ref)
                add(rng, False, a, dd(), acct, ccy, ref)
            elif kind == "o2m":
                add(rng, True, a + b, d0, acct, ccy)
                add(rng, False, a, dd(), acct, ccy); add(rng, False, b, dd(), acct, ccy)
            elif kind == "m2o":
                add(rng, True, a, d0, acct, ccy); add(rng, True, b, dd(), acct, ccy)
                add(rng, False, a + b, dd(), acct, ccy)
            elif kind == "m2m":
                c = rng.choice([5, 15, 25])
                add(rng, True, a, d0, acct, ccy); add(rng, True, b, dd(), acct, ccy)
                add(rng, False, c, dd(), acct, ccy)
                add(rng, False, a + b - c + rng.choice([0, 0.005, -0.0025]), dd(), acct, ccy)
            else:
                add(rng, rng.random() < 0.5, rng.choice([a, b, 7.5]), d0, acct, ccy, ref)
    return rows


import pytest  # noqa: E402

from matchbook.plans.configs import m2m_pass  # noqa: E402
from matchbook.spec import Attribute  # noqa: E402

PERCENT_SPEC = standard_spec(passes=standard_spec().passes[:3] + (m2m_pass(attributes=(
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_percent=0.002),
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=3))),))


@pytest.mark.parametrize("spec", [standard_spec(), PERCENT_SPEC], ids=["standard", "m2m-percent"])
def test_random_ledgers_match_sql(spark, spec):
    rows = random_rows()
    led = spark.createDataFrame(rows, LEDGER_SCHEMA)
    run = run_passes(led, spec)
    got = sorted(tuple(r) for r in run.matches.select(
        "row_id", "MATCHING_ID", "MATCHED_BY_PASS", "MATCH_QUALITY").collect())

    con = duckdb.connect()
    pdf = pd.DataFrame(rows, columns=[f.name for f in LEDGER_SCHEMA.fields])
    con.register("ledger_pdf", pdf)
    con.execute("CREATE TABLE ledger AS SELECT row_id::BIGINT AS row_id, LS_TYPE, DR_CR_IND, STATUS, "
                "CAST(AMOUNT AS DECIMAL(18,4)) AS AMOUNT, CURRENCY, CAST(VALUE_DATE AS DATE) AS VALUE_DATE, "
                "BANK_ACCOUNT, REFERENCE FROM ledger_pdf")
    ctes, m = oracle.run_ctes(spec, with_base=False)
    want = sorted(tuple(r) for r in con.execute(
        oracle.with_ctes(ctes, f"SELECT row_id, MATCHING_ID, MATCHED_BY_PASS, MATCH_QUALITY FROM {m}"))
        .fetchall())
    passes = {r[2] for r in got}
    assert len(got) > 50 and {"MP_O2O", "MP_O2M", "MP_M2O", "MP_M2M"} <= passes, passes
    assert got == want
