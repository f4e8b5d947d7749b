"""Carried items, suspected pairs, totals other than sums, indexed pages."""

from datetime import date
from decimal import Decimal

import pytest

from helpers import ledger_df, row
from matchbook.operators.matching import match_many_to_one, match_one_to_many
from matchbook.operators.populations import pass_populations
from matchbook.plans import browse
from matchbook.plans.carry import open_items, run_cycle, versions
from matchbook.plans.configs import m2m_pass, m2o_pass, o2m_pass, o2o_pass
from matchbook.plans.run import run_passes
from matchbook.plans.suspects import suspected_pairs, with_suspects
from matchbook.sources.sinks import write_paged
from matchbook.spec import Aggregation, Attribute, RunSpec, SpecError

SPEC = RunSpec("T", (o2o_pass(), o2m_pass(), m2o_pass(), m2m_pass()), "2024-01-15")


def test_items_are_carried_until_they_match(spark, tmp_path):
    state = str(tmp_path / "state")
    first = [row(1, "L", 100, ref="A"), row(2, "R", 100, ref="A"), row(3, "L", 70, ref="B", d="2024-01-15"),
             row(4, "L", 9, ref="C")]
    second = [row(5, "R", 70, ref="B", d="2024-01-16"), row(6, "R", 33, ref="D")]
    third = [row(7, "L", 33, ref="D", d="2024-01-16")]
    for day, rows in (("2024-01-15", first), ("2024-01-16", second), ("2024-01-17", third)):
        cycle = run_cycle(ledger_df(spark, rows), SPEC, state, day)
    assert versions(spark, state) == [date(2024, 1, d) for d in (15, 16, 17)]
    seen = lambda d: sorted((r.row_id, r.FIRST_SEEN.day, r.AGE_CYCLES)
                            for r in open_items(spark, state, date(2024, 1, d)).collect())
    assert seen(15) == [(3, 15, 0), (4, 15, 0)] and seen(16) == [(4, 15, 1), (6, 16, 0)] and seen(17) == [(4, 15, 2)]
    assert {(r.row_id, r.STATUS, str(r.MATCH_DATE)) for r in cycle.result.collect()} == {
        (6, "MATCHED", "2024-01-17"), (7, "MATCHED", "2024-01-17"), (4, "UNMATCHED", "None")}
    again = run_cycle(ledger_df(spark, second), SPEC, state, "2024-01-16")     # replaces its own version
    assert again.carried_from == date(2024, 1, 15) and seen(16) == [(4, 15, 1), (6, 16, 0)]
    with pytest.raises(SpecError):
        run_cycle(ledger_df(spark, [row(4, "L", 9)]), SPEC, state, "2024-01-18")


def test_chained_cycles_equal_one_run(spark, tmp_path):
    """Where no tolerance spans the cycles, chaining finds the groups of one run over both."""
    rows = [[row(base + i, "LR"[i % 2], 10 * (i // 2 % 4) + 5, d=f"2024-0{month}-{1 + i // 6:02d}", ref=f"R{i // 2 % 3}")
             for i in range(60)] for base, month in ((0, 1), (100, 3))]
    for day, part in (("2024-01-31", rows[0]), ("2024-03-31", rows[1])):
        cycle = run_cycle(ledger_df(spark, part), SPEC, str(tmp_path / "s"), day)
    one = run_passes(ledger_df(spark, rows[0] + rows[1]), SPEC)
    still = lambda df: {r.row_id for r in df.where("STATUS = 'UNMATCHED'").collect()}
    assert {r.row_id for r in cycle.open_items.collect()} == still(one.result)


def test_suspects_are_exclusive_and_consume_nothing(spark):
    soft = o2o_pass(id="SOFT", quality=95, rule_order=1, attributes=(
        Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
        Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=10),
        Attribute("SUBSTRING(REFERENCE, 1, 2)", "SUBSTRING(REFERENCE, 1, 2)", "EQUALS")))
    rows = [row(1, "L", 100, ref="AA"), row(2, "R", 100, ref="AA"), row(3, "L", 50, ref="BB"), row(4, "R", 57, ref="BB"),
            row(5, "R", 51, ref="XX"), row(6, "L", 54, ref="YY"), row(7, "L", 999, ref="ZZ")]
    run = run_passes(ledger_df(spark, rows), RunSpec("T", (soft,), "2024-01-15"))
    got = suspected_pairs(run, 60)
    # 6 agrees with 4 and 5 alike, so it asks for 4, which goes better with 3.
    assert [tuple(r) for r in got.collect()] == [(1, 3, 4, 94, "SOFT")]
    used = [x for p in got.collect() for x in (p.l_id, p.r_id)]
    shown = {r.row_id: (r.STATUS, r.REVIEW) for r in with_suspects(run.result, got).collect()}
    assert shown[1] == ("MATCHED", False) and shown[7] == ("UNMATCHED", False)
    assert all(shown[i] == ("UNMATCHED", True) for i in used)
    with pytest.raises(SpecError):
        suspected_pairs(run_passes(ledger_df(spark, rows), RunSpec("T", (o2m_pass(),), "2024-01-15")), 50)


@pytest.mark.parametrize("function, amount, wrong", [
    ("COUNT", 3, 2), ("MIN", 1, 1.01), ("MAX", 2.5, 2.4), ("AVG", Decimal("1.5"), Decimal("1.5001")), ("SUM", 4.5, 4.4)])
def test_totals_of_every_kind(spark, function, amount, wrong):
    for side, make, match in (("RIGHT", o2m_pass, match_one_to_many), ("LEFT", m2o_pass, match_many_to_one)):
        one, many = ("L", "R") if side == "RIGHT" else ("R", "L")
        rows = [row(1, one, amount, acct="A"), row(2, one, wrong, acct="B")]
        rows += [row(10 * k + i, many, v, acct=a) for k, a in ((1, "A"), (2, "B"))
                 for i, v in enumerate((1, 1, 2.5))]
        p = make(quality=0, attributes=(Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True,
                                                  aggregation=Aggregation(side, function)),))
        left, right = pass_populations(ledger_df(spark, rows), p)
        assert sorted(r.row_id for r in match(left, right, p).collect()) == [1, 10, 11, 12]


def test_average_is_compared_without_a_division(spark):
    rows = [row(1, "L", "33.3333"), row(2, "R", 33), row(3, "R", 33), row(4, "R", 34)]
    p = o2m_pass(quality=0, attributes=(Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True,
                                                  aggregation=Aggregation("RIGHT", "AVG")),))
    left, right = pass_populations(ledger_df(spark, rows), p)
    assert match_one_to_many(left, right, p).count() == 0


def test_pages_read_their_own_files(spark, tmp_path):
    result = spark.range(0, 20000).selectExpr(
        "id * 7 AS row_id", "IF(id % 5 = 0, 'UNMATCHED', 'MATCHED') AS STATUS", "IF(id < 9000, 'P1', 'P2') AS MATCHED_BY_PASS",
        "IF(id % 3 = 0, 'EUR', 'USD') AS CURRENCY", "concat('A', id % 11) AS BANK_ACCOUNT")
    path = str(tmp_path / "paged")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        write_paged(result, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for filters in (None, {"currency": "EUR"}, {"matched_by_pass": "P2", "currency": "USD"}, {"bank_account": "A3"},
                    {"currency": "none"}):
        for offset in (0, 13, 999, 5000, 99999):
            total, rows = browse.indexed_page(spark, path, "MATCHED", filters, 20, offset)
            want_total, want = browse.page(result, "MATCHED", filters, 20, offset)
            assert total == want_total
            assert [r.row_id for r in rows.collect()] == [r.row_id for r in want.collect()]
    _, rows = browse.indexed_page(spark, path, "MATCHED", {"currency": "EUR"}, 20, 3000)
    assert len(rows.inputFiles()) == 1 and len(spark.read.parquet(f"{path}/rows").inputFiles()) > 8
