"""What a run shuffles: narrow rows; the ledger itself only once."""

from decimal import Decimal

from pyspark.sql import functions as F

from helpers import ledger_df, long_rows, row
from matchbook.operators import one_to_one
from matchbook.operators.numbering import matching_id
from matchbook.operators.populations import pass_populations
from matchbook.plans.carry import run_cycle
from matchbook.plans.catalog import CONTAINS_PASS
from matchbook.plans.configs import m2m_pass, m2o_pass, o2m_pass, o2o_pass
from matchbook.plans.run import reconcile, run_passes
from matchbook.spec import RunSpec

SPEC = RunSpec("T", (o2o_pass(), o2m_pass(), m2o_pass(), m2m_pass()), "2024-01-15")
ROWS = [row(1, "L", 100, ref="A"), row(2, "R", 100, ref="A"), row(3, "L", 70, ref="B", acct="ACC-2"),
        row(4, "R", 30, ref="C", acct="ACC-2"), row(5, "R", 40, ref="D", acct="ACC-2"), row(6, "L", 9, ref="E")]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_open_rows_and_result_do_not_shuffle_the_ledger(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = run_passes(ledger_df(spark, ROWS), SPEC)
        rest = run.ledger.join(run.matches.select("row_id"), "row_id", "left_anti")
        assert exchanges(rest) == 1 and exchanges(run.result) == 1      # the matches' side only
        assert sorted(r.row_id for r in rest.collect()) == [6]
        assert long_rows(run.matches) == [
            (1, "MGID_T_20240115_000001", "MP_O2O", 100), (2, "MGID_T_20240115_000001", "MP_O2O", 100),
            (3, "MGID_T_20240115_000002", "MP_O2M", 100), (4, "MGID_T_20240115_000002", "MP_O2M", 100),
            (5, "MGID_T_20240115_000002", "MP_O2M", 100)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_columns_named_like_the_run_s_own(spark):
    led = ledger_df(spark, ROWS)
    for name in ("q", "_pass", "_seq", "MATCH_DATE"):
        led = led.withColumn(name, F.lit("mine"))
    run = run_passes(led, SPEC)
    got = {r.row_id: r for r in run.result.collect()}
    assert {(r.q, r["_pass"], r["_seq"]) for r in got.values()} == {("mine",) * 3}
    assert got[6].STATUS == "UNMATCHED" and got[6].MATCH_DATE is None and got[6].MATCHED_BY_PASS is None
    assert run.result.columns == reconcile(run.ledger, run.matches).columns
    assert sorted(run.result.collect()) == sorted(reconcile(run.ledger, run.matches).collect())


def test_values_of_a_key_travel_once(spark):
    p = o2o_pass()
    left, right = pass_populations(ledger_df(spark, ROWS), p)
    assert one_to_one.project_side(left, p, "l").columns == ["l_id", "l_k0", "l_k1", "l_k2", "l_k3", "l_a2"]
    assert [tuple(r) for r in one_to_one.best_pairs(left, right, p).collect()] == [(1, 2, 100)]


def test_ids_of_more_than_six_digits(spark):
    ids = spark.createDataFrame([(1,), (999999,), (1000000,), (12345678,)], "n long").select(
        matching_id(F.col("n"), "T", SPEC.effective_cycle_date()).alias("id"))
    assert [r.id for r in ids.collect()] == [
        "MGID_T_20240115_" + s for s in ("000001", "999999", "1000000", "12345678")]


def test_carried_rows_come_from_the_run_s_ledger(spark, tmp_path):
    cycle = run_cycle(ledger_df(spark, ROWS), SPEC, str(tmp_path / "state"), "2024-01-15")
    assert [(r.row_id, r.AMOUNT) for r in cycle.open_items.collect()] == [(6, Decimal("9.0000"))]


def test_left_rows_of_a_contains_pass_are_not_binned_thrice(spark):
    left, right = pass_populations(ledger_df(spark, [
        row(1, "L", 5, "2024-01-15", ref="AB-INVOICE-77"), row(2, "L", 5, "2024-01-31", ref="AB-INVOICE-77"),
        row(3, "R", 5, "2024-01-17", ref="INVOICE-77"), row(4, "R", 5, None, ref="INVOICE-77")]), CONTAINS_PASS)
    pairs = one_to_one.candidates(left, right, CONTAINS_PASS)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    reach = [line for line in plan.splitlines() if "explode(sequence(" in line]
    assert reach and all("r_a" in line and "l_a" not in line for line in reach)
    assert [(r.l_id, r.r_id) for r in pairs.collect()] == [(1, 3)]
