"""End-to-end on the 18-row golden ledger with the standard four passes."""

import csv
import os

import pytest

from matchbook.plans.configs import standard_spec
from matchbook.plans.run import reconcile, run_passes
from matchbook.plans import summary
from matchbook.sources.ledger import load_ledger

HERE = os.path.dirname(os.path.abspath(__file__))
MG = "MGID_USD_NOSTRO_CITIBANK_20240115_"

# Expected (MATCHING_ID suffix, pass, quality) per input line; None = unmatched.
EXPECTED = [
    ("000001", "MP_O2O", 100), ("000001", "MP_O2O", 100),
    ("000003", "MP_O2O", 94), ("000003", "MP_O2O", 94),
    ("000002", "MP_O2O", 100), ("000002", "MP_O2O", 100),
    ("000004", "MP_O2M", 100), ("000004", "MP_O2M", 100), ("000004", "MP_O2M", 100),
    ("000005", "MP_M2O", 100), ("000005", "MP_M2O", 100), ("000005", "MP_M2O", 100),
    ("000006", "MP_M2M", 100), ("000006", "MP_M2M", 100), ("000006", "MP_M2M", 100),
    ("000006", "MP_M2M", 100), None, None,
]


def _golden(spark):
    led = load_ledger(spark, os.path.join(HERE, "fixtures", "golden_input.csv"))
    run = run_passes(led, standard_spec())
    return led, run, reconcile(led, run.matches)


def test_golden_output(spark):
    led, run, res = _golden(spark)
    rows = res.orderBy("row_id").collect()
    assert len(rows) == 18
    with open(os.path.join(HERE, "fixtures", "golden_input.csv")) as f:
        inputs = list(csv.DictReader(f))
    for r, inp, exp in zip(rows, inputs, EXPECTED):
        assert r["REFERENCE"] == inp["REFERENCE"]
        assert str(r["AMOUNT"]) == inp["AMOUNT"]
        if exp is None:
            assert r["STATUS"] == "UNMATCHED" and r["MATCHING_ID"] is None
            assert r["MATCH_DATE"] is None and r["MATCH_QUALITY"] is None
        else:
            assert r["STATUS"] == "MATCHED"
            assert (r["MATCHING_ID"], r["MATCHED_BY_PASS"], r["MATCH_QUALITY"]) == \
                (MG + exp[0], exp[1], exp[2])
            assert r["MATCH_DATE"].isoformat() == "2024-01-15"
    assert res.columns == ["row_id", "LS_TYPE", "DR_CR_IND", "STATUS", "AMOUNT", "CURRENCY",
                           "VALUE_DATE", "BANK_ACCOUNT", "REFERENCE", "MATCH_DATE",
                           "MATCHING_ID", "MATCHED_BY_PASS", "MATCH_QUALITY"]


def test_golden_totals_and_breakdown(spark):
    led, run, res = _golden(spark)
    t = summary.run_totals(res).first()
    assert (t.input_rows, t.matched_rows, t.unmatched_rows, t.match_groups) == (18, 16, 2, 6)
    pb = {r.pass_id: r for r in summary.pass_breakdown(res, standard_spec()).collect()}
    assert (pb["MP_O2O"].matched_groups, pb["MP_O2O"].matched_rows) == (3, 6)
    assert pb["MP_O2O"].avg_quality == 98.0
    assert (pb["MP_M2M"].matched_groups, pb["MP_M2M"].matched_rows) == (1, 4)
    by_side = {r.LS_TYPE: r.unmatched_rows for r in summary.unmatched_by(res, "LS_TYPE").collect()}
    assert by_side == {"GL": 1, "STMT": 1}


def test_golden_pages(spark):
    from matchbook.plans import browse
    _, _, res = _golden(spark)
    total, rows = browse.matches_page(res, {"matched_by_pass": "MP_O2O"})
    assert total == 6 and rows.count() == 6
    total, rows = browse.matches_page(res, {"currency": "EUR"})
    assert total == 2
    total, rows = browse.matches_page(res, {}, limit=5, offset=0)
    assert total == 16 and rows.count() == 5
    total, rows = browse.matches_page(res, {}, limit=5, offset=14)
    assert rows.count() == 2
    total, rows = browse.breaks_page(res, {"nonsense": "x"})
    assert sorted(r.REFERENCE for r in rows.collect()) == ["ORPHAN1", "ORPHAN2"]
    total, rows = browse.page(res, "MATCHED", limit=5, after=3)
    assert total == 16 and [r.row_id for r in rows.collect()] == [4, 5, 6, 7, 8]
    for bad in ((-1, 0), (10, -1), (10001, 0)):
        with pytest.raises(ValueError):
            browse.check_page(*bad)


def test_run_result_equals_reconcile(spark):
    led, run, res = _golden(spark)
    assert run.result.columns == res.columns
    assert run.result.orderBy("row_id").collect() == res.orderBy("row_id").collect()


def test_parquet_input_without_row_id(spark, tmp_path):
    """Parquet source with no row_id: ids are assigned once and kept; the
    run gives the same groups as the CSV input."""
    csv_led = load_ledger(spark, os.path.join(HERE, "fixtures", "golden_input.csv"))
    path = str(tmp_path / "ledger.parquet")
    csv_led.drop("row_id").coalesce(1).write.parquet(path)
    led = load_ledger(spark, path, fmt="parquet")
    assert "row_id" in led.columns and led.select("row_id").distinct().count() == 18
    assert dict(led.dtypes)["AMOUNT"] == "decimal(18,4)"
    run = run_passes(led, standard_spec())
    t = summary.run_totals(run.result).first()
    assert (t.input_rows, t.matched_rows, t.match_groups) == (18, 16, 6)
