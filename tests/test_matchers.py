"""Edge cases of the four matchers on hand-made ledgers."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import LEDGER_SCHEMA, ledger_df, long_rows, row
from matchbook.operators import many_to_many, one_to_one
from matchbook.operators.matching import (match_many_to_many, match_many_to_one, match_one_to_many,
                                          match_one_to_one, number_groups, score_pairs)
from matchbook.operators.populations import pass_populations, select_population
from matchbook.plans.configs import m2m_pass, m2o_pass, o2m_pass, o2o_pass
from matchbook.plans import browse, summary
from matchbook.plans.run import run_pass, run_passes
from matchbook.sources.ledger import load_ledger
from matchbook.spec import Aggregation, Attribute, ExtraColumn, Filter, MatchPass, RunSpec, SpecError

CD = date(2024, 1, 15)


def _run(spark, rows, p):
    long, n = run_pass(ledger_df(spark, rows), p, "T", CD)
    return long_rows(long), n


def test_o2o_greedy_is_one_shot(spark):
    # Two identical left rows, one right: the lower left id wins, the other stays open.
    rows = [row(1, "L", 100, ref="A"), row(2, "L", 100, ref="A"), row(3, "R", 100, ref="A")]
    got, n = _run(spark, rows, o2o_pass())
    assert n == 1
    assert [r[0] for r in got] == [1, 3]


def test_o2o_best_quality_then_lowest_right(spark):
    # Left 1 has an exact right (date equal) and a date+1 right: picks the exact one.
    rows = [row(1, "L", 50, d="2024-01-10"), row(5, "R", 50, d="2024-01-11"),
            row(6, "R", 50, d="2024-01-10"), row(7, "R", 50, d="2024-01-10")]
    got, _ = _run(spark, rows, o2o_pass())
    assert [r[0] for r in got] == [1, 6] and got[0][3] == 100


def test_o2o_null_keys_never_match(spark):
    rows = [row(1, "L", 100, acct=None), row(2, "R", 100, acct=None),
            row(3, "L", None), row(4, "R", None)]
    got, n = _run(spark, rows, o2o_pass())
    assert got == [] and n == 0


def test_overlapping_populations_pair_each_row_once(spark):
    p = o2o_pass(left=(), right=())           # every row is in both populations
    rows = [row(1, "L", 100), row(2, "R", 100), row(3, "R", 100), row(4, "L", 7), row(5, "L", 9), row(6, "R", 9)]
    got, n = _run(spark, rows, p)
    assert n == 2 and [r[0] for r in got] == [1, 2, 5, 6]     # 3 finds its partners taken
    for p in (o2m_pass(left=(), right=()), m2o_pass(left=(), right=()), m2m_pass(left=(), right=())):
        with pytest.raises(SpecError):
            _run(spark, rows, p)


@pytest.mark.parametrize("left, right", [((), ()), ((Filter("AMOUNT", "<", 200),), ()),
                                         ((Filter("AMOUNT", ">", 100),), (Filter("REFERENCE", "!=", "B"),))])
def test_mirrored_pairs_are_told_apart_where_they_are_made(spark, left, right):
    rng = random.Random(11)
    rows = [row(-7 if i == 0 else 2**62 + 1 if i == 1 else i, rng.choice("LR"), rng.choice([100, 150, 200, None]),
                d=f"2024-01-{rng.randint(1, 9):02d}", ref=rng.choice(["A", "B", None])) for i in range(120)]
    p = o2o_pass(quality=0, left=left, right=right, attributes=(
        Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
        Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=60.0),
        Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=2),
        Attribute("REFERENCE", "REFERENCE", "EQUALS")))
    pairs = {(r.l_id, r.r_id): r.q for r in one_to_one.candidates(*pass_populations(ledger_df(spark, rows), p), p).collect()}
    once = {x: q for x, q in pairs.items() if (-q, x[0]) <= (-pairs.get(x[::-1], -1), x[1])}
    first: dict = {}
    for (a, b), q in once.items():
        first[a] = min(first.get(a, (0, 2**63)), (-q, b))
    second: dict = {}
    for a, (q, b) in first.items():
        second[b] = min(second.get(b, (0, 2**63)), (q, a))
    kept = {(a, b, -q) for b, (q, a) in second.items()}
    best: dict = {}
    for a, b, q in kept:
        for x in (a, b):
            best[x] = min(best.get(x, (0, 2**63, 2**63, a)), (-q, min(a, b), max(a, b), a))
    want = {(a, b, q) for a, b, q in kept if best[a] == best[b] == (-q, min(a, b), max(a, b), a)}
    got = one_to_one.best_pairs(*pass_populations(ledger_df(spark, rows), p), p)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 3 and "Aggregate [l_id" in plan     # none by pair


def test_equal_rows_collapse_before_the_join(spark):
    rows = [row(i, "L" if i % 2 else "R", 25, ref="FEE") for i in range(1, 401)]
    p = o2o_pass()
    left, right = pass_populations(ledger_df(spark, rows), p)
    assert one_to_one.candidates(left, right, p).count() == 200 * 200
    assert [tuple(r) for r in one_to_one.best_candidates(left, right, p).collect()] == [(1, 2, 100)]
    got, n = _run(spark, rows, p)
    assert n == 1 and [r[0] for r in got] == [1, 2]


def test_large_buckets_are_searched_within_the_days(spark):
    rows, rid = [], 1
    for day in range(1, 25):                   # 24 rows a side, one each day, and one group of 2 + 2
        for s in "LR":
            # Right amounts have fractions that never sum to a whole number.
            rows.append(row(rid, s, 1000 * 3 ** (day % 4) + (0.5 if s == "R" else 0) / 8 ** (day % 4),
                            d=f"2024-02-{day:02d}"))
            rid += 1
    rows += [row(900, "L", 5.5, d="2024-03-20"), row(901, "L", 4.5, d="2024-03-21"),
             row(902, "R", 3, d="2024-03-20"), row(903, "R", 7, d="2024-03-22")]
    got, n = _run(spark, rows, m2m_pass())
    assert n == 1 and [r[0] for r in got] == [900, 901, 902, 903]
    crowd = [row(2000 + k, "LR"[k % 2], 50 + k, d="2024-04-01", acct="CROWD") for k in range(40)]
    left, right = pass_populations(ledger_df(spark, rows + crowd), m2m_pass())
    assert many_to_many.skipped(left, right, m2m_pass()).count() == 0
    large = many_to_many.large_windows(left, right, m2m_pass()).where("k0 = 'CROWD'").collect()
    assert [(r["n_left"], r["n_right"], str(r["window"])) for r in large] == [(20, 20, "2024-04-01")]


def test_planted_pair_in_a_cell_of_40_by_40(spark):
    """Remainders modulo 16 rule out all other groups of up to five rows."""
    rows = [row(i, "L", 16 * (1000 + i * i % 997), d="2024-05-01") for i in range(1, 39)]
    rows += [row(100 + i, "R", 16 * (1000 + i * i % 991) + 1, d="2024-05-02") for i in range(1, 38)]
    rows += [row(201, "L", 7003.25), row(202, "L", 9003.5), row(211, "R", 5000.5), row(212, "R", 5001),
             row(213, "R", 6005.25)]
    rows = [(*r[:6], date(2024, 5, 1), *r[7:]) for r in rows]
    exact = m2m_pass(attributes=(
        Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=0.0), *m2m_pass().attributes[1:]))
    got, n = _run(spark, rows, exact)
    assert n == 1 and [r[0] for r in got] == [201, 202, 211, 212, 213] and got[0][3] == 100


def test_search_equals_enumeration(spark):
    """The same choice from buckets that are listed and from buckets that are searched."""
    rng, rows, rid = random.Random(3), [], 1
    for b in range(60):
        for s in "LR":
            for _ in range(rng.randint(2, 4)):
                rows.append(row(rid, s, rng.choice([-20, 5, 10, 10.25, 20, 30.5, 41, 100.75]) + rng.randint(0, 3),
                                d=f"2024-02-{rng.randint(1, 6):02d}", acct=f"B{b}"))
                rid += rng.randint(1, 2)
    rng.shuffle(rows)
    for tol in (dict(tolerance_amount=0.5), dict(tolerance_percent=0.02)):
        amount = Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, **tol)
        same, _ = _run(spark, rows, m2m_pass(quality=0, attributes=(amount,)))
        wide, _ = _run(spark, rows, m2m_pass(quality=0, attributes=(amount,), max_bucket_side=2))
        assert wide == same and len(same) > 30
        # With dates the earlier window goes first in a searched bucket: compare all but ties.
        dated = (amount, m2m_pass().attributes[2])
        same, _ = _run(spark, rows, m2m_pass(quality=0, attributes=dated))
        wide, _ = _run(spark, rows, m2m_pass(quality=0, attributes=dated, max_bucket_side=2))
        account = {r[0]: r[7] for r in rows}
        assert sorted((account[i], q) for i, _, _, q in wide) == sorted((account[i], q) for i, _, _, q in same)


def test_filter_literals_compare_exactly(spark):
    df = spark.createDataFrame([(1, Decimal("100.0000")), (2, Decimal("100.0001")), (3, Decimal("5"))],
                               "QTY bigint, AMOUNT decimal(18,4)")
    pick = lambda *f: sorted(r["QTY"] for r in select_population(df, [Filter(*f)]).collect())
    assert pick("QTY", "<", 2.5) == [1, 2] and pick("QTY", "=", 2.5) == [] and pick("QTY", "IN", [2.5, 3]) == [3]
    assert pick("AMOUNT", ">", 100.00005) == [2] and pick("AMOUNT", "=", "100.0") == [1]
    assert pick("QTY", ">=", "2") == [2, 3] and pick("AMOUNT", "<", 10 ** 20) == [1, 2, 3]


def test_awkward_column_names(spark):
    rows = [(*row(1, "L", 100), "a", 1), (*row(2, "R", 100), "a", 2), (*row(3, "R", 100), "b", 3)]
    df = spark.createDataFrame(rows, T.StructType([*LEDGER_SCHEMA.fields, T.StructField("TRADE-ID", T.StringType()),
                                                   T.StructField("q", T.LongType())]))
    p = o2o_pass(attributes=(Attribute("TRADE-ID", "TRADE-ID", "EQUALS"),
                             Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True)))
    extra = (ExtraColumn("TRADE-ID", "string"), ExtraColumn("q", "integer"))
    run = run_passes(df, RunSpec("T", (p,), "2024-01-15", extra))
    got = {r["row_id"]: (r["STATUS"], r["q"]) for r in run.result.collect()}
    assert got == {1: ("MATCHED", 1), 2: ("MATCHED", 2), 3: ("UNMATCHED", 3)}


def test_wide_decimals_are_not_binned(spark):
    wide = ledger_df(spark, [row(1, "L", 10), row(2, "R", 10.5)]).withColumn(
        "AMOUNT", F.col("AMOUNT").cast("decimal(38,4)") + F.lit("9" * 25).cast("decimal(38,0)"))
    p = o2o_pass(quality=0, attributes=(
        Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
        Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=1e12)))
    long, n = run_pass(wide, p, "T", CD)
    assert n == 1


def test_o2o_quality_rounding_half_up(spark):
    # 2 mandatory EQUALS + optional date WITHIN at 85 (1 of 4 days... ) -> exact .5 boundary
    p = o2o_pass(quality=0, attributes=(
        Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True),
        Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=4)))
    # delta 3 of 4 days -> 85 ; (100*10 + 85*10) / 20 = 92.5 -> 93
    rows = [row(1, "L", 10, d="2024-01-10"), row(2, "R", 10, d="2024-01-13")]
    got, _ = _run(spark, rows, p)
    assert got[0][3] == 93


def test_o2o_tolerance_percent(spark):
    p = o2o_pass(quality=0, band_join=True, attributes=(
        Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
        Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_percent=0.01)))
    rows = [row(1, "L", 1000), row(2, "R", 1009.99), row(3, "L", 1000, ref="x"),
            row(4, "R", 1010.01, ref="x", acct="ACC-2")]
    got, _ = _run(spark, rows, p)
    assert [r[0] for r in got] == [1, 2]
    assert got[0][3] == 80 or got[0][3] >= 80


def test_o2m_shared_bucket_goes_to_one_row(spark):
    # Two identical one-side rows claim the same bucket: only the lower id wins.
    rows = [row(1, "L", 300), row(2, "L", 300), row(3, "R", 100), row(4, "R", 200)]
    got, n = _run(spark, rows, o2m_pass())
    assert n == 1 and [r[0] for r in got] == [1, 3, 4]


def test_o2m_date_rule_uses_bucket_min_and_max(spark):
    rows = [row(1, "L", 300, d="2024-01-10"), row(3, "R", 100, d="2024-01-08"),
            row(4, "R", 200, d="2024-01-13")]             # max is 3 days away
    got, n = _run(spark, rows, o2m_pass())
    assert n == 0


def test_m2o_mirror(spark):
    rows = [row(1, "L", 100), row(2, "L", 200), row(3, "R", 300)]
    got, n = _run(spark, rows, m2o_pass())
    assert n == 1 and [r[0] for r in got] == [1, 2, 3]


def test_m2m_bucket_sizes(spark):
    # bucket A: 1 left row -> no group; bucket B: 10+10 -> enumerated; C: 11 left -> searched
    rows = [row(1, "L", 5, acct="A"), row(2, "R", 2, acct="A"), row(3, "R", 3, acct="A")]
    rid = 100
    for acct, nl in (("B", 10), ("C", 11)):
        for i in range(nl):
            rows.append(row(rid, "L", 10 + i, acct=acct)); rid += 1
        for i in range(10):
            rows.append(row(rid, "R", 10 + i, acct=acct)); rid += 1
    got, n = _run(spark, rows, m2m_pass())
    assert n == 2 and {100 <= r[0] < 120 for r in got} == {True, False} and all(r[0] >= 100 for r in got)


def test_m2m_tie_prefers_fewer_rows_then_larger_masks(spark):
    # Left {1,2,3} = 10 each, right {4,5} = 10 each: best is 2+2 rows; among the
    # equal 2+2 options the larger masks win: left rows 2,3 and right rows 4,5.
    rows = [row(1, "L", 10), row(2, "L", 10), row(3, "L", 10), row(4, "R", 10), row(5, "R", 10)]
    got, n = _run(spark, rows, m2m_pass())
    assert n == 1 and [r[0] for r in got] == [2, 3, 4, 5]


def test_m2m_quality_half_even(spark):
    # sums 3.0 vs 2.125: delta 0.875 over tolerance 1.0 -> 82.5 -> 82 (half to even)
    p = m2m_pass(attributes=(
        Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=1.0),
        Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True)))
    rows = [row(1, "L", 1), row(2, "L", 2), row(3, "R", 1.5), row(4, "R", 0.625)]
    got, _ = _run(spark, rows, p)
    assert got and got[0][3] == 82


def test_spec_rejects_invalid():
    with pytest.raises(SpecError):
        MatchPass(id="X", match_type="ONE_TO_MANY", attributes=(
            Attribute("AMOUNT", "AMOUNT", "EQUALS", aggregation=Aggregation("LEFT", "SUM")),))
    with pytest.raises(SpecError):
        Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", tolerance_days=0)
    with pytest.raises(SpecError):
        Attribute("AMOUNT", "AMOUNT", "WITHIN")
    with pytest.raises(SpecError):
        MatchPass(id="X", match_type="ONE_TO_ONE", attributes=())
    with pytest.raises(SpecError):
        o2o_pass(match_type="SIDEWAYS")


def test_csv_load_failfast_and_types(spark, tmp_path):
    from matchbook.sources.ledger import load_ledger
    good = tmp_path / "good.csv"
    good.write_text("LS_TYPE,DR_CR_IND,STATUS,AMOUNT,CURRENCY,VALUE_DATE,BANK_ACCOUNT,REFERENCE,NOTE\n"
                    "GL,CR,OPEN,1.23456,USD,2024-01-15,A,R,x\n")
    df = load_ledger(spark, str(good))
    r = df.first()
    assert str(r.AMOUNT) == "1.2346" and r.VALUE_DATE.isoformat() == "2024-01-15"
    assert dict(df.dtypes)["NOTE"] == "string" and "row_id" in df.columns
    bad = tmp_path / "bad.csv"
    bad.write_text("LS_TYPE,DR_CR_IND,STATUS,AMOUNT,CURRENCY,VALUE_DATE,BANK_ACCOUNT,REFERENCE\n"
                   "GL,CR,OPEN,notanumber,USD,2024-01-15,A,R\n")
    with pytest.raises(Exception):
        load_ledger(spark, str(bad)).collect()
    missing = tmp_path / "missing.csv"
    missing.write_text("LS_TYPE,AMOUNT\nGL,1\n")
    with pytest.raises(SpecError):
        load_ledger(spark, str(missing))


def test_like_and_in_filters(spark):
    from matchbook.operators.populations import select_population
    from matchbook.spec import Filter
    rows = [row(1, "L", 1, ref="A_1"), row(2, "L", 1, ref="AB1"), row(3, "L", 1, ref="a\\b"),
            row(4, "R", 1, ref="A_1", d="2023-12-31")]
    df = ledger_df(spark, rows)
    ids = lambda fs: sorted(r.row_id for r in select_population(df, fs).collect())  # noqa
    assert ids([Filter("REFERENCE", "LIKE", "A_1")]) == [1, 2, 4]
    assert ids([Filter("REFERENCE", "LIKE", "a\\b")]) == [3]
    assert ids([Filter("LS_TYPE", "IN", ["STMT"])]) == [4]
    assert ids([Filter("VALUE_DATE", "<", "2024-01-01")]) == [4]
    assert ids([]) == [1, 2, 3, 4]
    with pytest.raises(SpecError):
        Filter("REFERENCE", "IN", "notalist")
    with pytest.raises(SpecError):
        Attribute("SUBSTRING(REFERENCE, 0, 3)", "REFERENCE", "EQUALS")


def test_csv_extra_columns(spark, tmp_path):
    from matchbook.sources.ledger import load_ledger
    from matchbook.spec import ExtraColumn
    f = tmp_path / "extras.csv"
    f.write_text("LS_TYPE,DR_CR_IND,STATUS,AMOUNT,CURRENCY,VALUE_DATE,BANK_ACCOUNT,REFERENCE,"
                 "TRADE_DATE,QTY,FEE,FLAG,MATCHING_ID\n"
                 "GL,CR,OPEN,1,USD,2024-01-15,A,R,15/01/2024,7,2.5,true,OLD-ID\n")
    extras = (ExtraColumn("TRADE_DATE", "date", format="dd/MM/yyyy"),
              ExtraColumn("QTY", "integer"), ExtraColumn("FEE", "decimal", precision=10, scale=0),
              ExtraColumn("FLAG", "boolean"))
    df = load_ledger(spark, str(f), extras=extras)
    types = dict(df.dtypes)
    assert types["TRADE_DATE"] == "date" and types["QTY"] == "bigint"
    assert types["FEE"] == "decimal(10,0)" and types["FLAG"] == "boolean"
    assert "MATCHING_ID" not in df.columns          # stale output column dropped
    r = df.first()
    assert r.TRADE_DATE.isoformat() == "2024-01-15" and r.QTY == 7 and r.FLAG is True


def test_nothing_matches_and_no_active_pass(spark):
    from matchbook.plans.configs import standard_spec
    from matchbook.plans.run import run_passes
    from matchbook.spec import RunSpec
    rows = [row(1, "L", 10), row(2, "L", 20), row(3, "R", 999, acct="OTHER")]
    led = ledger_df(spark, rows)
    for spec in (standard_spec(),
                 RunSpec(set_id="T", cycle_date="2024-01-15",
                         passes=(o2o_pass(status="INACTIVE"),))):
        run = run_passes(led, spec)
        assert run.matches.count() == 0
        res = run.result.orderBy("row_id").collect()
        assert [r.STATUS for r in res] == ["UNMATCHED"] * 3
        assert all(r.MATCHING_ID is None and r.MATCH_QUALITY is None for r in res)
        assert run.result.columns[-4:] == ["MATCH_DATE", "MATCHING_ID", "MATCHED_BY_PASS",
                                           "MATCH_QUALITY"]


def test_within_on_extra_date_column(spark):
    """WITHIN on a declared extra date column compares day differences (not
    equality), with and without binning."""
    from pyspark.sql import functions as F
    rows = [row(1, "L", 10, ref="A"), row(2, "R", 10, ref="A"),
            row(3, "L", 20, ref="B"), row(4, "R", 20, ref="B")]
    led = ledger_df(spark, rows).withColumn(
        "TRADE_DATE", F.when(F.col("row_id") == 2, F.lit("2024-01-12").cast("date"))
        .when(F.col("row_id") == 4, F.lit("2024-01-20").cast("date"))
        .otherwise(F.lit("2024-01-10").cast("date")))
    for band in (True, False):
        p = o2o_pass(quality=0, band_join=band, attributes=(
            Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
            Attribute("TRADE_DATE", "TRADE_DATE", "WITHIN", mandatory=True, tolerance_days=2)))
        long, n = run_pass(led, p, "T", CD)
        ids = sorted(r.row_id for r in long.collect())
        assert ids == [1, 2] and n == 1, (band, ids)


def test_row_identity(spark, tmp_path):
    head = "LS_TYPE,DR_CR_IND,STATUS,AMOUNT,CURRENCY,VALUE_DATE,BANK_ACCOUNT,REFERENCE"
    line = lambda n: f"GL,CR,OPEN,{n}.00,USD,2024-01-15,A,R{n}"
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([head] + [line(n) for n in range(3)]) + "\n")
    (folder / "b.csv").write_text("\n".join([head] + [line(n) for n in range(3, 4000)]) + "\n")
    for split in ("134217728", "20000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = load_ledger(spark, str(folder)).orderBy("row_id").select("row_id", "REFERENCE").collect()
        assert [tuple(r) for r in got] == [(n, f"R{n}") for n in range(4000)]
        parquet = str(tmp_path / f"p{split}")
        spark.createDataFrame([(*r[1:],) for r in [row(n, "L", n, ref=f"R{n}") for n in range(500)]],
                              T.StructType(LEDGER_SCHEMA.fields[1:])).coalesce(1).write.parquet(parquet)
        got = load_ledger(spark, parquet, "parquet").orderBy("row_id").collect()
        assert [(r["row_id"], r["REFERENCE"]) for r in got] == [(n, f"R{n}") for n in range(500)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 * 1024 * 1024))
    given = tmp_path / "given.csv"
    given.write_text("\n".join(["row_id," + head, "2," + line(1), "10," + line(1)]) + "\n")
    assert dict(load_ledger(spark, str(given)).dtypes)["row_id"] == "bigint"
    given.write_text("\n".join(["row_id," + head, "2," + line(1), "2," + line(1)]) + "\n")
    with pytest.raises(SpecError):
        load_ledger(spark, str(given))


def test_manifest_keeps_items_without_side_or_currency(spark):
    rows = [row(1, "L", 100), row(2, "R", 100), row(3, "L", 5, ccy=None), (4, None, *row(4, "L", 1)[2:])]
    spec = RunSpec("T", (o2o_pass(), m2m_pass()), "2024-01-15")
    run = run_passes(ledger_df(spark, rows), spec, run_id="x")
    m = summary.run_manifest(run.result, spec, "x", run.started_at, 1.0, run.cycle_date, run.groups,
                             run.skipped, run.durations(), {"input": "in"}).first()
    assert m.totals.asDict() == {"input_rows": 4, "matched_rows": 2, "unmatched_rows": 2, "match_groups": 1}
    assert m.unmatched_breakdown.by_side == {"GL": 1, "(null)": 1}
    assert m.unmatched_breakdown.by_currency == {"USD": 1, "(null)": 1}
    assert [(p.pass_id, p.matched_groups, p.matched_rows, p.skipped_rows) for p in m.pass_breakdown] == \
        [("MP_O2O", 1, 2, 0), ("MP_M2M", 0, 0, 0)]
    assert m.input_path == "in" and m.output_path is None and m.pass_breakdown[0].duration_sec > 0
    alone = summary.run_manifest(run.result, spec, "x", run.started_at, 1.0, run.cycle_date).first()
    assert alone.totals == m.totals


def test_deep_pages_are_sought(spark):
    result = spark.range(0, 50000).selectExpr("id * 3 + IF(id > 40000, 1000000, 0) AS row_id",
                                              "IF(id % 5 = 0, 'UNMATCHED', 'MATCHED') AS STATUS")
    ids = [r.row_id for r in result.where("STATUS = 'MATCHED'").orderBy("row_id").collect()]
    for offset in (0, 7, 12345, 31999, 32001, 39995, 40000, 99999):
        total, rows = browse.matches_page(result, limit=10, offset=offset)
        assert total == len(ids) and [r.row_id for r in rows.collect()] == ids[offset:offset + 10]
    assert browse.seek(result, 45000)[1] < browse.SEEK_ROWS


def test_matchers_as_operators(spark):
    rows = [row(1, "L", 100), row(2, "R", 100), row(3, "L", 300, ref="B"), row(4, "R", 100, ref="C"),
            row(5, "R", 200, ref="D")]
    p = o2o_pass()
    left, right = pass_populations(ledger_df(spark, rows), p)
    pairs = match_one_to_one(left, right, p)
    ids = number_groups(pairs, "T", CD, offset=4).collect()
    assert {(r["row_id"], r["quality"], r["MATCHING_ID"]) for r in ids} == \
        {(1, 100, "MGID_T_20240115_000005"), (2, 100, "MGID_T_20240115_000005")}
    rest = lambda df: df.where("row_id > 2")
    got = match_one_to_many(rest(left), rest(right), o2m_pass())
    assert sorted(r["row_id"] for r in got.collect()) == [3, 4, 5] and got.where("leads").count() == 1
    mirror = match_many_to_one(rest(right), rest(left), m2o_pass(left=(), right=()))
    assert sorted(r["row_id"] for r in mirror.collect()) == [3, 4, 5]
    assert match_many_to_many(left, right, m2m_pass()).count() == 5     # 100 + 300 = 100 + 100 + 200
    with pytest.raises(SpecError):
        match_one_to_one(left, right, o2m_pass())


def test_score_pairs(spark):
    rows = [row(1, "L", 10, ref="AB12"), row(2, "R", 10, d="2024-01-18", ref="AB99")]
    df = ledger_df(spark, rows)
    pairs = df.where("row_id = 1").select(F.struct("*").alias("l")).join(
        df.where("row_id = 2").select(F.struct("*").alias("r")), F.lit(True))
    got = score_pairs(pairs, [
        Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True),
        Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=4),
        Attribute("SUBSTRING(REFERENCE, 1, 2)", "SUBSTRING(REFERENCE, 1, 2)", "EQUALS")]).first()
    assert got["quality"] == 93                    # (100 * 10 + 85 * 10 + 100 * 3) / 23 = 93.48
