"""The registered queries: every operator of the library applied to the
reconciliation ledger derived from ``orders`` (whole table, no row caps).

Each query is ``fn(spark, sf_dir) -> DataFrame``.  The derived ledger and the
standard four-pass run are materialised once per session and data folder and
shared by the queries that read them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.operators import many_to_many, one_to_many, one_to_one
from matchbook.operators.numbering import matching_id, number_rows
from matchbook.operators.populations import pass_populations, select_population
from matchbook.plans import browse, summary
from matchbook.plans.configs import (CYCLE_DATE, GL_CR, SET_ID, STMT_DR, m2m_pass, m2o_pass,
                                     o2m_pass, o2o_pass, standard_spec)
from matchbook.plans.carry import run_cycle
from matchbook.plans.run import RunResult, run_pass, run_passes
from matchbook.plans.suspects import suspected_pairs
from matchbook.session import materialize, scratch_path
from matchbook.sources.ledger import derived_ledger, load_ledger
from matchbook.sources.sinks import record_run, write_paged, write_result
from matchbook.spec import Aggregation, Attribute, Filter, RunSpec

_cache: dict = {}


def _key(spark: SparkSession, sf_dir: str, what: str):
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), what)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key(spark, sf_dir, "ledger")
    if k not in _cache:
        _cache[k] = materialize(derived_ledger(
            spark, sf_dir, spark.sparkContext.defaultParallelism), "ledger", compression="zstd")
    return _cache[k]


def hot_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger with a third of the single-row orders moved into one
    account ('NOSTRO-HOT'): the skew case."""
    k = _key(spark, sf_dir, "hot")
    if k not in _cache:
        led = ledger(spark, sf_dir)
        hot = F.when(F.col("BANK_ACCOUNT").startswith("NOSTRO-0")
                     & (F.floor(F.col("row_id") / 16) % 3 == 0), F.lit("NOSTRO-HOT")) \
            .otherwise(F.col("BANK_ACCOUNT"))
        _cache[k] = materialize(led.withColumn("BANK_ACCOUNT", hot), "hot-ledger", compression="zstd")
    return _cache[k]


def adversarial_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger made hard: null accounts, currencies, sides and references, amounts
    rounded to thousands and references to 50 values (many equal rows and ties), split
    orders sharing accounts, dates moved to the start of their month."""
    k = _key(spark, sf_dir, "adversarial")
    if k not in _cache:
        order = F.floor(F.col("row_id") / 16)
        _cache[k] = materialize(ledger(spark, sf_dir).select(
            "row_id",
            F.when(order % 23 != 0, F.col("LS_TYPE")).alias("LS_TYPE"), "DR_CR_IND", "STATUS",
            (F.floor(F.col("AMOUNT") / 1000) * 1000).cast("decimal(18,4)").alias("AMOUNT"),
            F.when(order % 19 != 0, F.col("CURRENCY")).alias("CURRENCY"),
            F.trunc("VALUE_DATE", "month").alias("VALUE_DATE"),
            F.when(order % 17 != 0, F.when(
                F.col("BANK_ACCOUNT").startswith("NOSTRO-AGG-"),
                F.concat(F.lit("NOSTRO-AGG-"), (order % 397).cast("string")))
                .otherwise(F.col("BANK_ACCOUNT"))).alias("BANK_ACCOUNT"),
            F.when(order % 13 != 0, F.concat(F.lit("TRX-"), (order % 50).cast("string")))
            .alias("REFERENCE")), "adversarial-ledger", compression="zstd")
    return _cache[k]


def hot_fine_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger with a third of the single-row orders given one account, amount,
    currency and reference (a standing fee)."""
    fee = (F.floor(F.col("row_id") / 16) % 3 == 0) & F.col("BANK_ACCOUNT").startswith("NOSTRO-0")
    one = lambda c, v: F.when(fee, F.lit(v)).otherwise(F.col(c)).alias(c)
    return ledger(spark, sf_dir).select(
        "row_id", "LS_TYPE", "DR_CR_IND", "STATUS",
        F.when(fee, F.lit(25)).otherwise(F.col("AMOUNT")).cast("decimal(18,4)").alias("AMOUNT"),
        one("CURRENCY", "USD"), "VALUE_DATE", one("BANK_ACCOUNT", "NOSTRO-FEE"),
        one("REFERENCE", "FEE"))


def shared_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger with the accounts of split orders merged into five, so that a bucket
    holds the parts of many totals."""
    order = F.floor(F.col("row_id") / 16)
    return ledger(spark, sf_dir).withColumn("BANK_ACCOUNT", F.when(
        F.col("BANK_ACCOUNT").startswith("NOSTRO-AGG-"), F.concat(F.lit("NOSTRO-AGG-"), (order % 5).cast("string")))
        .otherwise(F.col("BANK_ACCOUNT")))


def adversarial_run(spark: SparkSession, sf_dir: str) -> RunResult:
    k = _key(spark, sf_dir, "adversarial-run")
    if k not in _cache:
        _cache[k] = run_passes(adversarial_ledger(spark, sf_dir), standard_spec(), run_id="run-adv")
    return _cache[k]


def standard_run(spark: SparkSession, sf_dir: str) -> RunResult:
    k = _key(spark, sf_dir, "run")
    if k not in _cache:
        _cache[k] = run_passes(ledger(spark, sf_dir), standard_spec(), run_id="run-standard")
    return _cache[k]


def standard_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key(spark, sf_dir, "result")
    if k not in _cache:
        _cache[k] = materialize(standard_run(spark, sf_dir).result, "result", compression="zstd")
    return _cache[k]


# ---------------------------------------------------------------- pass variants
SUBSTRING_PASS = o2o_pass(id="MP_SUBSTR", quality=0, attributes=(
    Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True),
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=1),
    Attribute("SUBSTRING(REFERENCE, 1, 8)", "SUBSTRING(REFERENCE, 1, 8)", "EQUALS")))

CONTAINS_PASS = o2o_pass(id="MP_CONTAINS", quality=0, left=GL_CR, right=STMT_DR, attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("REFERENCE", "REFERENCE", "CONTAINS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=2)))

NUMERIC_PASS = o2o_pass(id="MP_NUMERIC", quality=80, attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=5.0),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=False, tolerance_days=1)))

PERCENT_PASS = o2o_pass(id="MP_PERCENT", quality=0, attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=0.5,
              tolerance_percent=0.001),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=2)))

DATE_BAND_PASS = o2o_pass(id="MP_DATEBAND", quality=0, attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=3),
    Attribute("SUBSTRING(REFERENCE, 5, 30)", "SUBSTRING(REFERENCE, 5, 30)", "EQUALS")))

AMOUNT_BAND_PASS = o2o_pass(id="MP_AMTBAND", quality=0, attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=2.0),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=5)))

HOT_PASS = o2o_pass(id="MP_HOT", quality=85, attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=1),
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=0.01),
    Attribute("SUBSTRING(REFERENCE, 5, 30)", "SUBSTRING(REFERENCE, 5, 30)", "EQUALS")))

O2M_WITHIN_PASS = o2m_pass(id="MP_O2M_W", quality=0, attributes=(
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=25.0,
              tolerance_percent=0.0005, aggregation=Aggregation("RIGHT", "SUM")),
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=2)))

M2M_PERCENT_PASS = m2m_pass(id="MP_M2M_PCT", attributes=(
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_percent=0.002),
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=3)))

M2M_LARGE_PASS = m2m_pass(id="MP_M2M_LARGE", attributes=(
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_percent=0.05),
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=6)))

M2M_SKIP_PASS = m2m_pass(id="MP_M2M_SKIP", max_bucket_side=6, attributes=(
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=0.01),
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=150)))

PARTIAL_O2M_PASS = o2m_pass(id="MP_O2M_PART", quality=0, partial_bucket=True, attributes=(
    Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True, aggregation=Aggregation("RIGHT", "SUM")),
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=2)))

PARTIAL_M2O_PASS = m2o_pass(id="MP_M2O_PART", quality=80, partial_bucket=True, attributes=(
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=100.0,
              tolerance_percent=0.001, aggregation=Aggregation("LEFT", "SUM")),
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=1)))

HOT_CONTAINS_PASS = o2o_pass(id="MP_HOT_CONTAINS", quality=0, attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("REFERENCE", "SUBSTRING(REFERENCE, 1, 8)", "CONTAINS", mandatory=True)))

HOT_PERCENT_PASS = o2o_pass(id="MP_HOT_PERCENT", quality=0, attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=0.5, tolerance_percent=0.0005),
    Attribute("SUBSTRING(REFERENCE, 5, 30)", "SUBSTRING(REFERENCE, 5, 30)", "EQUALS")))

def _total_pass(function: str, left: str = "AMOUNT", **tolerance):
    return o2m_pass(id=f"MP_O2M_{function}", quality=0, attributes=(
        Attribute(left, "AMOUNT", "WITHIN" if tolerance else "EQUALS", mandatory=True,
                  aggregation=Aggregation("RIGHT", function), **tolerance),
        Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
        Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=2)))


#: One total of each kind: the number of parts by the length of the reference, the least and the
#: largest part by a share of the total, the exact average by half of it.
TOTAL_PASSES = {
    "COUNT": _total_pass("COUNT", "CAST(LENGTH(REFERENCE) - 5 AS DECIMAL(18,4))"),
    "MIN": _total_pass("MIN", tolerance_percent=0.6),
    "MAX": _total_pass("MAX", tolerance_percent=0.7, tolerance_amount=10),
    "AVG": _total_pass("AVG", "CAST(AMOUNT * 0.5 AS DECIMAL(18,4))")}

CYCLES = ("1995-06-30", "1998-12-31")
SUSPECT_FLOOR = 60
SUSPECT_SPEC = RunSpec(set_id=SET_ID, cycle_date=CYCLE_DATE, passes=(
    o2o_pass(id="MP_SUBSTR", quality=95, rule_order=1, attributes=SUBSTRING_PASS.attributes),
    o2m_pass(rule_order=2),
    o2o_pass(id="MP_AMTBAND", quality=99, rule_order=3, attributes=AMOUNT_BAND_PASS.attributes)))

OPTIMAL_PASS = o2o_pass(id="MP_OPTIMAL", quality=60, assignment="optimal", attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True, tolerance_amount=2500.0),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=20)))

OPEN_ITEMS = (Filter("STATUS", "=", "OPEN"),)
OVERLAP_PASS = o2o_pass(id="MP_OVERLAP", quality=0, left=OPEN_ITEMS, right=(), attributes=(
    Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True),
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=40)))

HOT_FINE_PASS = o2o_pass(id="MP_HOTFINE")

LATTICE_PASS = o2o_pass(id="MP_LATTICE", quality=0, attributes=(
    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True, tolerance_days=2),
    Attribute("SUBSTRING(REFERENCE, 1, 6)", "SUBSTRING(REFERENCE, 1, 6)", "EQUALS"),
    Attribute("SUBSTRING(REFERENCE, 5, 30)", "SUBSTRING(REFERENCE, 5, 30)", "EQUALS"),
    Attribute("SUBSTRING(CAST(AMOUNT AS STRING), 1, 4)", "SUBSTRING(CAST(AMOUNT AS STRING), 1, 4)",
              "EQUALS")))

POP_MIXED = (Filter("QTY", "<", 500.5), Filter("QTY", "!=", 7.25), Filter("AMOUNT", ">", 100000.00005),
             Filter("VALUE_DATE", ">=", "1995-06-01"), Filter("QTY", ">=", "3"))

POP_IN_LIKE = (Filter("CURRENCY", "IN", ["USD", "GBP"]),
               Filter("BANK_ACCOUNT", "LIKE", "NOSTRO-00%"),
               Filter("REFERENCE", "LIKE", "TRX-_%"))
POP_COMPARE = (Filter("LS_TYPE", "=", "STMT"), Filter("AMOUNT", ">", 100000),
               Filter("VALUE_DATE", ">=", "1995-01-01"), Filter("VALUE_DATE", "<", "1996-01-01"),
               Filter("CURRENCY", "!=", "JPY"), Filter("AMOUNT", "<=", 400000.5))


def _pairs(spark, sf_dir, p, greedy=True) -> DataFrame:
    left, right = pass_populations(ledger(spark, sf_dir), p)
    return (one_to_one.best_pairs if greedy else one_to_one.candidates)(left, right, p)


def _numbered_pass(spark, sf_dir, p) -> DataFrame:
    """One pass on the whole ledger, long form with ids."""
    long, _ = run_pass(ledger(spark, sf_dir), p, SET_ID, standard_spec().effective_cycle_date())
    return long


# ------------------------------------------------------------------- queries
def q_ledger_scan(spark, sf_dir):
    return ledger(spark, sf_dir)


def q_population_eq(spark, sf_dir):
    return select_population(ledger(spark, sf_dir), GL_CR)


def q_population_in_like(spark, sf_dir):
    return select_population(ledger(spark, sf_dir), POP_IN_LIKE)


def q_population_compare(spark, sf_dir):
    return select_population(ledger(spark, sf_dir), POP_COMPARE)


def q_attr_substring(spark, sf_dir):
    return _pairs(spark, sf_dir, SUBSTRING_PASS, greedy=False)


def q_attr_contains(spark, sf_dir):
    return _pairs(spark, sf_dir, CONTAINS_PASS)


def q_within_numeric(spark, sf_dir):
    return _pairs(spark, sf_dir, NUMERIC_PASS)


def q_within_percent(spark, sf_dir):
    return _pairs(spark, sf_dir, PERCENT_PASS)


def q_pair_scores(spark, sf_dir):
    return _pairs(spark, sf_dir, o2o_pass(quality=0), greedy=False)


def q_o2o_candidates(spark, sf_dir):
    return _pairs(spark, sf_dir, o2o_pass(), greedy=False)


def q_o2o_pairs(spark, sf_dir):
    p = o2o_pass()
    left, right = pass_populations(ledger(spark, sf_dir), p)
    numbered, _ = number_rows(one_to_one.groups(left, right, p), ["_o1", "_o2"], 0)
    cdate = standard_spec().effective_cycle_date()
    return numbered.select("l_id", "r_id", "q", F.col("_seq").alias("seq"),
                           matching_id(F.col("_seq"), SET_ID, cdate).alias("MATCHING_ID"))


def q_o2o_long(spark, sf_dir):
    return _numbered_pass(spark, sf_dir, o2o_pass())


def q_o2o_date_band(spark, sf_dir):
    return _pairs(spark, sf_dir, DATE_BAND_PASS)


def q_o2o_amount_band(spark, sf_dir):
    return _pairs(spark, sf_dir, AMOUNT_BAND_PASS)


def q_o2o_hot_account(spark, sf_dir):
    p = HOT_PASS
    left, right = pass_populations(hot_ledger(spark, sf_dir), p)
    return one_to_one.best_pairs(left, right, p)


def q_contains_hot_account(spark, sf_dir):
    """CONTAINS without dates in an account that holds a third of the rows."""
    left, right = pass_populations(hot_ledger(spark, sf_dir), HOT_CONTAINS_PASS)
    return one_to_one.best_pairs(left, right, HOT_CONTAINS_PASS)


def q_percent_hot_account(spark, sf_dir):
    """A tolerance in percent, without dates, in an account that holds a third of the rows."""
    left, right = pass_populations(hot_ledger(spark, sf_dir), HOT_PERCENT_PASS)
    return one_to_one.candidates(left, right, HOT_PERCENT_PASS)


def q_o2o_optimal(spark, sf_dir):
    """The pairs of the largest total quality under wide tolerances."""
    return _pairs(spark, sf_dir, OPTIMAL_PASS)


def q_o2m_buckets(spark, sf_dir):
    p = o2m_pass()
    _, right = pass_populations(ledger(spark, sf_dir), p)
    return one_to_many.buckets(right, p).select(
        F.col("k0").alias("BANK_ACCOUNT"), F.col("k1").alias("CURRENCY"),
        "m_sum", "m_dmin", "m_dmax", "m_n")


def q_o2m_groups(spark, sf_dir):
    return _numbered_pass(spark, sf_dir, o2m_pass())


def q_o2m_within_quality(spark, sf_dir):
    return _numbered_pass(spark, sf_dir, O2M_WITHIN_PASS)


def q_o2m_partial(spark, sf_dir):
    """1:N against a part of the bucket, exact totals, accounts shared by many orders."""
    long, _ = run_pass(shared_ledger(spark, sf_dir), PARTIAL_O2M_PASS, SET_ID,
                       standard_spec().effective_cycle_date())
    return long


def q_m2o_partial_within(spark, sf_dir):
    """N:1 against a part of the bucket, totals within an amount and a percentage."""
    long, _ = run_pass(shared_ledger(spark, sf_dir), PARTIAL_M2O_PASS, SET_ID,
                       standard_spec().effective_cycle_date())
    return long


def q_o2m_count(spark, sf_dir):
    return _numbered_pass(spark, sf_dir, TOTAL_PASSES["COUNT"])


def q_o2m_min(spark, sf_dir):
    return _numbered_pass(spark, sf_dir, TOTAL_PASSES["MIN"])


def q_o2m_max(spark, sf_dir):
    return _numbered_pass(spark, sf_dir, TOTAL_PASSES["MAX"])


def q_o2m_avg(spark, sf_dir):
    return _numbered_pass(spark, sf_dir, TOTAL_PASSES["AVG"])


def q_carried_items(spark, sf_dir):
    """Two cycles, the second with the items that the first left open: when each row was first
    seen and matched, and for how many cycles it was carried."""
    led, state = ledger(spark, sf_dir), scratch_path(spark, "open-items")
    first = date.fromisoformat(CYCLES[0])
    one = run_cycle(led.where(F.col("VALUE_DATE") <= first), standard_spec(), state, CYCLES[0])
    two = run_cycle(led.where(F.col("VALUE_DATE") > first), standard_spec(), state, CYCLES[1])
    shown = lambda c: c.result.select(
        "row_id", F.col("FIRST_SEEN").alias("first_seen"), F.col("MATCH_DATE").alias("matched_in"),
        F.col("AGE_CYCLES").alias("age"), "MATCHED_BY_PASS", "MATCH_QUALITY")
    return shown(one).where("matched_in IS NOT NULL").unionByName(shown(two))


def q_suspected_pairs(spark, sf_dir):
    """Pairs of open rows below the floors of two 1:1 passes, ranked over the run."""
    k = _key(spark, sf_dir, "suspect-run")
    if k not in _cache:
        _cache[k] = run_passes(adversarial_ledger(spark, sf_dir), SUSPECT_SPEC, run_id="run-suspect")
    return suspected_pairs(_cache[k], SUSPECT_FLOOR)


def q_m2o_groups(spark, sf_dir):
    return _numbered_pass(spark, sf_dir, m2o_pass())


def q_m2m_buckets(spark, sf_dir):
    p = m2m_pass()
    left, right = pass_populations(ledger(spark, sf_dir), p)
    return many_to_many.bucket_stats(left, right, p).select(
        F.col("k0").alias("BANK_ACCOUNT"), F.col("k1").alias("CURRENCY"),
        "n_left", "n_right", "eligible")


def q_m2m_subsets(spark, sf_dir):
    p = m2m_pass()
    left, right = pass_populations(ledger(spark, sf_dir), p)
    return many_to_many.groups(left, right, p).select(
        F.col("k0").alias("BANK_ACCOUNT"), F.col("k1").alias("CURRENCY"), "l_mask", "r_mask", "q")


def q_m2m_percent_groups(spark, sf_dir):
    """N:M with a percentage tolerance (sum bins sized per bucket)."""
    return _numbered_pass(spark, sf_dir, M2M_PERCENT_PASS)


def q_m2m_large_bucket(spark, sf_dir):
    """Buckets of up to more than a hundred rows a side, cut into date windows."""
    return _numbered_pass(spark, sf_dir, M2M_LARGE_PASS)


def q_m2m_skipped(spark, sf_dir):
    """Buckets left out by the search: none, whatever their size."""
    p = M2M_SKIP_PASS
    left, right = pass_populations(ledger(spark, sf_dir), p)
    return many_to_many.skipped(left, right, p).select(
        F.col("k0").alias("BANK_ACCOUNT"), F.col("k1").alias("CURRENCY"), "n_left", "n_right")


def q_m2m_large_windows(spark, sf_dir):
    """The date windows too large to enumerate, with their sizes."""
    p = M2M_SKIP_PASS
    left, right = pass_populations(ledger(spark, sf_dir), p)
    return many_to_many.large_windows(left, right, p).select(
        F.col("k0").alias("BANK_ACCOUNT"), F.col("k1").alias("CURRENCY"), "window",
        "n_left", "n_right")


def q_m2m_searched(spark, sf_dir):
    """Buckets of up to hundreds of rows a side with windows of 150 days, searched."""
    return _numbered_pass(spark, sf_dir, M2M_SKIP_PASS)


def q_o2o_overlap(spark, sf_dir):
    """One population on both sides."""
    left, right = pass_populations(adversarial_ledger(spark, sf_dir), OVERLAP_PASS)
    return one_to_one.best_pairs(left, right, OVERLAP_PASS)


def q_o2o_hot_fine_key(spark, sf_dir):
    """A third of the rows agree in account, amount, currency and reference."""
    left, right = pass_populations(hot_fine_ledger(spark, sf_dir), HOT_FINE_PASS)
    return one_to_one.best_pairs(left, right, HOT_FINE_PASS)


def q_o2o_lattice(spark, sf_dir):
    """Three attributes that only add to the score, in an account with a third of the rows."""
    left, right = pass_populations(hot_ledger(spark, sf_dir), LATTICE_PASS)
    return one_to_one.best_pairs(left, right, LATTICE_PASS)


def q_adversarial_matches(spark, sf_dir):
    return adversarial_run(spark, sf_dir).matches


def q_run_manifest(spark, sf_dir):
    """The manifest of the adversarial run, one row per figure."""
    r = adversarial_run(spark, sf_dir)
    m = summary.run_manifest(r.result, standard_spec(), "run-adv", "2024-01-15T09:00:00+00:00",
                             r.duration_sec, r.cycle_date, r.groups, r.skipped, r.durations())
    total = lambda c: F.struct(F.lit("total").alias("kind"), F.lit(c).alias("key"),
                               F.col(f"totals.{c}").alias("value"))
    listed = lambda kind, entries: F.transform(entries, lambda e: F.struct(
        F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"].alias("value")))
    return m.select(F.inline(F.concat(
        F.array(*[total(c) for c in ("input_rows", "matched_rows", "unmatched_rows", "match_groups")]),
        listed("side", F.map_entries("unmatched_breakdown.by_side")),
        listed("currency", F.map_entries("unmatched_breakdown.by_currency")),
        F.transform("pass_breakdown", lambda p: F.struct(
            F.lit("groups").alias("kind"), p["pass_id"].alias("key"),
            p["matched_groups"].alias("value"))))))


def q_population_mixed_types(spark, sf_dir):
    """Literals that the column's type does not hold, against BIGINT and DECIMAL(18,4)."""
    led = ledger(spark, sf_dir).withColumn("QTY", F.col("row_id") % 1000)
    return select_population(led, POP_MIXED)


def q_parquet_load(spark, sf_dir):
    """A Parquet ledger of many files without row ids: rows are numbered by file and position."""
    path = scratch_path(spark, "parquet-ledger")
    files = max(7, int(spark.conf.get("spark.sql.shuffle.partitions")))     # one task each
    (ledger(spark, sf_dir).repartitionByRange(files, "row_id").sortWithinPartitions("row_id")
     .drop("row_id").write.parquet(path))
    return load_ledger(spark, path, "parquet")


def q_m2m_groups(spark, sf_dir):
    return _numbered_pass(spark, sf_dir, m2m_pass())


def q_passes_matches(spark, sf_dir):
    return standard_run(spark, sf_dir).matches


def q_hot_passes_matches(spark, sf_dir):
    """The standard four-pass run on the skewed ledger (one hot account)."""
    k = _key(spark, sf_dir, "hot-run")
    if k not in _cache:
        _cache[k] = run_passes(hot_ledger(spark, sf_dir), standard_spec(), run_id="run-hot")
    return _cache[k].matches


def q_passes_remaining(spark, sf_dir):
    r = standard_run(spark, sf_dir)
    return r.ledger.join(r.matches.select("row_id"), "row_id", "left_anti")


def q_recon_result(spark, sf_dir):
    return standard_result(spark, sf_dir)


def q_run_totals(spark, sf_dir):
    return summary.run_totals(standard_result(spark, sf_dir))


def q_pass_breakdown(spark, sf_dir):
    return summary.pass_breakdown(standard_run(spark, sf_dir).matches, standard_spec())


def q_unmatched_by_side(spark, sf_dir):
    return summary.unmatched_by(standard_result(spark, sf_dir), "LS_TYPE")


def q_unmatched_by_currency(spark, sf_dir):
    return summary.unmatched_by(standard_result(spark, sf_dir), "CURRENCY")


def q_match_rate(spark, sf_dir):
    return summary.match_rate(standard_result(spark, sf_dir))


MATCHES_FILTERS = {"currency": "EUR", "matched_by_pass": "MP_O2O", "unknown": "ignored"}
BREAKS_FILTERS = {"currency": "USD"}


def q_matches_page(spark, sf_dir):
    total, rows = browse.matches_page(standard_result(spark, sf_dir), MATCHES_FILTERS, 100, 50)
    return browse.with_page_meta(total, rows, 100, 50)


DEEP_OFFSET = 20000
INDEXED_FILTERS = {"matched_by_pass": "MP_O2O", "currency": "GBP"}
INDEXED_OFFSET = 4321


def q_matches_page_deep(spark, sf_dir):
    total, rows = browse.matches_page(standard_result(spark, sf_dir), None, 100, DEEP_OFFSET)
    return browse.with_page_meta(total, rows, 100, DEEP_OFFSET)


def q_matches_page_indexed(spark, sf_dir):
    """A deep page through the zone map written with the result."""
    path = scratch_path(spark, "paged")
    write_paged(standard_result(spark, sf_dir), path)
    total, rows = browse.indexed_page(spark, path, "MATCHED", INDEXED_FILTERS, 100, INDEXED_OFFSET)
    return browse.with_page_meta(total, rows, 100, INDEXED_OFFSET)


def q_output_order(spark, sf_dir):
    """The place of every row in the ordered output, by file and position."""
    path = scratch_path(spark, "in-order")
    write_result(standard_result(spark, sf_dir), path, ordered=True)
    rows = spark.read.parquet(path).select("row_id", "MATCHING_ID", F.col("_metadata.file_name").alias("file"),
                                           F.col("_metadata.row_index").alias("at"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)      # one row a file
    starts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(starts, "file").select("row_id", "MATCHING_ID",
                                            (F.col("start") + F.col("at")).alias("place"))


def q_run_order(spark, sf_dir):
    """The place of every run in the history, newest first."""
    listed = q_run_history(spark, sf_dir).withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("at"))                               # one row a run
    return listed.select("run_id", "started_at", "matched_rows", place.alias("place"))


def q_breaks_page(spark, sf_dir):
    total, rows = browse.breaks_page(standard_result(spark, sf_dir), BREAKS_FILTERS, 100, 0)
    return browse.with_page_meta(total, rows, 100, 0)


HISTORY_RUNS = (("run-a", "2024-01-15T08:00:00+00:00", "cfg-o2o-only"),
                ("run-b", "2024-01-15T09:00:00+00:00", "cfg-standard"))


def q_run_history(spark, sf_dir):
    """Two runs (1:1 only, then all passes) recorded to a runs table and listed."""
    path = scratch_path(spark, "runs")
    led = ledger(spark, sf_dir)
    specs = {"cfg-o2o-only": RunSpec(set_id=SET_ID, cycle_date=CYCLE_DATE, passes=(o2o_pass(),)),
             "cfg-standard": standard_spec()}
    for run_id, started, cfg in HISTORY_RUNS:
        if cfg == "cfg-standard":
            r = standard_run(spark, sf_dir)
            result = standard_result(spark, sf_dir)
        else:
            r = run_passes(led, specs[cfg], run_id=run_id)
            result = r.result
        m = summary.run_manifest(result, specs[cfg], run_id, started, r.duration_sec,
                                 r.cycle_date, r.groups, r.skipped, r.durations())
        record_run(m, path, cfg)
    return browse.run_history(spark, path).drop("duration_sec")


RUN_META = ("run-b", "cfg-standard", "2024-01-15", "2024-01-15T09:00:00+00:00")


def q_run_detail(spark, sf_dir):
    """The standard run's manifest merged with its request metadata (manifest wins)."""
    path = scratch_path(spark, "runs")
    r = standard_run(spark, sf_dir)
    run_id, cfg, requested, started = RUN_META
    m = summary.run_manifest(standard_result(spark, sf_dir), standard_spec(), run_id, started,
                             r.duration_sec, r.cycle_date, r.groups, r.skipped, r.durations())
    record_run(m, path, cfg)
    meta = spark.createDataFrame([(run_id, "ignored-config", requested, "ignored")],
                                 "run_id string, config_id string, requested_cycle_date string, "
                                 "started_at string")
    d = browse.run_detail(spark, path, run_id, meta)
    return d.select("run_id", "set_id", "config_id", "cycle_date", "requested_cycle_date",
                    "started_at", "totals.input_rows", "totals.matched_rows",
                    "totals.unmatched_rows", "totals.match_groups",
                    F.size("pass_breakdown").alias("n_passes"),
                    F.col("unmatched_breakdown.by_side")["GL"].alias("unmatched_gl"),
                    F.col("unmatched_breakdown.by_side")["STMT"].alias("unmatched_stmt"))


def q_csv_roundtrip(spark, sf_dir):
    """Result written as CSV part files; every written column is read back as its text, and
    the ledger columns through the typed loader as well."""
    path = scratch_path(spark, "csv")
    write_result(standard_result(spark, sf_dir), path, fmt="csv", ordered=True)
    typed = load_ledger(spark, path, "csv").select("row_id", "AMOUNT", "VALUE_DATE", "BANK_ACCOUNT")
    texts = spark.read.option("header", True).csv(path).select(
        F.col("row_id").cast("bigint").alias("row_id"), "STATUS", F.col("AMOUNT").alias("AMOUNT_TEXT"),
        "CURRENCY", "REFERENCE", "MATCH_DATE", "MATCHING_ID", "MATCHED_BY_PASS", "MATCH_QUALITY")
    return typed.join(texts, "row_id")


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items())
           if name.startswith("q_") and callable(fn)}
