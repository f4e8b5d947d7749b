"""Run the ordered match passes and assemble the reconciliation result.

Per pass: open rows -> populations -> matcher plan -> member rows, which are
narrow (row id, quality, order) and written once to the shared checkpoint
folder.  The next pass's open rows are the ledger without the member rows so
far (an anti-join on ``row_id``; no driver-side id set).  The ledger is written
once bucketed by ``row_id``, so only the narrow side of these joins is shuffled.
After the last pass all groups are numbered in one distributed step, ordered by
(pass, quality desc, tie id), so ids are dense and sequential across passes
without any per-pass round trip to the driver, and the ledger is joined once
with the narrow long form.  Ids travel as numbers and become texts after the joins.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.operators import many_to_many, one_to_many, one_to_one, partial_bucket
from matchbook.operators.numbering import matching_id, number_rows
from matchbook.operators.populations import pass_populations
from matchbook.session import materialize
from matchbook.spec import OUTPUT_COLUMNS, MatchPass, RunSpec

MATCH_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("MATCHING_ID", T.StringType()),
    T.StructField("MATCHED_BY_PASS", T.StringType()),
    T.StructField("MATCH_QUALITY", T.LongType()),
])


@dataclass
class PassRun:
    spec: MatchPass
    matches: DataFrame          # long form of this pass (materialised)
    groups: int | None
    duration_sec: float


@dataclass
class RunResult:
    ledger: DataFrame
    matches: DataFrame          # long form of all passes, with MATCH_DATE
    passes: list[PassRun]
    spec: RunSpec
    cycle_date: date
    started_at: str
    duration_sec: float
    run_id: str = ""
    extra: dict = field(default_factory=dict)
    result: DataFrame | None = None   # every input row with its match columns (a plan)
    groups: DataFrame | None = None   # pass_id, matched_groups (a plan over narrow rows)
    skipped: DataFrame | None = None  # pass_id, skipped_cells, skipped_rows: nothing is skipped

    def durations(self) -> dict[str, float]:
        return {r.spec.id: r.duration_sec for r in self.passes}


def pass_members(remaining: DataFrame, p: MatchPass) -> DataFrame:
    """One pass over ``remaining`` (lazy): member rows
    (row_id, q, _o1, _o2, _lead) where (_o1, _o2) is the group's id order
    inside the pass and exactly one member per group leads."""
    left, right = pass_populations(remaining, p)
    if p.match_type == "ONE_TO_ONE":
        return one_to_one.members(one_to_one.groups(left, right, p))
    if p.partial_bucket:
        return partial_bucket.members(partial_bucket.groups(left, right, p))
    if p.match_type in ("ONE_TO_MANY", "MANY_TO_ONE"):
        return one_to_many.members(one_to_many.groups(left, right, p), left, right, p)
    return many_to_many.members(many_to_many.groups(left, right, p))


def group_numbers(raw: DataFrame, offset: int = 0,
                  with_count: bool = True) -> tuple[DataFrame, int | None]:
    """Number all groups of a run at once, ordered by (pass, _o1, _o2):
    (frame of _pass, _o2, _seq; number of groups)."""
    heads = raw.where("_lead").select("_pass", "_o1", "_o2")
    numbered, n = number_rows(heads, ["_pass", "_o1", "_o2"], offset, tag="groups",
                              with_count=with_count)
    return numbered.select("_pass", "_o2", "_seq"), n


def numbered_rows(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """Member rows with the numbers of their group and pass, under names no ledger column has."""
    return raw.join(ids, ["_pass", "_o2"], "inner").select(
        "row_id", F.col("_seq").alias("_mb_seq"), F.col("_pass").alias("_mb_pass"),
        F.col("q").alias("_mb_q"))


def match_columns(passes: list[MatchPass], set_id: str, cycle_date: date) -> dict[str, Column]:
    """The columns of the long form from those of ``numbered_rows``; null where these are."""
    pass_id = F.coalesce(*[F.when(F.col("_mb_pass") == k, F.lit(p.id)) for k, p in enumerate(passes)])
    return {"MATCHING_ID": F.when(F.col("_mb_seq").isNotNull(),
                                  matching_id(F.col("_mb_seq"), set_id, cycle_date)),
            "MATCHED_BY_PASS": pass_id, "MATCH_QUALITY": F.col("_mb_q")}


def _shown(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def run_pass(remaining: DataFrame, p: MatchPass, set_id: str, cycle_date: date,
             offset: int = 0) -> tuple[DataFrame, int]:
    """A single pass with its own ids: (materialised long form, number of groups)."""
    raw = pass_members(remaining, p).withColumn("_pass", F.lit(0))
    ids, n = group_numbers(raw, offset)
    long = numbered_rows(raw, ids).select(
        "row_id", *_shown(match_columns([p], set_id, cycle_date)))
    return materialize(long, f"pass-{p.id}"), n


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def run_passes(ledger: DataFrame, spec: RunSpec, cycle_date: str | None = None,
               run_id: str = "") -> RunResult:
    """Run every ACTIVE pass in ruleOrder; ids are sequential across passes.

    Written are the ledger, bucketed by ``row_id``, and narrow member rows: one table per pass
    and the numbered long form ``matches``.  ``result`` (every input row with its match columns)
    is a plan: the ledger left-joined once with the long form on ``row_id``."""
    t0 = time.time()
    started = datetime.now(timezone.utc).isoformat()
    cdate = spec.effective_cycle_date(cycle_date)
    spark = ledger.sparkSession
    runs: list[PassRun] = []
    active = spec.active_passes()
    if not active:
        matches = spark.createDataFrame([], MATCH_SCHEMA).withColumn("MATCH_DATE", F.lit(cdate))
        return RunResult(ledger, matches, runs, spec, cdate, started, round(time.time() - t0, 3),
                         run_id, {"numbering_sec": 0.0}, reconcile(ledger, matches))
    ledger = materialize(ledger.repartition("row_id"), "run-ledger", bucket_by="row_id",
                         compression="zstd")
    remaining = ledger
    for k, p in enumerate(active):
        t1 = time.time()
        members = materialize(pass_members(remaining, p).select(
            "row_id", "q", "_o1", "_o2", "_lead", F.lit(k).alias("_pass")), f"members-{p.id}", compression="zstd")
        runs.append(PassRun(p, members, None, round(time.time() - t1, 3)))
        taken = _union([r.matches.select("row_id") for r in runs])   # one anti-join, not one a pass
        remaining = ledger.join(taken, "row_id", "left_anti")
    t1 = time.time()
    members = _union([r.matches for r in runs])
    columns = match_columns([r.spec for r in runs], spec.set_id, cdate)
    groups = members.withColumnRenamed("_pass", "_mb_pass") \
        .groupBy(columns["MATCHED_BY_PASS"].alias("pass_id")) \
        .agg(F.count_if("_lead").alias("matched_groups"))
    ids, _ = group_numbers(members, with_count=False)
    narrow = materialize(numbered_rows(members, ids), "matches", compression="zstd")
    numbering_sec = round(time.time() - t1, 3)
    for k, r in enumerate(runs):
        r.matches = narrow.where(F.col("_mb_pass") == k).select("row_id", *_shown(columns))
    matches = narrow.select("row_id", *_shown(columns), F.lit(cdate).alias("MATCH_DATE"))
    columns["MATCH_DATE"] = F.when(F.col("_mb_seq").isNotNull(), F.lit(cdate))
    return RunResult(ledger, matches, runs, spec, cdate, started,
                     round(time.time() - t0, 3), run_id, {"numbering_sec": numbering_sec},
                     _joined(ledger, narrow, columns), groups)


def reconcile(ledger: DataFrame, matches: DataFrame) -> DataFrame:
    """Every input row with STATUS, MATCH_DATE, MATCHING_ID, MATCHED_BY_PASS,
    MATCH_QUALITY (null when unmatched).  Input columns keep their order
    (STATUS rewritten); missing output columns follow."""
    names = ["MATCH_DATE", "MATCHING_ID", "MATCHED_BY_PASS", "MATCH_QUALITY"]
    base = ledger.drop(*names)
    return _joined(base, matches.select("row_id", *names), {c: F.col(c) for c in names})


def _joined(ledger: DataFrame, matches: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The ledger left-joined with ``matches``, of which ``columns`` are the match columns."""
    stale = [c for c in OUTPUT_COLUMNS if c != "STATUS" and c in ledger.columns]
    base = ledger.drop(*stale)
    status = F.when(columns["MATCHING_ID"].isNotNull(), F.lit("MATCHED")) \
        .otherwise(F.lit("UNMATCHED"))
    made = {**columns, "STATUS": status}
    order = base.columns + [c for c in OUTPUT_COLUMNS if c not in base.columns]
    joined = base.join(matches, "row_id", "left")
    return joined.select([made[c].alias(c) if c in OUTPUT_COLUMNS else F.col(c) for c in order])
