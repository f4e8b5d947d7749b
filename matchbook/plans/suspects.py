"""Suspected matches: pairs below a pass's floor, for review.

After all passes, the rows still open are compared once more under the rules of the 1:1
passes with a lower floor.  The best pairs of each pass compete across passes: a pair is
suspected if it is the best one of both its rows (quality, earlier pass, lower ids), so no
row is in two.  Suspects are ranked over the run and never consume rows: the rows stay
UNMATCHED and open to later cycles.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.operators import one_to_one
from matchbook.operators.numbering import number_rows
from matchbook.operators.populations import pass_populations
from matchbook.plans.run import RunResult
from matchbook.session import materialize
from matchbook.spec import SpecError


def suspected_pairs(run: RunResult, floor: int) -> DataFrame:
    """(suspect_rank, l_id, r_id, quality, pass_id) of the open rows of a run."""
    rules = [p for p in run.spec.active_passes() if p.match_type == "ONE_TO_ONE"]
    if not rules:
        raise SpecError("suspected matches need a 1:1 pass")
    rest = materialize(run.ledger.join(run.matches.select("row_id"), "row_id", "left_anti"), "open-rows")
    made = []
    for k, p in enumerate(rules):
        lower = replace(p, quality=floor)
        left, right = pass_populations(rest, lower)
        made.append(one_to_one.best_pairs(left, right, lower)
                    .select("l_id", "r_id", "q", F.lit(k).alias("k"), F.lit(p.id).alias("pass_id")))
    pairs = materialize(reduce(DataFrame.unionByName, made), "suspects")
    roles = pairs.withColumn("row", F.explode(F.array("l_id", "r_id")))
    best = Window.partitionBy("row").orderBy(F.desc("q"), "k", F.least("l_id", "r_id"),
                                             F.greatest("l_id", "r_id"))
    won = (roles.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
           .groupBy("l_id", "r_id", "q", "k", "pass_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2"))
    ranked, _ = number_rows(won.withColumn("o", -F.col("q")), ["o", "k", "l_id", "r_id"],
                            seq_col="suspect_rank", tag="suspects", with_count=False)
    return ranked.select(F.col("suspect_rank").cast("bigint").alias("suspect_rank"), "l_id", "r_id",
                         F.col("q").alias("quality"), "pass_id")


def with_suspects(result: DataFrame, suspects: DataFrame) -> DataFrame:
    """The result with SUSPECT_RANK, SUSPECT_PASS, SUSPECT_QUALITY and REVIEW (true where a row
    is in a suspected pair); STATUS stays as it is."""
    rows = suspects.select(
        F.explode(F.array("l_id", "r_id")).alias("row_id"), F.col("suspect_rank").alias("SUSPECT_RANK"),
        F.col("pass_id").alias("SUSPECT_PASS"), F.col("quality").alias("SUSPECT_QUALITY"))
    return (result.join(rows, "row_id", "left")
            .withColumn("REVIEW", F.col("SUSPECT_RANK").isNotNull()))
