"""Run summaries: totals, per-pass breakdown, open items by side and currency,
match rate, and the one-row run manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.spec import RunSpec

PASS_LIST_SCHEMA = T.StructType([
    T.StructField("pass_id", T.StringType()),
    T.StructField("pass_name", T.StringType()),
    T.StructField("match_type", T.StringType()),
    T.StructField("rule_order", T.LongType()),
])


def run_totals(result: DataFrame) -> DataFrame:
    """input_rows, matched_rows, unmatched_rows, match_groups in one aggregation."""
    matched = F.col("MATCHING_ID").isNotNull()
    return result.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count("MATCHING_ID").alias("matched_rows"),
        F.coalesce(F.sum(F.when(~matched, 1)), F.lit(0)).cast("bigint").alias("unmatched_rows"),
        F.countDistinct("MATCHING_ID").alias("match_groups"))


def match_rate(result: DataFrame) -> DataFrame:
    """Matched rows as a percentage of input rows (0 for an empty input)."""
    t = run_totals(result)
    return t.select("input_rows", "matched_rows", F.when(
        F.col("input_rows") > 0,
        F.round(F.col("matched_rows") * F.lit(100.0) / F.col("input_rows"), 2))
        .otherwise(F.lit(0.0)).alias("match_rate_pct"))


def pass_breakdown(matches: DataFrame, spec: RunSpec) -> DataFrame:
    """One row per ACTIVE pass in ruleOrder; passes that matched nothing show 0.

    ``matches`` is the long form or the whole result (unmatched rows have no
    pass and drop out of the join).  Average quality is over matched *rows*
    (large groups weigh more), rounded to 2 decimals."""
    spark = matches.sparkSession
    plist = spark.createDataFrame(
        [(p.id, p.display_name, p.match_type, p.rule_order) for p in spec.active_passes()],
        PASS_LIST_SCHEMA)
    stats = matches.where(F.col("MATCHED_BY_PASS").isNotNull()) \
        .groupBy(F.col("MATCHED_BY_PASS").alias("pass_id")).agg(
        F.countDistinct("MATCHING_ID").alias("matched_groups"),
        F.count(F.lit(1)).alias("matched_rows"),
        F.round(F.avg("MATCH_QUALITY"), 2).alias("avg_quality"))
    # stats has one row per pass id: a size bound set by the configuration.
    return (plist.join(F.broadcast(stats), "pass_id", "left")
            .select("pass_id", "pass_name", "match_type", "rule_order",
                    F.coalesce("matched_groups", F.lit(0)).cast("bigint").alias("matched_groups"),
                    F.coalesce("matched_rows", F.lit(0)).cast("bigint").alias("matched_rows"),
                    F.coalesce("avg_quality", F.lit(0.0)).cast("double").alias("avg_quality")))


def unmatched_by(result: DataFrame, column: str) -> DataFrame:
    """Open items counted by one column (LS_TYPE = side, CURRENCY, ...)."""
    return (result.where(F.col("MATCHING_ID").isNull())
            .groupBy(column).agg(F.count(F.lit(1)).alias("unmatched_rows")))


NO_VALUE = "(null)"              # key of open items without a side or a currency


def run_manifest(result: DataFrame, spec: RunSpec, run_id: str, started_at: str,
                 duration_sec: float, cycle_date, groups: DataFrame | None = None,
                 skipped: DataFrame | None = None, durations: dict[str, float] | None = None,
                 paths: dict[str, str] | None = None) -> DataFrame:
    """One-row summary: totals, pass breakdown (with the pass's time and, for N:M, the cells
    and rows left out), open items by side and currency, and the run's paths.

    The result is aggregated once, to one row per pass, side and currency; everything else
    is folded from those few rows.  ``groups`` and ``skipped`` come from a ``RunResult``;
    without ``groups`` the distinct ids of the result are counted as well.  Open items
    without a value are kept under the key ``(null)``."""
    spark = result.sparkSession
    facts = (result.groupBy("MATCHED_BY_PASS", "LS_TYPE", "CURRENCY")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("MATCH_QUALITY").alias("quality")))
    if groups is None:
        groups = (result.where("MATCHING_ID IS NOT NULL")
                  .groupBy(F.col("MATCHED_BY_PASS").alias("pass_id"))
                  .agg(F.countDistinct("MATCHING_ID").alias("matched_groups")))
    passes = spark.createDataFrame(
        [(p.id, p.display_name, p.match_type, p.rule_order, (durations or {}).get(p.id))
         for p in spec.active_passes()],
        T.StructType([*PASS_LIST_SCHEMA.fields, T.StructField("duration_sec", T.DoubleType())]))
    # Stacked with a kind tag and folded by one global aggregation over one row per pass and
    # per pass x side x currency.
    wanted = [("pass_id", "string"), ("pass_name", "string"), ("match_type", "string"),
              ("rule_order", "bigint"), ("duration_sec", "double"), ("side", "string"),
              ("ccy", "string"), ("n", "bigint"), ("quality", "bigint"),
              ("matched_groups", "bigint"), ("skipped_cells", "bigint"), ("skipped_rows", "bigint")]

    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted])

    stacked = tagged(passes, "pass").unionByName(
        tagged(facts.select(F.col("MATCHED_BY_PASS").alias("pass_id"),
                            F.coalesce("LS_TYPE", F.lit(NO_VALUE)).alias("side"),
                            F.coalesce("CURRENCY", F.lit(NO_VALUE)).alias("ccy"),
                            "n", "quality"), "fact")).unionByName(tagged(groups, "groups"))
    if skipped is not None:
        stacked = stacked.unionByName(tagged(skipped, "skipped"))
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    open_item = F.col("pass_id").isNull() & (F.col("kind") == "fact")
    per_pass = stacked.where(F.col("pass_id").isNotNull()).groupBy("pass_id").agg(
        F.max("rule_order").alias("rule_order"), F.max("pass_name").alias("pass_name"),
        F.max("match_type").alias("match_type"), number("matched_groups").alias("matched_groups"),
        number("n").alias("matched_rows"),
        F.coalesce(F.round(F.sum("quality") / F.sum("n"), 2), F.lit(0.0)).alias("avg_quality"),
        F.max("duration_sec").alias("duration_sec"),
        number("skipped_cells").alias("skipped_cells"),
        number("skipped_rows").alias("skipped_rows"))
    per_open = lambda c: (stacked.where(open_item).groupBy(F.col(c).alias("key"))
                          .agg(F.sum("n").alias("value")))
    row = F.struct("rule_order", "pass_id", "pass_name", "match_type", "matched_groups",
                   "matched_rows", "avg_quality", "duration_sec", "skipped_cells", "skipped_rows")
    folded = (per_pass.select(F.lit("pass").alias("kind"), row.alias("p"),
                              F.lit(None).cast("struct<key:string,value:bigint>").alias("e"))
              .unionByName(per_open("side").select(F.lit("side").alias("kind"), F.struct(
                  "key", "value").alias("e")), allowMissingColumns=True)
              .unionByName(per_open("ccy").select(F.lit("ccy").alias("kind"), F.struct(
                  "key", "value").alias("e")), allowMissingColumns=True))
    entries = lambda kind: F.coalesce(F.map_from_entries(F.sort_array(F.collect_list(
        F.when(F.col("kind") == kind, F.col("e"))))), F.create_map().cast("map<string,bigint>"))
    matched = F.coalesce(F.sum("p.matched_rows"), F.lit(0)).cast("bigint")
    opened = F.coalesce(F.sum(F.when(F.col("kind") == "side", F.col("e.value"))),
                        F.lit(0)).cast("bigint")
    one = folded.agg(
        F.struct((matched + opened).alias("input_rows"), matched.alias("matched_rows"),
                 opened.alias("unmatched_rows"),
                 F.coalesce(F.sum("p.matched_groups"), F.lit(0)).cast("bigint")
                 .alias("match_groups")).alias("totals"),
        F.sort_array(F.collect_list("p")).alias("pass_breakdown"),
        entries("side").alias("by_side"), entries("ccy").alias("by_currency"))
    where = paths or {}
    return one.select(F.lit(run_id).alias("run_id"), F.lit(spec.set_id).alias("set_id"),
                      F.lit(cycle_date).cast("date").alias("cycle_date"),
                      F.lit(started_at).alias("started_at"),
                      F.lit(float(duration_sec)).alias("duration_sec"),
                      *[F.lit(where.get(k)).cast("string").alias(f"{k}_path")
                        for k in ("input", "output", "config")],
                      "totals", "pass_breakdown",
                      F.struct("by_side", "by_currency").alias("unmatched_breakdown"))
