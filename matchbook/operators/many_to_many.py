"""N:M matching: best subset pair inside hard-key buckets.

A bucket with 2..``max_bucket_side`` rows on both sides is enumerated: each side's subsets
of size >= 2 are listed with higher-order functions (mask m over the members sorted by row
id, bit i = the i-th member): sum, earliest and latest date.  Left and right subsets are
paired by a band join on the bucket plus a sum bin.  Sizes are counted first (partial
aggregation), so member lists are only built for buckets that are known to be small; a hot
account with millions of rows never becomes a list.  Larger buckets are searched by groups
of growing size (see ``subset_search``), which gives the same choice without listing all
subsets; no bucket is left out.

A pair must satisfy |sumL - sumR| <= max(toleranceAmount, |sumL| * tolerancePercent) and,
with a VALUE_DATE WITHIN, the spread of all dates of both subsets must be within the
tolerance.  Per bucket the best pair wins: quality desc, fewer rows, then (in a searched
bucket) the earlier window of days that holds it, the larger left mask and the larger right
mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions.predicates import attr_expr
from matchbook.functions.scores import subset_quality
from matchbook.operators import subset_search
from matchbook.operators.band import floor_div
from matchbook.session import materialize
from matchbook.spec import MatchPass


def _key_names(p: MatchPass) -> list[str]:
    return [f"k{i}" for i in range(len(p.hard_keys()))]


def _scale(df: DataFrame, expr: str) -> int:
    t = df.select(attr_expr(expr, df.columns).alias("x")).schema["x"].dataType
    return t.scale if isinstance(t, T.DecimalType) else 0


def _members(df: DataFrame, p: MatchPass, side: str, scale: int) -> DataFrame:
    """(keys, id, units, day) per row; rows with a null key, amount or date are left out."""
    amt = p.amount_attribute()
    date_attr = p.date_attribute()
    keys = [attr_expr(lk if side == "l" else rk, df.columns).alias(f"k{i}")
            for i, (lk, rk) in enumerate(p.hard_keys())]
    value = attr_expr(amt.left if side == "l" else amt.right, df.columns)
    cols = keys + [F.col("row_id").alias("id"),
                   (value * F.lit(10 ** scale)).cast("bigint").alias("u")]
    if date_attr is not None:
        d = attr_expr(date_attr.left if side == "l" else date_attr.right, df.columns)
        cols.append(F.unix_date(d.cast("date")).alias("day"))
    else:
        cols.append(F.lit(0).alias("day"))
    out = df.select(cols).where(F.col("u").isNotNull()).dropna(subset=_key_names(p))
    return out.where(F.col("day").isNotNull()) if date_attr is not None else out


def member_rows(left: DataFrame, right: DataFrame, p: MatchPass,
                scale: int | None = None) -> DataFrame:
    """Member rows of both populations in one frame, tagged by side: keys, id, units, day."""
    scale = _scale(left, p.amount_attribute().left) if scale is None else scale
    return _members(left, p, "l", scale).withColumn("side", F.lit("l")).unionByName(
        _members(right, p, "r", scale).withColumn("side", F.lit("r")))


def _counts(both: DataFrame, by: list[str]) -> DataFrame:
    return both.groupBy(by).agg(F.count_if(F.col("side") == "l").alias("n_left"),
                                F.count_if(F.col("side") == "r").alias("n_right"))


def _fits(p: MatchPass):
    ok = lambda c: (F.col(c) >= 2) & (F.col(c) <= p.max_bucket_side)
    return ok("n_left") & ok("n_right")


def bucket_stats(left: DataFrame, right: DataFrame, p: MatchPass,
                 both: DataFrame | None = None) -> DataFrame:
    """Per bucket present on both sides: row counts and whether it is a cell as it is.

    One partially-aggregated count over both sides: a hot bucket is a single
    row before the shuffle."""
    both = both if both is not None else member_rows(left, right, p)
    return (_counts(both, _key_names(p)).where((F.col("n_left") > 0) & (F.col("n_right") > 0))
            .withColumn("eligible", _fits(p)))


def _cells(both: DataFrame, p: MatchPass) -> DataFrame:
    """The buckets that can have a group, with their counts, written once."""
    return materialize(bucket_stats(None, None, p, both)
                       .where((F.col("n_left") >= 2) & (F.col("n_right") >= 2)), f"m2m-cells-{p.id}")


def large_windows(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """The cells that are not enumerated: keys, window (its first day; null if the pass compares
    no dates), n_left, n_right.  A cell is a date window of a large bucket, [d, d + t] for every
    day d of the bucket, with more than ``max_bucket_side`` rows on a side."""
    kn = _key_names(p)
    both = member_rows(left, right, p)
    rows = both.join(_cells(both, p).where("NOT eligible").select(kn), kn, "left_semi")
    if p.date_attribute() is None:
        return _counts(rows, kn).withColumn("window", F.lit(None).cast("date"))
    spread = rows.withColumn("win", F.explode(F.sequence(
        F.col("day") - p.date_attribute().tolerance_days, F.col("day"))))
    cells = (spread.groupBy(kn + ["win"])
             .agg(F.count_if(F.col("side") == "l").alias("n_left"),
                  F.count_if(F.col("side") == "r").alias("n_right"),
                  F.max(F.col("day") == F.col("win")).alias("starts"))
             .where(F.col("starts") & (F.col("n_left") >= 2) & (F.col("n_right") >= 2) & ~_fits(p)))
    return cells.select(*kn, F.date_from_unix_date("win").alias("window"), "n_left", "n_right")


def skipped(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """Buckets that were neither enumerated nor searched to their end: none, whatever their
    size.  Keys, n_left, n_right."""
    kn = _key_names(p)
    both = materialize(member_rows(left, right, p), f"m2m-members-{p.id}")
    cells = _cells(both, p)
    _, done = subset_search.search(both, cells.where("NOT eligible"), kn, p,
                                   _scale(left, p.amount_attribute().left))
    return cells.where("NOT eligible").join(done, kn, "left_anti").drop("eligible")


def _bucket_lists(both: DataFrame, cells: DataFrame, p: MatchPass) -> DataFrame:
    """One row per small bucket with both member arrays.

    Lists are only built after the counts proved the bucket small."""
    kn = _key_names(p)
    m = both.join(cells.where("eligible").select(kn), kn, "left_semi")
    member = F.struct("id", "u", "day")
    return m.groupBy(kn).agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "l", member))).alias("l_m"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "r", member))).alias("r_m"))


def _subsets(buckets: DataFrame, side: str, kn: list[str]) -> DataFrame:
    """Every subset of size >= 2 of one side of each bucket: mask, sum, dates, size."""
    m, mask = f"{side}_m", f"{side}_mask"
    exploded = buckets.select(*kn, "w", "tol_units", "l_min_id", m, F.explode(
        F.sequence(F.lit(3).cast("bigint"),
                   F.pow(F.lit(2), F.size(m)).cast("bigint") - 1)).alias(mask))
    exploded = exploded.where(F.bit_count(mask) >= 2)
    picked = f"(x, i) -> IF(({mask} >> i) & 1 = 1, x.%s, NULL)"
    return exploded.select(
        *kn, "w", "tol_units", "l_min_id", mask,
        F.expr(f"aggregate(transform({m}, {picked % 'u'}), 0L, (a, v) -> a + coalesce(v, 0L))")
        .alias(f"{side}_sum"),
        F.expr(f"array_min(transform({m}, {picked % 'day'}))").alias(f"{side}_dmin"),
        F.expr(f"array_max(transform({m}, {picked % 'day'}))").alias(f"{side}_dmax"),
        F.bit_count(mask).alias(f"{side}_cnt"))


def _chosen(side: str):
    """Member ids of a mask, ascending."""
    return F.expr(f"filter(transform({side}_m, (x, i) -> "
                  f"IF(({side}_mask >> i) & 1 = 1, x.id, NULL)), v -> v IS NOT NULL)")


def groups(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """The winning pair of each bucket: keys, l_ids and r_ids (ascending), l_mask and r_mask
    (null in a bucket that was searched), q.  Id order: (quality desc, smallest left row id of
    the bucket, or of the date window in one that was searched)."""
    kn = _key_names(p)
    scale = _scale(left, p.amount_attribute().left)
    # Counted, listed and searched from one narrow table of the rows still open.
    both = materialize(member_rows(left, right, p, scale), f"m2m-members-{p.id}")
    cells = _cells(both, p)
    order = [(-F.col("q")).alias("_o1"), F.col("l_min_id").alias("_o2")]
    best = _enumerated(both, cells, p, scale).select(
        *kn, "l_ids", "r_ids", "l_mask", "r_mask", "q", *order)
    large = cells.where("NOT eligible")
    if large.isEmpty():
        return best
    none = F.lit(None).cast("bigint")
    found, _ = subset_search.search(both, large, kn, p, scale)
    return best.unionByName(found.select(*kn, "l_ids", "r_ids", none.alias("l_mask"),
                                         none.alias("r_mask"), "q", *order))


def _enumerated(both: DataFrame, cells: DataFrame, p: MatchPass, scale: int) -> DataFrame:
    """The winning pair of each small bucket."""
    amt = p.amount_attribute()
    date_attr = p.date_attribute()
    kn = _key_names(p)
    tol_abs = float(amt.tolerance_amount or 0.0)
    tol_pct = float(amt.tolerance_percent or 0.0)
    b = _bucket_lists(both, cells, p)
    # Widest tolerance any left subset can have, in units (sum of |members| bounds |sumL|).
    abs_total = F.aggregate(F.col("l_m"), F.lit(0).cast("bigint"),
                            lambda a, x: a + F.abs(x["u"]))
    tol_units = F.greatest(F.lit(int(tol_abs * 10 ** scale + 1e-9)).cast("bigint"),
                           F.ceil(abs_total.cast("double") * F.lit(tol_pct)).cast("bigint"))
    b = b.withColumn("tol_units", tol_units).withColumn("w", F.greatest(F.col("tol_units"),
                                                                        F.lit(1).cast("bigint")))
    b = b.withColumn("l_min_id", F.col("l_m")[0]["id"])
    b = materialize(b, f"m2m-buckets-{p.id}")
    ls = _subsets(b, "l", kn)
    ls = ls.withColumn("bin", F.explode(F.sequence(
        floor_div(F.col("l_sum") - F.col("tol_units"), F.col("w")),
        floor_div(F.col("l_sum") + F.col("tol_units"), F.col("w")))))
    rs = _subsets(b, "r", kn)
    rs = rs.withColumn("bin", floor_div(F.col("r_sum"), F.col("w"))) \
        .drop("w", "tol_units", "l_min_id")
    pairs = ls.join(rs, kn + ["bin"], "inner")
    div = float(10 ** scale)
    l_sum = F.col("l_sum").cast("double") / F.lit(div)
    r_sum = F.col("r_sum").cast("double") / F.lit(div)
    tol_eff = F.greatest(F.lit(tol_abs), F.abs(l_sum) * F.lit(tol_pct))
    delta = F.abs(l_sum - r_sum)
    pairs = pairs.where(delta <= tol_eff)
    if date_attr is not None:
        spread = F.greatest("l_dmax", "r_dmax") - F.least("l_dmin", "r_dmin")
        pairs = pairs.where(spread <= F.lit(date_attr.tolerance_days))
    pairs = pairs.withColumn("q", subset_quality(delta, tol_eff)) \
        .where(F.col("q") >= F.lit(p.quality))
    w = Window.partitionBy(*kn).orderBy(
        F.desc("q"), F.asc(F.col("l_cnt") + F.col("r_cnt")), F.desc("l_mask"), F.desc("r_mask"))
    best = pairs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return (best.select(*kn, "l_mask", "r_mask", "q", "l_min_id")
            .join(b.select(*kn, "l_m", "r_m"), kn)
            .withColumn("l_ids", _chosen("l")).withColumn("r_ids", _chosen("r")))


def members(best: DataFrame) -> DataFrame:
    """Member rows of both chosen subsets; the first chosen left row leads."""
    return best.select(F.explode(F.concat("l_ids", "r_ids")).alias("row_id"),
                       F.col("l_ids")[0].alias("_first"), "q", "_o1", "_o2") \
        .select("row_id", (F.col("row_id") == F.col("_first")).alias("_lead"), "q", "_o1", "_o2")
