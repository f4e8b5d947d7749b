"""1:N and N:1 matching: one row against a whole hard-key bucket.

The many side is aggregated per bucket (SUM, COUNT, MIN, MAX or AVG of the
aggregated attribute, MIN/MAX date, COUNT >= 2) with partial aggregation, so a hot bucket shrinks
to one row before the shuffle.  One-side rows join the bucket rows, must
agree with the bucket sum (EQUALS as doubles, or WITHIN the tolerance) and,
when the pass has a VALUE_DATE WITHIN, the bucket's earliest and latest dates
must both lie within the tolerance of the one-side date.  Each one-side row
gets at most one bucket (it only has one), and each bucket is given to one
one-side row: the best quality, then the lowest row id.  Bucket members are
not collected into lists: the many rows re-join the winning buckets on the
keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.predicates import attr_expr, numeric_tolerance
from matchbook.functions.scores import aggregate_quality
from matchbook.spec import MatchPass


def _sides(p: MatchPass):
    one_is_left = p.match_type == "ONE_TO_MANY"
    return one_is_left, ("l" if one_is_left else "r"), ("r" if one_is_left else "l")


def _keys(p: MatchPass, side: str, df: DataFrame) -> list:
    return [attr_expr(lk if side == "l" else rk, df.columns).alias(f"k{i}")
            for i, (lk, rk) in enumerate(p.hard_keys())]


def _key_names(p: MatchPass) -> list[str]:
    return [f"k{i}" for i in range(len(p.hard_keys()))]


def buckets(many: DataFrame, p: MatchPass) -> DataFrame:
    """Many-side buckets: keys, m_sum, (m_dmin, m_dmax), m_n >= 2."""
    _, _, many_side = _sides(p)
    agg = p.total_attribute()
    value = attr_expr(agg.left if many_side == "l" else agg.right, many.columns)
    total = {"SUM": F.coalesce(F.sum("v"), F.lit(0)), "AVG": F.coalesce(F.sum("v"), F.lit(0)),
             "COUNT": F.count("v"), "MIN": F.min("v"), "MAX": F.max("v")}[agg.aggregation.function]
    date_attr = p.date_attribute()
    cols = _keys(p, many_side, many) + [value.alias("v"), F.col("row_id")]
    aggs = [total.alias("m_sum"), F.min("row_id").alias("m_first")]
    if agg.aggregation.function == "AVG":                  # compared as a sum and a count
        aggs.append(F.count("v").alias("m_vn"))
    if date_attr is not None:
        d = attr_expr(date_attr.left if many_side == "l" else date_attr.right, many.columns)
        cols.append(d.alias("d"))
        aggs += [F.min("d").alias("m_dmin"), F.max("d").alias("m_dmax")]
    aggs.append(F.count(F.lit(1)).alias("m_n"))
    return many.select(cols).groupBy(_key_names(p)).agg(*aggs).where(F.col("m_n") >= 2)


def candidates(one: DataFrame, many: DataFrame, p: MatchPass) -> DataFrame:
    """One-side rows joined to buckets that pass the amount and date rules."""
    _, one_side, _ = _sides(p)
    agg = p.total_attribute()
    date_attr = p.date_attribute()
    cols = [F.col("row_id").alias("one_id")] + _keys(p, one_side, one) + \
        [attr_expr(agg.left if one_side == "l" else agg.right, one.columns).alias("one_v")]
    if date_attr is not None:
        cols.append(attr_expr(date_attr.left if one_side == "l" else date_attr.right,
                              one.columns).alias("one_d"))
    cand = one.select(cols).join(buckets(many, p), _key_names(p), "inner")
    one_v, m_sum = F.col("one_v").cast("double"), F.col("m_sum").cast("double")
    if agg.aggregation.function == "AVG":
        # The average times the count is the sum, without a division.
        exact = F.col("one_v") * F.col("m_vn") == F.col("m_sum")
        m_sum = m_sum / F.nullif(F.col("m_vn"), F.lit(0)).cast("double")
    else:
        exact = one_v == m_sum
    if agg.operator == "EQUALS":
        ok = exact
    else:
        ok = F.abs(one_v - m_sum) <= numeric_tolerance(agg, F.col("one_v"))
    if date_attr is not None:
        td = F.lit(date_attr.tolerance_days)
        ok = ok & (F.abs(F.datediff(F.col("one_d"), F.col("m_dmin"))) <= td) \
            & (F.abs(F.datediff(F.col("one_d"), F.col("m_dmax"))) <= td)
    q = aggregate_quality(agg, F.col("one_v"), m_sum)
    return cand.where(ok).withColumn("q", q).where(F.col("q") >= F.lit(p.quality))


def groups(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """One row per accepted (one row, bucket); id order (quality desc, one id asc)."""
    one_is_left, _, _ = _sides(p)
    one, many = (left, right) if one_is_left else (right, left)
    cand = candidates(one, many, p)
    w = Window.partitionBy(*_key_names(p)).orderBy(F.desc("q"), F.asc("one_id"))
    best = cand.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return best.select(*_key_names(p), "one_id", "q", "m_n", "m_first",
                       (-F.col("q")).alias("_o1"), F.col("one_id").alias("_o2"))


def members(best: DataFrame, left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """Member rows: every many-side row of a winning bucket (re-joined on the
    bucket keys) plus the one-side row, which the bucket's first many row
    emits, so the winners are read by one join only.  The one-side row leads."""
    one_is_left, _, many_side = _sides(p)
    many = right if one_is_left else left
    j = (many.select(F.col("row_id"), *_keys(p, many_side, many))
         .join(best.select(*_key_names(p), "one_id", "m_first", "q", "_o1", "_o2"),
               _key_names(p), "inner"))
    out = F.explode(F.array(
        F.struct(F.col("row_id").alias("row_id"), F.lit(False).alias("_lead")),
        F.when(F.col("row_id") == F.col("m_first"),
               F.struct(F.col("one_id").alias("row_id"), F.lit(True).alias("_lead")))))
    return (j.select(out.alias("m"), "q", "_o1", "_o2").where(F.col("m").isNotNull())
            .select("m.row_id", "m._lead", "q", "_o1", "_o2"))
