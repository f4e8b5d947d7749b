"""Quality scores, 0..100, as Column expressions.

Fixed values of the scoring model: mandatory weight 10, optional weight 3,
a WITHIN attribute inside its tolerance scores between 80 and 100 on the
curve 100 - delta / tolerance * 20, and 0 outside it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchbook.functions.predicates import contains_predicate, numeric_tolerance
from matchbook.spec import WITHIN_FLOOR, Attribute, MatchPass

_TOL_GUARD = 1e-12   # divisor guard for a zero tolerance (also avoids ANSI divide-by-zero)


def _curve(delta: Column, tol: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(float(WITHIN_FLOOR)),
                                            F.lit(100.0) - delta / tol * F.lit(20.0)))


def attribute_score(attr: Attribute, left: Column, right: Column) -> Column:
    """Per-attribute score; a null on either side scores 0."""
    if attr.operator == "EQUALS":
        return F.when(left == right, F.lit(100.0)).otherwise(F.lit(0.0))
    if attr.operator == "CONTAINS":
        return F.when(contains_predicate(left, right), F.lit(100.0)).otherwise(F.lit(0.0))
    if attr.is_date_band:
        delta = F.abs(F.datediff(left, right))
        tol = attr.tolerance_days
        return F.when(delta <= F.lit(tol),
                      _curve(delta.cast("double"), F.lit(float(tol)))).otherwise(F.lit(0.0))
    delta = F.abs(left.cast("double") - right.cast("double"))
    tol = numeric_tolerance(attr, left)
    return F.when(delta <= tol,
                  _curve(delta, F.greatest(tol, F.lit(_TOL_GUARD)))).otherwise(F.lit(0.0))


def pass_score(p: MatchPass, left_cols: list[Column], right_cols: list[Column]) -> Column:
    """Weighted mean over all attributes of the pass, rounded half away from
    zero to a BIGINT.  ``left_cols[i]``/``right_cols[i]`` hold attribute i."""
    num = None
    den = 0
    for a, lc, rc in zip(p.attributes, left_cols, right_cols):
        term = attribute_score(a, lc, rc) * F.lit(float(a.weight))
        num = term if num is None else num + term
        den += a.weight
    return F.round(num / F.lit(float(den)), 0).cast("bigint")


def aggregate_quality(attr: Attribute, one: Column, total: Column) -> Column:
    """1:N / N:1 group quality: 100 for EQUALS; for WITHIN the amount curve
    against the one-side value, rounded half away from zero."""
    if attr.operator == "EQUALS":
        return F.lit(100).cast("bigint")
    delta = F.abs(one.cast("double") - total.cast("double"))
    tol = F.greatest(numeric_tolerance(attr, one), F.lit(_TOL_GUARD))
    return F.round(_curve(delta, tol), 0).cast("bigint")


def subset_quality(delta: Column, tol_eff: Column) -> Column:
    """N:M quality: max(80, round-half-even(100 - delta / tol * 20)); a zero
    tolerance gives 100 for an exact sum (anything else was filtered)."""
    q = F.greatest(F.lit(float(WITHIN_FLOOR)),
                   F.bround(F.lit(100.0) - delta / F.greatest(tol_eff, F.lit(_TOL_GUARD))
                            * F.lit(20.0), 0))
    return F.when(tol_eff <= F.lit(0.0),
                  F.when(delta == F.lit(0.0), F.lit(100)).otherwise(F.lit(0))) \
        .otherwise(q).cast("bigint")
