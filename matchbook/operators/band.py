"""Band join by binning: turn ``|l - r| <= t`` into an equi-join plus the
exact residual test.

The value is mapped to integer units (days for dates; the unscaled integer
for decimals and integers), the bin width is ``w = max(1, t)`` in units, a
right row goes into bin ``floor(u / w)`` and a left row is exploded into the
bins ``floor((u - t) / w) .. floor((u + t) / w)`` (at most three); the test
is symmetric, so the roles may be swapped per attribute.  Every pair within
the tolerance meets in exactly one bin, so no de-duplication is needed, and a
hot hard-key bucket is split by value instead of being joined all-to-all.
Integer arithmetic throughout, so bins are exact.  A tolerance that is a
percentage of the value has bins on a logarithmic scale (``ratio_bins``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.spec import Attribute, MatchPass


def floor_div(x: Column, w: Column | int) -> Column:
    """Exact floor division of BIGINT ``x`` by a positive BIGINT ``w``."""
    w = w if isinstance(w, Column) else F.lit(int(w))
    # x - pmod(x, w) is a multiple of w: the decimal quotient is an exact integer.
    return ((x - F.pmod(x, w)).cast("decimal(20,0)") / w.cast("decimal(20,0)")).cast("bigint")


def ratio_bins(units: Column, tol: float, pct: float) -> tuple[Column, Column]:
    """(own bin, bins in reach) of a value for |l - r| <= max(tol, |l| * pct); tol in units.

    Without a percentage the bins are ``max(1, tol)`` wide.  With one they are geometric:
    values go to the scale sign(x) * ln(1 + pct * |x| / tol) / pct, on which every tolerance
    has the width 1 / (1 - pct) at most, so bins of that width keep a pair within tolerance
    in neighbouring bins, whatever its size.  From 50 % on all values share one bin."""
    if pct == 0.0:
        w = max(1, int(tol + 1e-9))
        x = units.cast("bigint")
        t = F.lit(int(tol + 1e-9))
        return floor_div(x, w), F.sequence(floor_div(x - t, w), floor_div(x + t, w))
    if pct >= 0.5:
        return F.lit(0).cast("bigint"), F.array(F.lit(0).cast("bigint"))
    x = units.cast("double")
    g = F.signum(x) * F.log1p(F.abs(x) * F.lit(pct / max(tol, 1.0))) / F.lit(pct)
    w, slack = 1.0 / (1.0 - pct), 1e-6
    cell = lambda v: F.floor(v / F.lit(w))
    return cell(g), F.sequence(cell(g - F.lit(w + slack)), cell(g + F.lit(w + slack)))


def value_units(value: Column, dtype: T.DataType) -> tuple[Column, int] | None:
    """(integer units, scale exponent) for a numeric or date value, else None."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_date(value.cast("date")).cast("bigint"), 0
    if isinstance(dtype, T.DecimalType) and dtype.precision > 18:
        return None                              # units may not fit a BIGINT: not binned
    if isinstance(dtype, T.DecimalType):
        return (value * F.lit(10 ** dtype.scale)).cast("bigint"), dtype.scale
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return value.cast("bigint"), 0
    return None


def tolerance_units(attr: Attribute, scale: int) -> tuple[float, float]:
    """(tolerance in units, share of the left value): the larger one holds."""
    if attr.is_date_band:
        return float(attr.tolerance_days), 0.0
    return (attr.tolerance_amount or 0.0) * 10 ** scale, float(attr.tolerance_percent or 0.0)


def coarse(p: MatchPass) -> bool:
    """Whether values are binned and indexed as well: ``p.band_join`` forces it; by default
    where at most one key stands beside the implicit BANK_ACCOUNT, since one bucket can then
    hold a large share of the rows."""
    return len(p.hard_keys()) <= 2 if p.band_join is None else p.band_join


def pick_bands(p: MatchPass, left_types: list[T.DataType],
               max_dims: int = 2) -> list[tuple[int, tuple[float, float]]]:
    """(attribute index, (tolerance units, percentage)) of the WITHIN attributes to bin on,
    where the keys are coarse.  Up to two attributes are binned, so a hot bucket is split by
    date and by amount."""
    if not coarse(p):
        return []
    out = []
    for i, a in enumerate(p.attributes):
        if a.operator != "WITHIN" or len(out) >= max_dims:
            continue
        u = value_units(F.lit(None), left_types[i])
        is_date = isinstance(left_types[i], (T.DateType, T.TimestampType, T.TimestampNTZType))
        if u is None or is_date != a.is_date_band:
            continue
        out.append((i, tolerance_units(a, u[1])))
    return out


def add_bins(left: DataFrame, right: DataFrame, lcol: str, rcol: str, dtype: T.DataType,
             tol: tuple[float, float], name: str, explode_left: bool = True) -> tuple[DataFrame, DataFrame]:
    """Bin both sides on one attribute.  One side is exploded into the bins its
    tolerance window covers, the other keeps its own bin.  The test is
    symmetric, so either side may explode; with two binned attributes the
    sides take turns (each row explodes at most 3x, not 3x3 on one side)."""
    lu, _ = value_units(F.col(lcol), dtype)
    ru, _ = value_units(F.col(rcol), dtype)
    (l_own, l_reach), (r_own, r_reach) = ratio_bins(lu, *tol), ratio_bins(ru, *tol)
    if explode_left:
        return (left.withColumn(f"l_{name}", F.explode(l_reach)),
                right.withColumn(f"r_{name}", r_own))
    return (left.withColumn(f"l_{name}", l_own),
            right.withColumn(f"r_{name}", F.explode(r_reach)))
