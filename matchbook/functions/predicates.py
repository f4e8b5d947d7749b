"""Column predicates: population filters and pair tolerance tests.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen and filters reach the
Parquet scan as pushed predicates where Spark can push them.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.spec import Attribute, Filter


def _typed_literal(value, dtype):
    """A config value as a literal that compares exactly with a column of ``dtype``.

    Texts become dates, timestamps or numbers.  A number that the column's type holds
    exactly takes that type, so that the filter is pushed to the scan; any other (2.5
    against a BIGINT, five places against four) stays an exact decimal and Spark widens
    the comparison."""
    if isinstance(dtype, T.StringType) or isinstance(value, bool):
        return F.lit(value).cast(dtype)
    exact = isinstance(dtype, (T.DecimalType, T.IntegralType))
    if not exact:
        return F.lit(value).cast(dtype)
    number = Decimal(str(value).strip())
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
    digits = dtype.precision - scale if isinstance(dtype, T.DecimalType) else 9
    fits = number == number.quantize(Decimal(1).scaleb(-scale)) and abs(number) < 10 ** digits
    if fits:
        return F.lit(number).cast(dtype)
    return F.lit(int(number)) if number == int(number) and abs(number) < 2 ** 63 \
        else F.expr(f"CAST('{number:f}' AS DECIMAL(38, {max(0, -number.as_tuple().exponent)}))")


def filter_predicate(df: DataFrame, f: Filter, schema=None) -> Column:
    """One population filter as a Column.  Nulls never pass (SQL 3VL)."""
    col = column(f.attribute)
    dtype = (schema or df.schema)[f.attribute].dataType
    op = f.operator
    if op == "IN":
        return col.isin([_typed_literal(v, dtype) for v in f.value])
    if op == "LIKE":
        # Backslash is literal in the config pattern but the escape
        # character in Spark's LIKE: double it.
        return col.cast("string").like(f.value.replace("\\", "\\\\"))
    lit = _typed_literal(f.value, dtype)
    return {"=": col == lit, "!=": col != lit, ">": col > lit, "<": col < lit,
            ">=": col >= lit, "<=": col <= lit}[op]


def population_predicate(df: DataFrame, filters) -> Column:
    """AND of all filters; an empty list selects every row."""
    schema = df.schema if filters else None          # one analysis, not one per filter
    return reduce(lambda a, b: a & b, [filter_predicate(df, f, schema) for f in filters],
                  F.lit(True))


def column(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def attr_expr(expr: str, columns) -> Column:
    """One of ``columns`` by name, or else a Spark SQL expression over them such as
    SUBSTRING(REFERENCE, 1, 6)."""
    return column(expr) if expr in columns else F.expr(expr)


def numeric_tolerance(attr: Attribute, base: Column) -> Column:
    """Effective tolerance max(toleranceAmount, |base| * tolerancePercent).

    tolerancePercent is a fraction (0.01 = 1 %).
    """
    tol_abs = float(attr.tolerance_amount or 0.0)
    tol_pct = float(attr.tolerance_percent or 0.0)
    if tol_pct == 0.0:
        return F.lit(tol_abs)
    return F.greatest(F.lit(tol_abs), F.abs(base.cast("double")) * F.lit(tol_pct))


def within_predicate(attr: Attribute, left: Column, right: Column) -> Column:
    """WITHIN test between two attribute values of a candidate pair."""
    if attr.is_date_band:
        return F.abs(F.datediff(left, right)) <= F.lit(attr.tolerance_days)
    delta = F.abs(left.cast("double") - right.cast("double"))
    return delta <= numeric_tolerance(attr, left)


def contains_predicate(left: Column, right: Column) -> Column:
    """Directional, literal, case-sensitive: the left value contains the right."""
    return F.contains(left.cast("string"), right.cast("string"))
