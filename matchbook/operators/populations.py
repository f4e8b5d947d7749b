"""Population selection for one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame

from matchbook.functions.predicates import population_predicate
from matchbook.spec import MatchPass, SpecError


def select_population(df: DataFrame, filters) -> DataFrame:
    """Rows satisfying every filter (AND); no filters selects all rows."""
    return df.where(population_predicate(df, filters))


def surely_disjoint(p: MatchPass) -> bool:
    """Whether the filters alone show that no row is in both populations: they ask for
    different values of one column."""
    def wanted(filters) -> dict[str, set]:
        out: dict[str, set] = {}
        for f in filters:
            if f.operator in ("=", "IN"):
                values = {f.value} if f.operator == "=" else set(f.value)
                out[f.attribute] = out.get(f.attribute, values) & values
        return out
    left, right = wanted(p.left), wanted(p.right)
    return any(not left[c] & right[c] for c in left.keys() & right.keys())


def pass_populations(df: DataFrame, p: MatchPass) -> tuple[DataFrame, DataFrame]:
    """(left, right) populations of a pass.

    A row may qualify for both sides.  The 1:1 matcher handles that (no row pairs with
    itself or enters two pairs); the others total rows of one side, where such a row
    would count on both, so a pass of theirs whose populations overlap is refused.
    """
    lp, rp = population_predicate(df, p.left), population_predicate(df, p.right)
    if p.match_type != "ONE_TO_ONE" and not surely_disjoint(p) \
            and not df.where(lp & rp).isEmpty():
        raise SpecError(f"pass {p.id!r}: rows are in both populations, which only a 1:1 pass "
                        "allows")
    return df.where(lp), df.where(rp)
