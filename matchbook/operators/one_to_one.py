"""1:1 matching: greedy best pairs inside hard-key buckets.

Plan: project each population to (row id, key values, attribute values) ->
inner equi-join on the hard keys (plus a value bin or a q-gram when the keys are
coarse, see ``band`` and ``containment``) -> WITHIN / CONTAINS residual filters -> weighted score ->
quality floor -> best right per left row -> best left per right row among
those survivors.  The greedy step is one-shot: a left row whose best right
went to another left is not retried in the same pass (it stays available to
later passes).  Ties are broken by the lowest row id.
A pass with ``assignment="optimal"`` takes the pairs of the largest total quality
instead (see ``assignment``).

Scores depend on key and attribute values only and ties go to the lowest id, so
of rows that agree in all of them only the lowest id can be in a pair: each
side is first reduced to one row per combination of values, and a hot account
full of equal rows joins as one row instead of all against all.

Where a row may be in both populations, mirrored pairs count once and a pair
is accepted if it is the best one of both its rows in either role (quality,
then lowest ids), so no row is in two pairs.

Both "best per" steps are ``row_number() = 1`` windows; Catalyst plans them
with a partial ``WindowGroupLimit`` before the shuffle, so only the local top
candidate per key crosses the network.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.predicates import (attr_expr, contains_predicate, population_predicate,
                                            within_predicate)
from matchbook.functions.scores import pass_score
from matchbook.operators import assignment, band, containment
from matchbook.operators.populations import surely_disjoint
from matchbook.spec import MatchPass, SpecError


def project_side(df: DataFrame, p: MatchPass, side: str, **more: Column) -> DataFrame:
    """Row id, hard-key values and attribute values of one population, and ``more``.

    Only these columns travel through the join (explicit column pruning on
    top of what Catalyst prunes from the scan)."""
    left = side == "l"
    known = df.columns
    cols = [F.col("row_id").alias(f"{side}_id")]
    for i, (lk, rk) in enumerate(p.hard_keys()):
        cols.append(attr_expr(lk if left else rk, known).alias(f"{side}_k{i}"))
    for i, a in enumerate(p.attributes):
        if key_of(p, i) is None:
            cols.append(attr_expr(a.left if left else a.right, known).alias(f"{side}_a{i}"))
    return df.select(*cols, *(c.alias(f"{side}_{name}") for name, c in more.items()))


def key_of(p: MatchPass, i: int) -> int | None:
    """The hard key that attribute ``i`` is, if any: its values travel once, as the key's."""
    a = p.attributes[i]
    pair = (a.left, a.right)
    return p.hard_keys().index(pair) if a.operator == "EQUALS" and pair in p.hard_keys() else None


def _value(p: MatchPass, side: str, i: int) -> Column:
    k = key_of(p, i)
    return F.col(f"{side}_a{i}" if k is None else f"{side}_k{k}")


def lowest_of_equals(rows: DataFrame, side: str) -> DataFrame:
    """The lowest id of each combination of key and attribute values."""
    values = [c for c in rows.columns if c != f"{side}_id"]
    return rows.groupBy(values).agg(F.min(f"{side}_id").alias(f"{side}_id"))


def score_only(p: MatchPass) -> list[int]:
    """The EQUALS attributes that add to the score but are no join keys."""
    return [i for i, a in enumerate(p.attributes) if a.operator == "EQUALS"
            and a.aggregation is None and (a.left, a.right) not in p.hard_keys()]


def _scored(L: DataFrame, R: DataFrame, p: MatchPass, equal: tuple[int, ...] = ()) -> DataFrame:
    """Scored pairs of projected sides at or above the floor; the attributes ``equal`` are
    join keys as well."""
    n_keys = len(p.hard_keys())
    cond = [F.col(f"l_k{i}") == F.col(f"r_k{i}") for i in range(n_keys)]
    cond += [F.col(f"l_a{i}") == F.col(f"r_a{i}") for i in equal]
    types = [L.select(_value(p, "l", i)).schema[0].dataType for i in range(len(p.attributes))]
    within = next((i for i, a in enumerate(p.attributes) if a.operator == "CONTAINS"), None)
    for k, (i, t) in enumerate(band.pick_bands(p, types)):
        # Left rows stand under each of their grams already, right rows under one.
        L, R = band.add_bins(L, R, f"l_a{i}", f"r_a{i}", types[i], t, f"bin{i}",
                             explode_left=(within is None and k % 2 == 0))
        cond.append(F.col(f"l_bin{i}") == F.col(f"r_bin{i}"))
    if within is not None and band.coarse(p):
        L, R = containment.add_grams(L, R, f"l_a{within}", f"r_a{within}", "gram")
        cond.append(F.col("l_gram") == F.col("r_gram"))
    residual = [F.col("l_id") != F.col("r_id")]
    if "l_both" in L.columns:                   # the mirrored pair is there as well
        residual.append(~(F.col("l_both") & F.col("r_both")) | (F.col("l_id") < F.col("r_id")))
    for i, a in enumerate(p.attributes):
        lc, rc = F.col(f"l_a{i}"), F.col(f"r_a{i}")
        if a.operator == "WITHIN":
            residual.append(within_predicate(a, lc, rc))
        elif a.operator == "CONTAINS":
            residual.append(contains_predicate(lc, rc))
    cand = L.join(R, cond, "inner").where(reduce(lambda x, y: x & y, residual))
    q = pass_score(p, [_value(p, "l", i) for i in range(len(p.attributes))],
                   [_value(p, "r", i) for i in range(len(p.attributes))])
    return cand.select("l_id", "r_id", q.alias("q")).where(F.col("q") >= F.lit(p.quality))


def candidates(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """All scored candidate pairs (l_id, r_id, q) at or above the pass floor."""
    return _scored(project_side(left, p, "l"), project_side(right, p, "r"), p)


def best_candidates(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """The candidates that can be chosen: those between the lowest ids of equal rows.

    Where attributes only add to the score (a reference that is no key), a left row's best
    partner agrees with it in some of them.  For each such set of attributes an equi-join on
    the keys and these finds the lowest id of the right rows that agree so far, whatever their
    other score-only values (null there, so they add nothing; a row that agrees in more is
    found with its full score by the join on more).  So each join sees one right row for each
    combination of the values that count, and grows with the rows; there are 2**k joins for
    k such attributes."""
    L = lowest_of_equals(project_side(left, p, "l"), "l")
    R = lowest_of_equals(project_side(right, p, "r"), "r")
    extra = score_only(p)
    joins = []
    for size in range(len(extra), -1, -1):
        for agree in combinations(extra, size):
            others = [f"r_a{i}" for i in extra if i not in agree]
            reduced = lowest_of_equals(R.drop(*others), "r") if others else R
            for name in others:
                reduced = reduced.withColumn(name, F.lit(None).cast(R.schema[name].dataType))
            joins.append(_scored(L, reduced, p, agree))
    return reduce(DataFrame.unionByName, joins)


def greedy_pairs(cands: DataFrame) -> DataFrame:
    """Best right per left (q desc, r_id asc), then best left per right
    (q desc, l_id asc) among those."""
    w1 = Window.partitionBy("l_id").orderBy(F.desc("q"), F.asc("r_id"))
    best_r = cands.withColumn("_rn", F.row_number().over(w1)).where("_rn = 1").drop("_rn")
    w2 = Window.partitionBy("r_id").orderBy(F.desc("q"), F.asc("l_id"))
    return best_r.withColumn("_rn", F.row_number().over(w2)).where("_rn = 1").drop("_rn")


def mirrors(left: DataFrame, right: DataFrame, p: MatchPass) -> bool:
    """Whether a pair and its mirrored one have the same quality, and the filters tell of each
    row whether it is in the other population too."""
    alike = all(a.left == a.right and a.operator in ("EQUALS", "WITHIN") and not a.tolerance_percent
                for a in p.attributes) and all(lk == rk for lk, rk in p.hard_keys())
    return alike and {f.attribute for f in p.left} <= set(right.columns) \
        and {f.attribute for f in p.right} <= set(left.columns)


def best_once(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """The best pair of each left row, of mirrored pairs the one with the lower id on the left,
    where they are alike (``mirrors``).  What a pair loses to is seen where the pair is made, and
    the best of a row is a partial aggregate, so pairs are neither sorted nor sent."""
    other = lambda df, filters: F.coalesce(population_predicate(df, filters), F.lit(False))
    cands = _scored(project_side(left, p, "l", both=other(left, p.right)),
                    project_side(right, p, "r", both=other(right, p.left)), p)
    # Quality, then the lower right id, as one number: aggregated by hash, unlike a struct.
    unit = F.lit(Decimal(10 ** 20)).cast("decimal(21,0)")
    whole = F.col("q").cast("decimal(3,0)") * unit
    best = cands.groupBy("l_id").agg(F.max(whole - F.col("r_id").cast("decimal(20,0)")).alias("best"))
    q = F.floor((F.col("best") + F.lit(Decimal(5 * 10 ** 19)).cast("decimal(21,0)")) / unit).cast("bigint")
    return best.withColumn("q", q).select("l_id", (whole - F.col("best")).cast("bigint").alias("r_id"), "q")


def one_pair_per_row(pairs: DataFrame) -> DataFrame:
    """Pairs that are the best of both their rows, whichever side these are on."""
    low, high = F.least("l_id", "r_id"), F.greatest("l_id", "r_id")
    roles = pairs.select("l_id", "r_id", "q", F.explode(F.array("l_id", "r_id")).alias("row"))
    best = Window.partitionBy("row").orderBy(F.desc("q"), low, high, "l_id")
    won = roles.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    return (won.groupBy("l_id", "r_id", "q").agg(F.count(F.lit(1)).alias("_n"))
            .where("_n = 2").drop("_n"))


def best_pairs(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """The accepted pairs (l_id, r_id, q) of a pass."""
    if p.assignment == "optimal":
        if not surely_disjoint(p):
            raise SpecError(f"pass {p.id!r}: an optimal assignment needs populations whose filters "
                            "exclude each other")
        return assignment.optimal_pairs(candidates(left, right, p))
    if surely_disjoint(p):
        return greedy_pairs(best_candidates(left, right, p))
    if mirrors(left, right, p):
        return one_pair_per_row(greedy_pairs(best_once(left, right, p)))
    # A mirrored pair keeps its better orientation, at equal quality the one with the
    # lower id on the left.
    both = candidates(left, right, p)
    once = Window.partitionBy(F.least("l_id", "r_id"), F.greatest("l_id", "r_id")) \
        .orderBy(F.desc("q"), "l_id")
    both = both.withColumn("_rn", F.row_number().over(once)).where("_rn = 1").drop("_rn")
    return one_pair_per_row(greedy_pairs(both))


def groups(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """One row per accepted pair with the id order (quality desc, right id asc)."""
    pairs = best_pairs(left, right, p)
    return pairs.select("l_id", "r_id", "q", (-F.col("q")).alias("_o1"),
                        F.col("r_id").alias("_o2"))


def members(pairs: DataFrame) -> DataFrame:
    """Member rows of each pair: (row_id, q, _o1, _o2, _lead); the right row
    leads (it carries the id order key)."""
    m = F.explode(F.array(F.struct(F.col("l_id").alias("row_id"), F.lit(False).alias("_lead")),
                          F.struct(F.col("r_id").alias("row_id"), F.lit(True).alias("_lead"))))
    return pairs.select(m.alias("m"), "q", "_o1", "_o2").select("m.*", "q", "_o1", "_o2")
