"""Best subset pair of buckets that are too large to enumerate.

Meet in the middle: both sides grow partial sums of 2, 3, ... rows, and the sums of the two
sides meet in a band join, smallest groups first.

* A partial sum is (bucket, highest id, sum, first and last day).  Of all subsets that agree
  in these only the one with the larger ids can be in a chosen pair, whatever is added
  later (rows are added in the order of their ids), so one row stands for them.  Equal
  amounts therefore do not multiply.
* A side grows by joining its sums with the bucket's rows of higher id within the days the
  pass allows, an equi-join on bucket and day bin that adaptive execution can split.
* With the sums of up to a rows at hand, a bucket whose best pair has quality 100 and at most
  a + 2 rows is settled, since any pair not yet seen has more; the sums of another grow on.
  The search ends when all are settled or have no more sums, so no bucket is left out: the
  work of one without an exact pair is bounded by its subsets (or by its distinct sums and
  days, where those are fewer).  Sums that stay few grow to their end before they meet.
* Where all amounts are positive, sums beyond the other side's total of the days in reach
  cannot be met and are dropped with all that grows from them; so are rows with fewer than
  two rows of the other side in reach.
* Equal rows (amount, day) are a class: of those a subset takes so many of the highest ids, so it
  is a number for each class.  Buckets whose numbers can be combined in at most ``LISTED`` ways
  are listed to their end a class at a time (``_listed``), so copies of a row without an exact
  partner cost one step and not one for each copy.
* Before that, buckets with a pair of two and two rows of quality 100 are settled from their
  earliest date windows (``_two_and_two``): any other pair is worse, has more rows or lies in
  a later window.  Most large buckets have one, and then only the windows up to it are read.

The choice is that of the enumeration: quality, fewer rows, the earlier date window, the
larger left ids (as a mask compares them), the larger right ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.scores import subset_quality
from matchbook.operators.band import floor_div, ratio_bins
from matchbook.session import materialize
from matchbook.spec import MatchPass

WHOLE = 1 - 2**31                 # window number of a pass without dates
AT_ONCE = 100_000                # expected sums up to which a side grows on before they meet
TRIED = 32                       # left rows of a first window whose pairs are tried one by one
MORE_WINDOWS = 4                 # so many times the windows in each step over the date windows
LISTED = 2**20                   # combinations up to which all sums of a bucket are listed
PERFECT = 0.0251                 # share of the tolerance within which the quality rounds to 100


def _day_bin(day, t: int):
    return floor_div(day.cast("bigint"), t + 1)


def _start(rows: DataFrame, kn: list[str]) -> DataFrame:
    return rows.select(*kn, "side", "cap", F.col("id").alias("hi"), F.array("id").alias("ids"),
                       F.col("u").alias("s"), F.col("day").alias("dmin"), F.col("day").alias("dmax"))


def _grow(level: DataFrame, rows: DataFrame, kn: list[str], t: int) -> DataFrame:
    """Sums of both sides with one more row of their side, of higher id."""
    spread = level.withColumn("bin", F.explode(F.sequence(
        _day_bin(F.col("dmax") - t, t), _day_bin(F.col("dmin") + t, t))))
    more = rows.select(*kn, "side", F.col("id").alias("new"), "u", "day", F.col("cap").alias("limit"),
                       _day_bin(F.col("day"), t).alias("bin"))
    grown = (spread.join(more, kn + ["side", "bin"])
             .where((F.col("new") > F.col("hi")) & (F.col("day") >= F.col("dmax") - t)
                    & (F.col("day") <= F.col("dmin") + t))
             .select(*kn, "side", F.least("cap", "limit").alias("cap"), F.col("new").alias("hi"),
                     F.concat(F.array("new"), "ids").alias("ids"), (F.col("s") + F.col("u")).alias("s"),
                     F.least("dmin", "day").alias("dmin"), F.greatest("dmax", "day").alias("dmax"))
             .where(F.col("cap").isNull() | (F.col("s") <= F.col("cap"))))
    return grown.groupBy(*kn, "side", "hi", "s", "dmin", "dmax").agg(
        F.max("cap").alias("cap"), F.max("ids").alias("ids"))


def _reduced(level: DataFrame, side: str, kn: list[str]) -> DataFrame:
    return (level.where(F.col("side") == side).groupBy(*kn, "rows", "s", "dmin", "dmax")
            .agg(F.max("ids").alias(f"{side}_ids"))
            .select(*kn, "rows", F.col("s").alias(f"{side}_sum"), F.col("dmin").alias(f"{side}_dmin"),
                    F.col("dmax").alias(f"{side}_dmax"), f"{side}_ids"))


def _tolerances(p: MatchPass) -> tuple[float, float]:
    amt = p.amount_attribute()
    return float(amt.tolerance_amount or 0.0), float(amt.tolerance_percent or 0.0)


def _agreement(l_units, r_units, p: MatchPass, scale: int):
    """(whether two sums are within the tolerance, their quality)."""
    tol_abs, tol_pct = _tolerances(p)
    div = F.lit(float(10 ** scale))
    l_sum, r_sum = l_units.cast("double") / div, r_units.cast("double") / div
    tol, delta = F.greatest(F.lit(tol_abs), F.abs(l_sum) * F.lit(tol_pct)), F.abs(l_sum - r_sum)
    return delta <= tol, subset_quality(delta, tol)


def _meet(left: DataFrame, right: DataFrame, known: int, kn: list[str], p: MatchPass, scale: int,
          t: int, floor: int | None = None) -> DataFrame:
    """(keys, dmax, q, fewer, l_ids, r_ids) of the sums that meet within the tolerance and the
    days, but for those of up to ``known`` rows on both sides, which have met before.  With a
    ``floor`` of 100 they meet in the narrower bins of that quality."""
    tol_abs, tol_pct = _tolerances(p)
    floor = p.quality if floor is None else floor
    share = PERFECT if floor == 100 else 1.0
    own, reach = ratio_bins(F.col("l_sum"), share * tol_abs * 10 ** scale, share * tol_pct), \
        ratio_bins(F.col("r_sum"), share * tol_abs * 10 ** scale, share * tol_pct)
    left = left.withColumn("bin", F.explode(own[1]))
    right = right.withColumn("bin", reach[0]).withColumnRenamed("rows", "r_rows")
    agree, q = _agreement(F.col("l_sum"), F.col("r_sum"), p, scale)
    last = F.greatest("l_dmax", "r_dmax")
    return (left.join(right, kn + ["bin"])
            .where((F.greatest("rows", "r_rows") > known) & agree & (last - F.least("l_dmin", "r_dmin") <= t))
            .select(*kn, last.alias("dmax"), q.alias("q"),
                    (-F.col("rows") - F.col("r_rows")).alias("fewer"), "l_ids", "r_ids")
            .where(F.col("q") >= F.lit(floor)))


def _within(rows: DataFrame, kn: list[str], before: int, after: int) -> DataFrame:
    """Per bucket and day: rows and total of each side from ``before`` days earlier to ``after``
    days later (n_l, n_r, t_l, t_r).  The days of a bucket are few, whatever its rows."""
    on = lambda s, c: F.when(F.col("side") == s, c)
    days = rows.groupBy(*kn, "day").agg(
        F.count(on("l", F.lit(1))).alias("n_l"), F.count(on("r", F.lit(1))).alias("n_r"),
        F.sum(on("l", F.col("u").cast("double"))).alias("t_l"),
        F.sum(on("r", F.col("u").cast("double"))).alias("t_r"))
    near = Window.partitionBy(*kn).orderBy("day").rangeBetween(-before, after)
    return days.select(*kn, "day", *[F.sum(c).over(near).alias(c) for c in ("n_l", "n_r", "t_l", "t_r")])


def _caps(rows: DataFrame, kn: list[str], p: MatchPass, scale: int, t: int) -> DataFrame:
    """The rows that a pair can have, with the largest sum of their side that the other side
    could meet within the days of the row."""
    tol_abs, pct = _tolerances(p)
    slack = F.lit(tol_abs * 10 ** scale)
    cap = F.when(F.col("side") == "r", F.col("t_l") * (1 + pct) + slack)
    if pct < 1:
        cap = cap.otherwise((F.col("t_r") + slack) / (1 - pct))
    low = rows.groupBy(kn).agg(F.min("u").alias("low"))
    return (rows.join(low, kn).join(_within(rows, kn, t, t), kn + ["day"])
            .where("n_l >= 2 AND n_r >= 2")
            .withColumn("cap", F.when(F.col("low") > 0, F.ceil(cap * 1.000001)).cast("bigint"))
            .where(F.col("cap").isNull() | (F.col("u") <= F.col("cap")))
            .select(*kn, "id", "u", "day", "side", "cap"))


def _days(rows: DataFrame, kn: list[str]) -> DataFrame:
    return rows.groupBy(kn).agg(F.collect_set("day").alias("days"))      # bounded by the calendar


def _window(days: DataFrame, found: DataFrame, kn: list[str], t: int, dated: bool) -> DataFrame:
    """``found`` with the first day of the earliest date window that holds the pair."""
    if not dated:
        return found.withColumn("win", F.lit(WHOLE))
    return found.join(days, kn).withColumn("win", F.array_min(F.filter(
        "days", lambda d: d >= F.col("dmax") - t))).drop("days")


def _tried(first: DataFrame, rows: DataFrame, kn: list[str], p: MatchPass, scale: int) -> DataFrame:
    """(keys, l_ids, r_ids) of the best pair of quality 100 in the first date window of large
    buckets among those with the window's highest left id and one of the next ``TRIED``.  They
    come first of all pairs of the window, so the best of them is the best of the bucket; a
    right row is looked up for each of them and each other right row."""
    tol_abs, tol_pct = _tolerances(p)
    inside = materialize(rows.join(first.where(F.col("n_l") > TRIED).select(*kn, F.col("day").alias("win"), "last"), kn)
                         .where(F.col("day").between(F.col("win"), F.col("last")))
                         .select(*kn, "side", "id", "u"), f"m2m-first-{p.id}")
    order = Window.partitionBy(*kn).orderBy(F.desc("id"))
    ranked = (inside.where("side = 'l'").withColumn("k", F.dense_rank().over(order))
              .where(F.col("k") <= TRIED))
    tops = ranked.where("k = 1").select(*kn, F.col("id").alias("top"), F.col("u").alias("top_u"))
    asked = (ranked.where("k > 1").join(tops, kn)
             .select(*kn, F.array("top", "id").alias("l_ids"), (F.col("top_u") + F.col("u")).alias("s")))
    reach = F.ceil(F.greatest(F.lit(tol_abs * 10 ** scale), F.abs("s") * F.lit(tol_pct)) * PERFECT) \
        .cast("bigint")
    asked = asked.withColumn("reach", reach)
    width = asked.groupBy(kn).agg(F.max("reach").alias("w")).withColumn("w", F.greatest("w", F.lit(1).cast("bigint")))
    given = (inside.where("side = 'r'").join(width, kn)
             .select(*kn, F.col("id").alias("low"), F.col("u").alias("low_u"),
                     floor_div(F.col("u"), F.col("w")).alias("bin")))
    need = F.col("s") - F.col("u")
    asked = (asked.join(width, kn).join(inside.where("side = 'r'").drop("side"), kn)
             .select(*kn, "l_ids", "s", "id", "u", F.explode(F.sequence(
                 floor_div(need - F.col("reach"), F.col("w")),
                 floor_div(need + F.col("reach"), F.col("w")))).alias("bin")))
    agree, q = _agreement(F.col("s"), F.col("u") + F.col("low_u"), p, scale)
    return (asked.join(given, kn + ["bin"]).where((F.col("low") < F.col("id")) & agree & (q == 100))
            .groupBy(kn).agg(F.max(F.struct("l_ids", F.array("id", "low").alias("r_ids"))).alias("c"))
            .select(*kn, "c.*"))


def _two_and_two(rows: DataFrame, days: DataFrame, kn: list[str], p: MatchPass, scale: int, t: int,
                 dated: bool) -> tuple[DataFrame, DataFrame]:
    """(choice of the buckets that have a pair of two and two rows of quality 100: keys, c; the
    other buckets that can have a pair).

    Such a pair is the choice if no earlier date window has one.  So the windows with rows
    enough are taken in their order, more at each step, until a bucket has one in them."""
    order = Window.partitionBy(*kn).orderBy("day")
    wins = materialize(_within(rows, kn, 0, t).where("n_l >= 2 AND n_r >= 2")
                       .select(*kn, "day", (F.col("day") + t).alias("last"), "n_l",
                               F.row_number().over(order).alias("k")), f"m2m-windows-{p.id}")
    choice = lambda df: df.select(*kn, F.struct(
        F.lit(100).cast("bigint").alias("q"), F.lit(-4).alias("fewer"), (-F.col("win")).alias("w"),
        "l_ids", "r_ids").alias("c"))
    last = wins.groupBy(kn).agg(F.max("k").alias("n"))
    first = wins.where("k = 1")
    found = _tried(first, rows, kn, p, scale).join(first, kn)
    best = materialize(choice(found.withColumn("win", F.col("day") if dated else F.lit(WHOLE))),
                       f"m2m-tried-{p.id}")
    open_ = materialize(last.join(best.select(kn), kn, "left_anti"), "m2m-open")
    low, high = 1, 1
    while not open_.where(F.col("n") >= low).isEmpty():
        part = (wins.where(F.col("k").between(low, high)).join(open_.select(kn), kn, "left_semi")
                .groupBy(kn).agg(F.min("day").alias("from"), F.max("last").alias("to")))
        some = materialize(rows.join(part, kn).where(F.col("day").between(F.col("from"), F.col("to")))
                           .select(*kn, "id", "u", "day", "side"), f"m2m-part-{p.id}")
        some = _caps(some, kn, p, scale, t)
        twos = materialize(_grow(_start(some, kn), some, kn, t).withColumn("rows", F.lit(2)), f"m2m-twos-{p.id}")
        pairs = _meet(_reduced(twos, "l", kn), _reduced(twos, "r", kn), 1, kn, p, scale, t, 100)
        pairs = (pairs.groupBy(*kn, "dmax").agg(F.max(F.struct("l_ids", "r_ids")).alias("pair"))
                 .select(*kn, "dmax", "pair.*"))
        best = materialize(best.unionByName(choice(_window(days, pairs, kn, t, dated))
                                            .groupBy(kn).agg(F.max("c").alias("c"))), f"m2m-found-{p.id}")
        open_ = materialize(open_.join(best.select(kn), kn, "left_anti"), "m2m-open")
        low, high = high + 1, high * (1 + MORE_WINDOWS)
    return best, open_.select(kn)


def _few(rows: DataFrame, kn: list[str], t: int) -> DataFrame:
    """The buckets with at most ``LISTED`` combinations of numbers of equal rows in reach.  One
    in which an id repeats is not among them: an id counts once in a sum, whatever its class."""
    classes = rows.groupBy(*kn, "side", "day", "u").agg(F.count(F.lit(1)).alias("m"))
    days = classes.groupBy(*kn, "side", "day").agg(F.sum(F.log2(F.col("m") + 1.0)).alias("bits"))
    near = Window.partitionBy(*kn, "side").orderBy("day").rangeBetween(0, t)
    twice = rows.groupBy(*kn, "side", "id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(kn)
    return (days.withColumn("bits", F.sum("bits").over(near)).groupBy(kn)
            .agg(F.sum(F.pow(F.lit(2.0), F.least("bits", F.lit(64.0)))).alias("ways"))
            .where(F.col("ways") <= LISTED).select(kn).join(twice, kn, "left_anti"))


def _listed(rows: DataFrame, kn: list[str], t: int, tag: str) -> DataFrame:
    """All sums of two or more rows of both sides, a class of equal rows at a time."""
    classes = materialize(rows.groupBy(*kn, "side", "day", "u").agg(
        F.sort_array(F.collect_list("id"), False).alias("same"), F.min("cap").alias("limit"))
        .withColumn("top", F.col("same")[0]), f"m2m-classes-{tag}")
    number = F.explode(F.sequence(F.lit(1), F.size("same"))).alias("i")
    fits = F.col("cap").isNull() | (F.col("s") <= F.col("cap"))
    chosen = F.slice("same", F.lit(1), F.col("i"))
    level = materialize(
        classes.select("*", number).select(
            *kn, "side", F.col("limit").alias("cap"), F.col("top").alias("hi"), chosen.alias("ids"),
            (F.col("u") * F.col("i")).alias("s"), F.col("day").alias("dmin"), F.col("day").alias("dmax"),
            F.col("i").alias("rows")).where(fits), f"m2m-listed-{tag}")
    levels = [level]
    more = classes.withColumn("bin", _day_bin(F.col("day"), t))
    while not level.isEmpty():
        spread = level.withColumn("bin", F.explode(F.sequence(
            _day_bin(F.col("dmax") - t, t), _day_bin(F.col("dmin") + t, t))))
        grown = (spread.join(more, kn + ["side", "bin"])
                 .where((F.col("top") > F.col("hi")) & (F.col("day") >= F.col("dmax") - t)
                        & (F.col("day") <= F.col("dmin") + t)).select("*", number)
                 .select(*kn, "side", F.least("cap", "limit").alias("cap"), F.col("top").alias("hi"),
                         F.sort_array(F.concat("ids", chosen), False).alias("ids"),
                         (F.col("s") + F.col("u") * F.col("i")).alias("s"),
                         F.least("dmin", "day").alias("dmin"), F.greatest("dmax", "day").alias("dmax"),
                         (F.col("rows") + F.col("i")).alias("rows")).where(fits))
        level = materialize(grown.groupBy(*kn, "side", "hi", "s", "dmin", "dmax", "rows").agg(
            F.max("cap").alias("cap"), F.max("ids").alias("ids")), f"m2m-listed-{tag}")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).where("rows >= 2")


def _choices(pairs: DataFrame, days: DataFrame, kn: list[str], t: int, dated: bool) -> DataFrame:
    """The best of the pairs that met, by bucket and last day, as choices (keys, c)."""
    pairs = (pairs.groupBy(*kn, "dmax")
             .agg(F.max(F.struct("q", "fewer", "l_ids", "r_ids")).alias("pair"))
             .select(*kn, "dmax", "pair.*"))
    return _window(days, pairs, kn, t, dated).select(
        *kn, F.struct("q", "fewer", (-F.col("win")).alias("w"), "l_ids", "r_ids").alias("c"))


def search(both: DataFrame, large: DataFrame, kn: list[str], p: MatchPass,
           scale: int) -> tuple[DataFrame, DataFrame]:
    """(best pair of each large bucket: keys, l_ids, r_ids (ascending), q, win, l_min_id;
    the buckets that were searched to their end)."""
    dated = p.date_attribute() is not None
    t = int(p.date_attribute().tolerance_days) if dated else 0
    whole = materialize(both.join(large.select(kn), kn, "left_semi"), f"m2m-large-{p.id}")
    days = materialize(_days(whole, kn), f"m2m-days-{p.id}")
    best, open_ = _two_and_two(whole, days, kn, p, scale, t, dated)
    rows = materialize(_caps(whole.join(open_, kn, "left_semi"), kn, p, scale, t), f"m2m-open-{p.id}")
    few = materialize(_few(rows, kn, t), f"m2m-few-{p.id}")
    if not few.isEmpty():
        sums = _listed(rows.join(few, kn, "left_semi"), kn, t, p.id)
        pairs = _meet(_reduced(sums, "l", kn), _reduced(sums, "r", kn), 1, kn, p, scale, t)
        best = materialize(_choices(pairs, days, kn, t, dated).unionByName(best).groupBy(kn)
                           .agg(F.max("c").alias("c")), f"m2m-found-{p.id}")
        open_ = materialize(open_.join(few, kn, "left_anti"), "m2m-open")
        rows = materialize(rows.join(few, kn, "left_anti"), f"m2m-open-{p.id}")
    start = _start(rows, kn)
    levels, sizes = [start], [rows.count()]                    # sums of 1, 2, ... rows
    met = 1
    while sizes[0]:
        while True:
            grown = materialize(_grow(levels[-1].join(open_, kn, "left_semi"), rows, kn, t),
                                f"m2m-sums-{p.id}-{len(levels) + 1}")
            levels.append(grown)
            sizes.append(grown.count())
            if not sizes[-1] or sizes[-1] ** 2 > AT_ONCE * sizes[-2]:    # the next would be large
                break
        if len(levels) > 2 or sizes[-1]:
            some = reduce(DataFrame.unionByName, [
                x.withColumn("rows", F.lit(a + 1)) for a, x in enumerate(levels) if a and sizes[a]])
            pairs = _meet(_reduced(some.join(open_, kn, "left_semi"), "l", kn),
                          _reduced(some, "r", kn), met, kn, p, scale, t)
            found = _choices(pairs, days, kn, t, dated)
            best = materialize(found.unionByName(best).groupBy(kn).agg(F.max("c").alias("c")), f"m2m-found-{p.id}")
        met = len(levels)
        if not sizes[-1]:
            break
        settled = best.where((F.col("c.q") == 100) & (-F.col("c.fewer") <= met + 2))
        open_ = materialize(open_.join(settled.select(kn), kn, "left_anti"), "m2m-open")
        if open_.isEmpty():
            break
    best = best.select(
        *kn, "c.q", (-F.col("c.w")).alias("win"), F.sort_array("c.l_ids").alias("l_ids"),
        F.sort_array("c.r_ids").alias("r_ids"))
    lowest = (whole.where("side = 'l'").join(best.select(*kn, "win"), kn)
              .where((F.col("win") == WHOLE) | F.col("day").between(F.col("win"), F.col("win") + t))
              .groupBy(kn).agg(F.min("id").alias("l_min_id")))
    return best.join(lowest, kn), large.select(kn)
