"""Best total assignment of 1:1 candidates, for passes with ``assignment="optimal"``.

The greedy choice can leave a row without a partner, or with a worse one, where another
choice of pairs has a larger total.  Here the pairs of a pass maximise the sum of their
qualities, and then their number.

* Pairs whose rows have no other candidate are accepted as they are.  The others are split
  into connected components, which are independent of each other.
* A component is solved by an auction.  Persons bid for objects, a bid raises an object's price
  so far that the bidder would take its second choice otherwise, and the highest bid gets it.
  Every row also has a private partner that stands for staying alone, which makes all sides
  equal, so prices may be carried through smaller and smaller bid steps.
* Benefits are whole numbers, multiplied by more than the number of persons, and the last
  step is 1.  When everyone has an object, each is within 1 of its best at the final prices,
  so the total is within less than one unit of the best: it is the best.  The prices prove
  it (``prices`` returns them).
* Components of up to ``IN_TASK`` candidates are solved in tasks, a component at a time;
  larger ones by rounds of joins over all of them together, with the state written between.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.session import materialize

IN_TASK = 20_000                 # candidates of a component that a task solves
STEP = 5                         # a bid step is that much smaller than the one before


# -------------------------------------------------------------------- components

def components(pairs: DataFrame) -> DataFrame:
    """``pairs`` (l_id, r_id, q) with ``c``: the smallest left id reachable from the pair."""
    label = materialize(pairs.groupBy("l_id").agg(F.min("l_id").alias("c")), "assign-labels")
    while True:
        by_right = (pairs.join(label, "l_id").groupBy("r_id").agg(F.min("c").alias("low")))
        near = pairs.join(by_right, "r_id").groupBy("l_id").agg(F.min("low").alias("low"))
        # Twice as far each time: the label of the label.
        far = label.select(F.col("l_id").alias("low"), F.col("c").alias("lower"))
        new = materialize(label.join(near, "l_id").join(far, "low")
                          .select("l_id", F.least("c", "low", "lower").alias("c")), "assign-labels")
        if new.join(label, ["l_id", "c"], "left_anti").isEmpty():
            return pairs.join(new, "l_id")
        label = new


# ----------------------------------------------------------------- inside a task

def balanced(pairs: list[tuple[int, int, int]]) -> tuple[dict, int]:
    """({person: {object: benefit}}, number of persons).  Persons are left rows ("l", id) and
    the alone of right rows ("a", id); objects right rows ("r", id) and the alone of left rows
    ("b", id)."""
    lefts, rights = {p[0] for p in pairs}, {p[1] for p in pairs}
    n = len(lefts) + len(rights)
    wish: dict = {("l", i): {("b", i): 0} for i in sorted(lefts)}
    wish |= {("a", j): {("r", j): 0} for j in sorted(rights)}
    for i, j, q in sorted(pairs):
        wish["l", i]["r", j] = (q * (n + 1) + 1) * (n + 1)
        wish["a", j]["b", i] = 0
    return wish, n


def auction(wish: dict) -> tuple[dict, dict]:
    """(object of each person, price of each object) of a balanced problem."""
    price = {o: 0 for options in wish.values() for o in options}
    step = max((b for options in wish.values() for b in options.values()), default=0) // 2
    while True:
        step = max(1, step // STEP)
        owner: dict = {}
        waiting = list(reversed(wish))
        while waiting:
            person = waiting.pop()
            ranked = sorted(((b - price[o], o) for o, b in wish[person].items()),
                            key=lambda x: (-x[0], x[1]))
            (first, o), (second, _) = ranked[:2]
            price[o] += first - second + step
            if o in owner:
                waiting.append(owner[o])
            owner[o] = person
        if step == 1:
            return {p: o for o, p in owner.items()}, price


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, rows in batch.groupby("c"):
            pairs = [(int(p["l"]), int(p["r"]), int(p["q"])) for p in rows["pairs"].iloc[0]]
            taken, _ = auction(balanced(pairs)[0])
            kept = [(i, j, q) for i, j, q in pairs if taken["l", i] == ("r", j)]
            yield pd.DataFrame(kept, columns=["l_id", "r_id", "q"]).astype("int64")


# ------------------------------------------------------------------ over all tasks

def by_rounds(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen pairs, prices: object, price) of large components (l_id, r_id, q), by rounds."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n = pairs.select("l_id").distinct().count() + pairs.select("r_id").distinct().count()
    zero = F.lit(0).cast("long").alias("b")
    wish = materialize(reduce(DataFrame.unionByName, [
        pairs.select(node("l", "l_id").alias("person"), node("r", "r_id").alias("object"),
                     ((F.col("q") * (n + 1) + 1) * (n + 1)).cast("long").alias("b")),
        pairs.select(node("a", "r_id").alias("person"), node("b", "l_id").alias("object"), zero),
        pairs.select(node("l", "l_id").alias("person"), node("b", "l_id").alias("object"), zero).distinct(),
        pairs.select(node("a", "r_id").alias("person"), node("r", "r_id").alias("object"), zero).distinct()]),
        "assign-wishes")
    none = F.lit(None).cast("string").alias("owner")
    state = materialize(wish.select("object").distinct().select(
        "object", F.lit(0).cast("long").alias("price"), none), "assign-prices")
    step = (wish.agg(F.max("b")).first()[0] or 0) // 2
    while True:
        step = max(1, step // STEP)
        state = state.select("object", "price", none)
        while True:
            free = wish.join(state.select(F.col("owner").alias("person")).where("person IS NOT NULL"),
                             "person", "left_anti")
            value = F.col("b") - F.col("price")
            order = Window.partitionBy("person").orderBy(F.desc("value"), "object")
            two = (free.join(state.select("object", "price"), "object").withColumn("value", value)
                   .withColumn("k", F.row_number().over(order)).where("k <= 2"))
            bids = two.groupBy("person").agg(
                F.max(F.when(F.col("k") == 1, F.col("object"))).alias("object"),
                F.max(F.when(F.col("k") == 1, F.col("price"))).alias("was"),
                (F.max("value") - F.min("value")).alias("gap"))
            best = bids.groupBy("object").agg(F.min(F.struct(
                (-(F.col("was") + F.col("gap") + step)).alias("bid"), "person")).alias("w"))
            best = materialize(best, "assign-bids")
            if best.isEmpty():
                break
            state = materialize(state.join(best, "object", "left").select(
                "object", F.coalesce(-F.col("w.bid"), "price").alias("price"),
                F.coalesce("w.person", "owner").alias("owner")), "assign-prices")
        if step == 1:
            break
    won = state.select(F.col("owner").alias("person"), "object")
    chosen = pairs.withColumn("person", node("l", "l_id")).withColumn("object", node("r", "r_id")) \
        .join(won, ["person", "object"], "left_semi").select("l_id", "r_id", "q")
    return chosen, state.select("object", "price")


def optimal_pairs(candidates: DataFrame, in_task: int | None = None) -> DataFrame:
    """The pairs (l_id, r_id, q) of the largest total quality, and of these the most."""
    in_task = IN_TASK if in_task is None else in_task
    pairs = materialize(candidates.select("l_id", "r_id", F.col("q").cast("long").alias("q")), "assign-pairs")
    rivals = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    pairs = materialize(pairs.join(rivals("l_id"), "l_id").join(rivals("r_id"), "r_id"), "assign-rivals")
    alone = (F.col("n_l_id") == 1) & (F.col("n_r_id") == 1)
    out = pairs.where(alone).select("l_id", "r_id", "q")
    disputed = pairs.where(~alone).select("l_id", "r_id", "q")
    if disputed.isEmpty():
        return out
    parts = materialize(components(disputed), "assign-components")
    sizes = materialize(parts.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "assign-sizes")
    small = (parts.join(sizes.where(F.col("n") <= in_task), "c").groupBy("c")
             .agg(F.collect_list(F.struct(F.col("l_id").alias("l"), F.col("r_id").alias("r"), "q")).alias("pairs")))
    out = out.unionByName(small.mapInPandas(_solve, "l_id long, r_id long, q long"))
    large = parts.join(sizes.where(F.col("n") > in_task).select("c"), "c", "left_semi")
    if not large.isEmpty():
        out = out.unionByName(by_rounds(materialize(large, "assign-large"))[0])
    return out
