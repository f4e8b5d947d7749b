"""1:N and N:1 matching of one row against a part of its hard-key bucket.

A one-side row (target) may take any two or more rows of the many side in its bucket whose
dates all lie within the tolerance of its own and whose total agrees with its amount.  The
rows a target can take are those of its cell: bucket and target day.

* **Meet in the middle.**  A cell of up to ``IN_TASK`` rows is solved by a task (``cell_search``):
  subsets of 2, 3, ... rows meet from two parts, with those of equal rows once, until its
  targets have an exact total.  Up to ``LISTED`` rows are cut into two halves where these become
  many, so 30 rows need 2 x 32,768 sums at most and not 2**30.  Equal targets of a cell are
  asked once, and a cell's targets are dealt in slices of ``SLICE``.  Targets of more rows that
  would need more than ``ROOM`` sums are dealt once more, one by one.
* **Larger cells** grow partial sums of 2, 3, ... rows as the N:M search does (equal sums
  stand for each other), until every target of the cell has an exact total of so few rows or
  the sums end.  No cell is left out.
* Where all amounts of a cell are positive, rows and sums above its largest target are
  dropped first.

Each target proposes its best subset: quality, fewer rows, then the larger ids (as a mask
compares them).  A proposal is accepted if none of its rows is in a better one (quality,
fewer rows, lower target id), so no row is in two groups; like the 1:1 step this is done
once, and a target that lost stays open for later passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions.predicates import attr_expr, numeric_tolerance
from matchbook.functions.scores import aggregate_quality
from matchbook.operators import cell_search
from matchbook.operators.band import floor_div
from matchbook.operators.many_to_many import _scale
from matchbook.operators.subset_search import AT_ONCE, _grow, _start
from matchbook.session import materialize
from matchbook.spec import WITHIN_FLOOR, MatchPass

IN_TASK = 512                    # rows of a cell that a task solves
LISTED = 30                      # of these, rows of a cell whose halves may be listed
ROOM, ALONE = 1 << 16, 1 << 20   # sums of one number of rows that a task holds, for one target
SLICE = 256                      # targets of a cell that a task solves at once


def _side(df: DataFrame, p: MatchPass, left: bool, names: tuple[str, str, str],
          scale: int) -> DataFrame:
    """Keys, id, amount in units and day of one population; rows that lack one are left out."""
    total, dated = p.total_attribute(), p.date_attribute()
    pick = lambda a: attr_expr(a.left if left else a.right, df.columns)
    keys = [attr_expr(lk if left else rk, df.columns).alias(f"k{i}")
            for i, (lk, rk) in enumerate(p.hard_keys())]
    day = F.unix_date(pick(dated).cast("date")) if dated is not None else F.lit(0)
    return df.select(*keys, F.col("row_id").alias(names[0]),
                     (pick(total) * F.lit(10 ** scale)).cast("bigint").alias(names[1]),
                     day.alias(names[2])).dropna()


def _targets(one: DataFrame, p: MatchPass, left: bool, scale: int) -> DataFrame:
    """Targets with their tolerance in units (0 where totals must be equal)."""
    rule = p.total_attribute()
    out = _side(one, p, left, ("one_id", "v", "tday"), scale)
    if rule.operator == "EQUALS":
        return out.withColumn("tol", F.lit(0).cast("bigint"))
    tol = numeric_tolerance(rule, F.col("v").cast("double") / F.lit(float(10 ** scale)))
    return out.withColumn("tol", F.floor(tol * F.lit(float(10 ** scale)) + F.lit(1e-6)).cast("bigint"))


def _cell_rows(targets: DataFrame, many: DataFrame, kn: list[str], t: int) -> DataFrame:
    """(cell, id, u): the rows that some target of the cell can take, and the cell's ``cap``
    (its largest total, null where amounts are negative), bin width ``w`` and size ``n``."""
    cells = targets.groupBy(*kn, "tday").agg(F.max(F.col("v") + F.col("tol")).alias("top"),
                                             F.greatest(F.max("tol"), F.lit(1)).alias("w"))
    days = lambda c: floor_div(F.col(c).cast("bigint"), t + 1)
    near = F.explode(F.sequence(floor_div(F.col("tday").cast("bigint") - t, t + 1),
                                floor_div(F.col("tday").cast("bigint") + t, t + 1)))
    rows = (cells.withColumn("bin", near).join(many.withColumn("bin", days("day")), kn + ["bin"])
            .where(F.abs(F.col("day") - F.col("tday")) <= t).drop("bin", "day"))
    cell = kn + ["tday"]
    signs = rows.groupBy(*cell).agg((F.min("u") > 0).alias("positive"))
    rows = (rows.join(signs, cell).withColumn("cap", F.when(F.col("positive"), F.col("top")))
            .where(F.col("cap").isNull() | (F.col("u") <= F.col("cap"))))
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rows.join(sizes, cell).select(*cell, "id", "u", "cap", "w", "n")


def _in_tasks(targets: DataFrame, rows: DataFrame, cell: list[str], p: MatchPass, scale: int,
              alone: bool = False) -> DataFrame:
    """(cell, v, total, rows, ids descending) of the best subset of each different target, or
    ``back`` where the task would hold too many sums and targets are not ``alone``."""
    rule = p.total_attribute()
    lists = rows.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("id", "u"))).alias("m"))
    within = numeric_tolerance(rule, F.col("v").cast("double") / F.lit(float(10 ** scale)))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("v"))
    asked = (targets.groupBy(*cell, "v", "tol").agg(F.count(F.lit(1)).alias("_n"))
             .select(*cell, F.floor((place - 1) / (1 if alone else SLICE)).alias("slice"), F.struct("v", "tol", within.alias("within")).alias("a"))
             .groupBy(*cell, "slice").agg(F.collect_list("a").alias("asked")))
    solve = cell_search.solver(cell, rule.operator == "EQUALS", float(WITHIN_FLOOR), scale, LISTED, ALONE if alone else ROOM, alone)
    schema = T.StructType([lists.schema[c] for c in cell] + T.StructType.fromDDL(
        "v long, total long, rows int, ids array<long>, back boolean").fields)
    held = lists.join(asked, cell)
    if alone:                                                    # few and slow: a task for each
        held = held.repartition(4 * max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                                        rows.sparkSession.sparkContext.defaultParallelism))
    return held.select(*cell, "m", "asked").mapInArrow(solve, schema)


def _from_sums(targets: DataFrame, rows: DataFrame, cell: list[str], scored) -> list[DataFrame]:
    """(one_id, v, total, rows, ids descending) of the subsets of larger cells, by growing sums."""
    rows = materialize(rows.select(*cell, F.lit("r").alias("side"), "id", "u", F.lit(0).alias("day"),
                                   "cap", "w"), "o2m-large")
    width = rows.select(*cell, "w").distinct()
    open_ = materialize(targets.join(width, cell), "o2m-open")
    level, size = _start(rows, cell), rows.count()
    found, since, a = [], [], 1
    while True:
        level = materialize(_grow(level.join(open_.select(cell).distinct(), cell, "left_semi"),
                                  rows, cell, 0), "o2m-sums")
        a += 1
        before, size = size, level.count()
        since.append(level.groupBy(*cell, "s").agg(F.max("ids").alias("ids"))
                     .withColumn("rows", F.lit(a)))
        if size and size ** 2 <= AT_ONCE * before:               # few: grow on before they meet
            continue
        sums = reduce(DataFrame.unionByName, since).join(width, cell)
        asked = open_.withColumn("bin", F.explode(F.sequence(
            floor_div(F.col("v") - F.col("tol"), F.col("w")),
            floor_div(F.col("v") + F.col("tol"), F.col("w"))))).drop("w")
        given = sums.withColumn("bin", floor_div(F.col("s"), F.col("w"))).drop("w")
        met = asked.join(given, cell + ["bin"]).where(F.abs(F.col("v") - F.col("s")) <= F.col("tol"))
        best = met.groupBy("one_id", "v", F.col("s").alias("total"), "rows").agg(F.max("ids").alias("ids"))
        found.append(materialize(best, "o2m-found"))
        since = []
        if not size:
            return found
        done = scored(found[-1]).where("q = 100").select("one_id").distinct()
        open_ = materialize(open_.join(done, "one_id", "left_anti"), "o2m-open")
        if open_.isEmpty():
            return found


def proposals(one: DataFrame, many: DataFrame, p: MatchPass) -> DataFrame:
    """The best subset of each target that has one: one_id, q, rows, ids (descending)."""
    one_is_left = p.match_type == "ONE_TO_MANY"
    rule = p.total_attribute()
    scale = max(_scale(one, rule.left if one_is_left else rule.right),
                _scale(many, rule.right if one_is_left else rule.left))
    dated = p.date_attribute()
    t = int(dated.tolerance_days) if dated is not None else 0
    kn = [f"k{i}" for i in range(len(p.hard_keys()))]
    cell = kn + ["tday"]
    targets = materialize(_targets(one, p, one_is_left, scale), f"o2m-targets-{p.id}")
    rows = materialize(_cell_rows(targets, _side(many, p, not one_is_left, ("id", "u", "day"), scale),
                                  kn, t), f"o2m-cells-{p.id}")
    div = F.lit(float(10 ** scale))

    def scored(found: DataFrame) -> DataFrame:
        v, total = F.col("v").cast("double") / div, F.col("total").cast("double") / div
        ok = F.abs(v - total) <= numeric_tolerance(rule, v) if rule.operator == "WITHIN" else v == total
        return found.where(ok).select("one_id", "rows", "ids", aggregate_quality(rule, v, total).alias("q"))

    some, large = rows.where(F.col("n") <= IN_TASK), rows.where(F.col("n") > IN_TASK)
    made = materialize(_in_tasks(targets, some, cell, p, scale), f"o2m-made-{p.id}")
    back = made.where("back").select(*cell, "v")
    if not back.isEmpty():
        made = made.where("NOT back").unionByName(materialize(_in_tasks(
            targets.join(back, cell + ["v"], "left_semi"), some.join(back, cell, "left_semi"), cell, p,
            scale, alone=True), f"o2m-alone-{p.id}"))
    parts = [targets.join(made, cell + ["v"]).select("one_id", "v", "total", "rows", "ids")]
    if not large.isEmpty():
        parts += _from_sums(targets, large, cell, scored)
    choice = F.max(F.struct("q", (-F.col("rows")).alias("fewer"), "ids")).alias("c")
    return (scored(reduce(DataFrame.unionByName, parts)).where(F.col("q") >= F.lit(p.quality))
            .groupBy("one_id").agg(choice)
            .select("one_id", "c.q", (-F.col("c.fewer")).alias("rows"), "c.ids"))


def groups(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    """The accepted proposals: one_id, q, ids (descending), id order (quality desc, one id)."""
    one, many = (left, right) if p.match_type == "ONE_TO_MANY" else (right, left)
    made = materialize(proposals(one, many, p), f"o2m-proposals-{p.id}")
    better = Window.partitionBy("id").orderBy(F.desc("q"), "rows", "one_id")
    won = (made.select("one_id", "q", "rows", F.explode("ids").alias("id"))
           .withColumn("_rn", F.row_number().over(better)).where("_rn = 1")
           .groupBy("one_id").agg(F.count(F.lit(1)).alias("n_won")))
    return made.join(won, "one_id").where(F.col("n_won") == F.col("rows")).select(
        "one_id", "q", "ids", (-F.col("q")).alias("_o1"), F.col("one_id").alias("_o2"))


def members(best: DataFrame) -> DataFrame:
    """Member rows; the one-side row leads."""
    return best.select(F.explode(F.concat(F.array("one_id"), "ids")).alias("row_id"), "one_id", "q",
                       "_o1", "_o2") \
        .select("row_id", (F.col("row_id") == F.col("one_id")).alias("_lead"), "q", "_o1", "_o2")
