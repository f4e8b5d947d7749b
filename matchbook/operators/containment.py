"""CONTAINS joins by an inverted index of q-grams.

The left value must contain the right one (the needle).  A needle is looked up by one of
its q-grams, the one that fewest left rows have; left rows stand under all their q-grams.
So a row meets the needles whose rarest part it has, and not every row of its account.
Needles shorter than q characters are classes of their own, looked up whole among the
grams of their length; the empty needle, which every value contains, meets all rows of
its keys.  A needle with a gram that no left row has is dropped before the join.  Each pair
meets once, and the exact test follows the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 6                            # characters of a gram; a longer one is rarer


def _grams(value: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(value) - size + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.substring(value, i, F.lit(size)))
    return F.array_distinct(F.filter(cut, lambda g: F.length(g) == size))


def _all_grams(value: Column) -> Column:
    return F.concat(F.array(F.lit("")), *[_grams(value, s) for s in range(1, Q + 1)])


def _needle_grams(value: Column) -> Column:
    """A needle's grams of its class: its q-grams, or the whole of a shorter one."""
    return F.when(F.length(value) < Q, F.array(value)).otherwise(_grams(value, Q))


def add_grams(left: DataFrame, right: DataFrame, l_col: str, r_col: str,
              name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a gram to join on (``l_<name>``, ``r_<name>``): left rows once for each
    gram of their value that some needle is looked up by, right rows with their needle's."""
    hay, needle = F.col(l_col).cast("string"), F.col(r_col).cast("string")
    needles = right.select(needle.alias("needle")).where("needle IS NOT NULL").distinct()
    sizes = [r[0] for r in needles.select(
        F.least(F.length("needle"), F.lit(Q)).alias("size")).distinct().collect()]
    if sizes == [Q]:                                        # the usual case: no short needles
        grams = _grams(hay, Q)
    else:
        grams = F.filter(_all_grams(hay), lambda g: F.length(g).isin(sizes))
    spread = left.withColumn(f"l_{name}", F.explode(grams))
    counts = spread.groupBy(F.col(f"l_{name}").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    parts = needles.select("needle", F.explode(_needle_grams(F.col("needle"))).alias("gram"))
    # A missing gram (n = 0) rules the needle out, so it is the rarest.
    rarest = (parts.join(counts, "gram", "left").groupBy("needle")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
              .where("r.n > 0").select("needle", F.col("r.gram").alias(f"r_{name}")))
    return spread, right.join(rarest, needle == F.col("needle")).drop("needle")
