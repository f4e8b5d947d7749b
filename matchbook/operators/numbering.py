"""Dense sequential group numbering without a single-task window.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead the groups are range-partitioned on the ordering columns and sorted
inside each partition; each row records its partition index and
``monotonically_increasing_id()`` (consecutive inside a partition); the
partition sizes (one row per partition, a size bound we control) give running
offsets that are broadcast back.  The ordering columns must form a total
order so that the numbers are deterministic.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.session import materialize


def number_rows(df: DataFrame, order_cols: list[str], offset: int = 0,
                seq_col: str = "_seq", tag: str = "numbered",
                with_count: bool = True) -> tuple[DataFrame, int | None]:
    """Add ``seq_col`` = offset + 1, 2, ... in ascending ``order_cols`` order.

    Returns the numbered frame (over the materialised, range-partitioned
    rows) and the number of rows (one small job; skipped with
    ``with_count=False``).
    """
    ranged = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = materialize(ranged, tag + "-ranged")
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                       F.min("_mono").alias("_base"))
    # One row per partition: an unpartitioned window over it is trivially small.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] if with_count else None
    numbered = (ranged.join(F.broadcast(sizes.select("_pid", "_start", "_base")), "_pid")
                .withColumn(seq_col, F.lit(offset) + F.col("_start")
                            + (F.col("_mono") - F.col("_base")) + F.lit(1))
                .drop("_pid", "_mono", "_start", "_base"))
    return numbered, (int(total) if total is not None else None)


def mgid_prefix(set_id: str, cycle_date: date) -> str:
    return f"MGID_{set_id}_{cycle_date.strftime('%Y%m%d')}_"


def matching_id(seq: Column, set_id: str, cycle_date: date) -> Column:
    """MGID_<setId>_<yyyymmdd>_<seq, at least 6 digits, zero padded>."""
    digits = seq.cast("string")
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.concat(F.lit(mgid_prefix(set_id, cycle_date)), padded)
