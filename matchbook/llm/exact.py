"""Exact de-duplication with an extendible-hash index kept as shared files.

1. Every row gets the 64-bit hash of its text; one narrow table holds id, hash and
   SHA-256.
2. Directory: rows are counted by the top ``max_depth`` bits (at most 2**max_depth
   counts, a fixed size), and the directory doubles, one bit at a time, as long as a
   bucket holds more rows than ``capacity``.  A bucket keeps the shortest hash prefix
   that fits; rows of one hash can never be split, they chain.
3. Equal texts of a task are combined before the shuffle, so a group that holds a
   third of all rows sends one row per task.  The final combination compares the texts
   byte by byte: two texts of equal hash stay two entries.
4. Entries are written as the index files (bucket, hash, chain position, digest, kept
   id, group size); owner tasks each write a range of buckets, sorted.
5. Rows look their entry up by bucket, hash and digest.

Cases: null text equals the empty text; a null id is smaller than any other and its
row stays only in a group without ids; of repeated rows with the same id and text one
stays; an empty table gives an empty result.  Only the named columns are read, so
extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.common import shuffle_parts
from matchbook.session import materialize

CAPACITY = 4096        # rows of a bucket before it is split
MAX_DEPTH = 16         # bits of the largest directory: 65,536 cells


def build_directory(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket number and local depth of every cell of a directory over 2**d counts.

    Starts as one bucket and, while a bucket is overfull and has bits left, doubles the
    directory (``bucket`` and ``depth`` are repeated) and splits the overfull buckets.
    """
    bits = int(counts.size).bit_length() - 1
    bucket, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for d in range(bits + 1):
        load = counts.reshape(1 << d, -1).sum(axis=1)
        total = np.bincount(bucket, weights=load).astype(np.int64)
        over = total[bucket] > capacity
        if d == bits or not over.any():
            break
        bucket, depth, over = (np.repeat(x, 2) for x in (bucket, depth, over))
        half = np.arange(bucket.size) & 1
        key = bucket * 2 + np.where(over, half, 0)
        depth = depth + over
        bucket = np.unique(key, return_inverse=True)[1]
    wide = counts.size // bucket.size
    return np.repeat(bucket, wide), np.repeat(depth, wide)


def index_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, max_depth: int = MAX_DEPTH,
                ) -> tuple[DataFrame, DataFrame]:
    """(rows, index): the narrow row table and the written index files.

    rows: row_id, id, h, sha.  index: bucket, h, chain, sha, keep_id, group_size.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    cell = F.shiftrightunsigned("h", 64 - max_depth).cast("int")
    rows = materialize(
        docs.select(F.monotonically_increasing_id().alias("row_id"),
                    F.col(id_col).cast("long").alias("id"),
                    F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("sha")), "exact-rows")
    counts = np.zeros(1 << max_depth, np.int64)
    for r in rows.groupBy(cell.alias("cell")).count().collect():
        counts[r["cell"]] = r["count"]
    bucket, depth = build_directory(counts, capacity)
    directory = spark.createDataFrame(pd.DataFrame(
        {"cell": np.arange(counts.size, dtype=np.int32), "bucket": bucket, "depth": depth}))

    entries = (docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
               .withColumn("h", F.xxhash64("t")).groupBy("h", "t")
               .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .select("h", F.sha2("t", 256).alias("sha"), "keep_id", "group_size")
               .join(F.broadcast(directory), cell == F.col("cell")))
    owners = shuffle_parts(spark)
    n_buckets = int(bucket.max()) + 1
    chain = F.row_number().over(Window.partitionBy("owner", "bucket", "h").orderBy("sha"))
    index = (entries.withColumn("owner", F.floor(F.col("bucket") * owners / n_buckets))
             .repartition(owners, "owner").withColumn("chain", chain)
             .sortWithinPartitions("bucket", "h", "chain")
             .select("bucket", "depth", "h", "chain", "sha", "keep_id", "group_size"))
    return rows, materialize(index, "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256, bucket,
    chain.  The row with the largest id of each group of equal texts is kept."""
    rows, index = index_texts(docs, id_col, text_col, capacity, max_depth)
    one = F.row_number().over(Window.partitionBy("sha", "id").orderBy("row_id"))
    return (rows.withColumn("copy", one).join(index, ["h", "sha"])
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
                    .alias("kept"),
                    F.col("sha").alias("text_sha256"), "bucket", "chain"))
