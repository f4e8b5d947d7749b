"""Sinks: the reconciliation result and the runs table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_result(result: DataFrame, path: str, fmt: str = "parquet", ordered: bool = False,
                 mode: str = "overwrite") -> None:
    """Distributed write of the result (part files).

    ``ordered=True`` range-partitions on ``row_id`` and sorts inside each
    partition, so the part files read back in input order.  CSV output shows
    decimals with their full scale (1000.0000)."""
    df = result
    if ordered:
        df = df.repartitionByRange("row_id").sortWithinPartitions("row_id")
    if fmt == "csv":
        df = df.select([F.col(f.name).cast("string").alias(f.name)
                        if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                        for f in df.schema.fields])
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


INDEX_COLUMNS = ("STATUS", "MATCHED_BY_PASS", "CURRENCY")


def write_paged(result: DataFrame, path: str) -> None:
    """The result as Parquet files of ascending row-id ranges under ``<path>/rows``, and under
    ``<path>/index`` a zone map: per file its row-id range and the number of rows of every
    status, pass and currency, from which ``browse.indexed_page`` picks the files of a page."""
    write_result(result, f"{path}/rows", ordered=True)
    rows = result.sparkSession.read.parquet(f"{path}/rows")
    (rows.groupBy(F.col("_metadata.file_path").alias("file"), *INDEX_COLUMNS)
     .agg(F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count(F.lit(1)).alias("n"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/index"))


def record_run(manifest: DataFrame, runs_path: str, config_id: str | None = None) -> None:
    """Append one run manifest row to the runs table (flattened totals)."""
    row = manifest.select(
        "run_id", F.lit(config_id).cast("string").alias("config_id"), "set_id", "cycle_date",
        "started_at", "duration_sec", "input_path", "output_path", "config_path", "totals",
        "pass_breakdown", "unmatched_breakdown")
    row.write.mode("append").parquet(runs_path)
