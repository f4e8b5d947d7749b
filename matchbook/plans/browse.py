"""Browse a reconciliation result: filtered pages of matches and breaks,
and the history of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.sources.sinks import INDEX_COLUMNS

# Fixed values of the browsing surface.
MAX_LIMIT = 10000
DEFAULT_LIMIT = 100
FILTER_COLUMNS = {
    "matched_by_pass": "MATCHED_BY_PASS",
    "currency": "CURRENCY",
    "bank_account": "BANK_ACCOUNT",
}


SEEK_CELLS = 4096                # row-id ranges counted in one seek step
SEEK_ROWS = 10000                # rows that a page may step over after seeking


def check_page(limit: int, offset: int) -> tuple[int, int]:
    """The page bounds as integers; values outside them are an error, never cut silently."""
    limit, offset = int(limit), int(offset)
    if not 0 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"a page has 0 to {MAX_LIMIT} rows from an offset of 0 or more")
    return limit, offset


def filtered(result: DataFrame, status: str, filters: dict | None = None) -> DataFrame:
    """STATUS filter plus optional equality filters; unknown filter keys are ignored."""
    df = result.where(F.col("STATUS") == F.lit(status))
    for key, value in (filters or {}).items():
        col = FILTER_COLUMNS.get(key)
        if col is not None and value is not None:
            df = df.where(F.col(col) == F.lit(value))
    return df


def seek(df: DataFrame, offset: int) -> tuple[int, int, DataFrame]:
    """(total rows, rows left to step over, the rows from there on).

    Rows are counted by row-id range, at most ``SEEK_CELLS`` ranges at a time, and the range
    that holds the offset is narrowed until it holds few rows, so a deep page reads counts
    and its own rows, never sorts the rows before it."""
    low, high = df.agg(F.min("row_id"), F.max("row_id")).first()
    if low is None:
        return 0, 0, df
    total, rest = None, offset
    while True:
        width = -(-(high - low + 1) // SEEK_CELLS)
        cell = F.expr(f"CAST((row_id - {low}L) DIV {width}L AS INT)")
        counts = sorted(tuple(r) for r in df.where(F.col("row_id").between(low, high))
                        .groupBy(cell.alias("cell")).count().collect())
        total = sum(n for _, n in counts) if total is None else total
        if offset >= total:
            return total, 0, df.limit(0)
        for c, n in counts:
            if rest < n:
                break
            rest -= n
        low, high = low + c * width, low + (c + 1) * width - 1
        if n <= SEEK_ROWS or width == 1:
            return total, rest, df.where(F.col("row_id") >= low)


def page(result: DataFrame, status: str, filters: dict | None = None,
         limit: int = DEFAULT_LIMIT, offset: int = 0,
         after: int | None = None) -> tuple[int, DataFrame]:
    """(total, page rows in input order).  ``after`` continues behind a row id (keyset
    paging); an offset is sought by counts, see ``seek``."""
    limit, offset = check_page(limit, offset)
    df = filtered(result, status, filters)
    if after is not None:
        return df.count(), df.where(F.col("row_id") > after).orderBy("row_id") \
            .offset(offset).limit(limit)
    total, rest, tail = seek(df, offset)
    return total, tail.orderBy("row_id").offset(rest).limit(limit)


def indexed_page(spark: SparkSession, path: str, status: str, filters: dict | None = None,
                 limit: int = DEFAULT_LIMIT, offset: int = 0) -> tuple[int, DataFrame]:
    """(total, page rows in input order) of a result written by ``sinks.write_paged``.

    The zone map alone gives the total and the files that hold the page, so a deep page reads
    these files only.  It knows status, pass and currency; a filter on the account counts the
    rows (see ``page``)."""
    limit, offset = check_page(limit, offset)
    asked = {k: v for k, v in (filters or {}).items() if FILTER_COLUMNS.get(k) and v is not None}
    if any(FILTER_COLUMNS[k] not in INDEX_COLUMNS for k in asked):
        return page(spark.read.parquet(f"{path}/rows"), status, filters, limit, offset)
    per_file = (filtered(spark.read.parquet(f"{path}/index"), status, asked)
                .groupBy("file").agg(F.min("low").alias("low"), F.sum("n").alias("n")))
    # One row a file: an unpartitioned window over it is small.
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    ranged = per_file.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = ranged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = (ranged.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
             .orderBy("low").collect())
    if not files:
        return total, spark.read.parquet(f"{path}/rows").limit(0)
    rows = filtered(spark.read.parquet(*[f["file"] for f in files]), status, asked)
    return total, rows.orderBy("row_id").offset(offset - min(offset, files[0]["start"])).limit(limit)


def matches_page(result: DataFrame, filters: dict | None = None, limit: int = DEFAULT_LIMIT,
                 offset: int = 0) -> tuple[int, DataFrame]:
    return page(result, "MATCHED", filters, limit, offset)


def breaks_page(result: DataFrame, filters: dict | None = None, limit: int = DEFAULT_LIMIT,
                offset: int = 0) -> tuple[int, DataFrame]:
    return page(result, "UNMATCHED", filters, limit, offset)


def with_page_meta(total: int, rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """Page rows with the page's total/limit/offset as columns."""
    limit, offset = check_page(limit, offset)
    return rows.select(F.lit(total).cast("bigint").alias("page_total"),
                       F.lit(limit).cast("bigint").alias("page_limit"),
                       F.lit(offset).cast("bigint").alias("page_offset"), "*")


def run_history(spark: SparkSession, runs_path: str, meta: DataFrame | None = None) -> DataFrame:
    """Runs newest first, then by run id; missing totals read as 0.  A missing start is taken
    from the request metadata (run_id, started_at) if given."""
    runs = spark.read.parquet(runs_path)
    if meta is not None:
        asked = meta.select("run_id", F.col("started_at").alias("asked_at"))
        runs = (runs.join(asked, "run_id", "left")
                .withColumn("started_at", F.coalesce("started_at", "asked_at")))
    t = lambda c: F.coalesce(F.col(f"totals.{c}"), F.lit(0)).cast("bigint").alias(c)  # noqa
    return runs.select("run_id", "config_id", "set_id", F.coalesce("started_at", F.lit(""))
                       .alias("started_at"),
                       F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"),
                       t("input_rows"), t("matched_rows"), t("unmatched_rows"),
                       t("match_groups")).orderBy(F.desc("started_at"), "run_id")


def run_detail(spark: SparkSession, runs_path: str, run_id: str,
               meta: DataFrame | None = None) -> DataFrame:
    """One run's manifest merged with its request metadata (manifest wins)."""
    run = spark.read.parquet(runs_path).where(F.col("run_id") == F.lit(run_id))
    if meta is None:
        return run
    m = meta.where(F.col("run_id") == F.lit(run_id))
    shared = [c for c in m.columns if c in run.columns and c != "run_id"]
    only_meta = [c for c in m.columns if c not in run.columns]
    j = run.alias("r").join(m.alias("m"), "run_id", "left")
    return j.select("run_id", *[F.coalesce(F.col(f"r.{c}"), F.col(f"m.{c}")).alias(c)
                                for c in shared],
                    *[F.col(f"r.{c}") for c in run.columns if c not in shared + ["run_id"]],
                    *[F.col(f"m.{c}") for c in only_meta])
