"""Ledger sources.

* ``load_ledger``: the typed input table (CSV with a header, or Parquet) with
  the eight canonical columns, declared extra columns and a stable ``row_id``.
* ``derived_ledger``: the synthetic reconciliation mix (exact pairs,
  date-shifted pairs, 1:N, N:1, N:M splits and orphans) derived from the
  ``orders`` table, so the work grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions.predicates import column
from matchbook.session import materialize
from matchbook.spec import CANONICAL_COLUMNS, OUTPUT_COLUMNS, ExtraColumn, SpecError

# Fixed canonical types of the ledger schema.
CANONICAL_TYPES = {
    "LS_TYPE": T.StringType(),
    "DR_CR_IND": T.StringType(),
    "STATUS": T.StringType(),
    "AMOUNT": T.DecimalType(18, 4),
    "CURRENCY": T.StringType(),
    "VALUE_DATE": T.DateType(),
    "BANK_ACCOUNT": T.StringType(),
    "REFERENCE": T.StringType(),
}


def extra_type(e: ExtraColumn) -> T.DataType:
    if e.type == "string":
        return T.StringType()
    if e.type == "integer":
        return T.LongType()
    if e.type == "decimal":
        return T.DecimalType(e.precision if e.precision is not None else 18,
                             e.scale if e.scale is not None else 4)
    if e.type == "date":
        return T.DateType()
    if e.type == "datetime":
        return T.TimestampNTZType()
    return T.BooleanType()


def _parsed_after_scan(e: ExtraColumn) -> bool:
    return e.format is not None and e.type in ("date", "datetime")


def ledger_schema(header: list[str], extras=()) -> T.StructType:
    """Read schema in header order; undeclared columns stay strings."""
    missing = sorted(set(CANONICAL_COLUMNS) - set(header))
    if missing:
        raise SpecError(f"input is missing required canonical columns: {missing}")
    declared = {e.name: e for e in extras}
    fields = []
    for c in header:
        if c in CANONICAL_TYPES:
            t = CANONICAL_TYPES[c]
        elif c in declared and not _parsed_after_scan(declared[c]):
            t = extra_type(declared[c])
        else:
            t = T.StringType()   # undeclared, or a formatted date parsed after the scan
        fields.append(T.StructField(c, t, True))
    return T.StructType(fields)


def _numbered(df: DataFrame, row_id: str) -> DataFrame:
    """Rows numbered in (file name, position in the file) order, whatever the split sizes.

    Every row knows its file and its position there: Parquet gives a row index; a text
    split is read in order from its first byte, so the split's first byte and the row's
    place among the rows of its task order the rows of a CSV file.  Positions become
    numbers by counting rows per split (a few narrow rows), not by a global sort."""
    spark = df.sparkSession
    meta = F.col("_metadata")
    tagged = materialize(df.select(
        "*", meta["file_path"].alias("_mb_file"), meta["file_block_start"].alias("_mb_block"),
        F.spark_partition_id().alias("_mb_task"),
        F.monotonically_increasing_id().alias("_mb_at")), "ledger-scan")
    first = Window.orderBy("_mb_file", "_mb_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (tagged.groupBy("_mb_file", "_mb_block", "_mb_task")
              .agg(F.count(F.lit(1)).alias("_mb_n"), F.min("_mb_at").alias("_mb_min"))
              .withColumn("_mb_start", F.coalesce(F.sum("_mb_n").over(first), F.lit(0))))
    keys = ["_mb_file", "_mb_block", "_mb_task"]
    out = tagged.join(splits, keys)                         # one row per input split
    return out.select((F.col("_mb_start") + F.col("_mb_at") - F.col("_mb_min")).cast("bigint")
                      .alias(row_id), *[column(c) for c in df.columns])


def _require_unique(df: DataFrame, row_id: str) -> None:
    key = column(row_id)
    twice = df.groupBy(key.alias("id")).count().where("id IS NULL OR count > 1").limit(1).collect()
    if twice:
        raise SpecError(f"{row_id} must be a unique number; {twice[0]['id']} stands "
                        f"{twice[0]['count']} times")


def load_ledger(spark: SparkSession, path: str, fmt: str = "csv", extras=(),
                row_id: str = "row_id") -> DataFrame:
    """Typed scan of the input with a stable unique BIGINT ``row_id``.

    CSV is read with an explicit schema and FAILFAST (a malformed value is an error, never
    a silent null).  A ``row_id`` in the input is read as a number and must be unique.
    Otherwise rows are numbered from 0 by file name and position in the file, once, so the
    ids depend neither on split sizes nor on recomputed stages.  Stale output columns from
    an earlier run are dropped.
    """
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(f.name, T.LongType()) if f.name == row_id else f
                               for f in ledger_schema(header, extras).fields])
        df = (spark.read.schema(schema).option("header", True)
              .option("mode", "FAILFAST").option("enforceSchema", False).csv(path))
    else:
        df = spark.read.format(fmt).load(path)
        missing = sorted(set(CANONICAL_COLUMNS) - set(df.columns))
        if missing:
            raise SpecError(f"input is missing required canonical columns: {missing}")
    given = row_id in df.columns
    if not given:
        df = _numbered(df, row_id)
    declared = {e.name: e for e in extras if not _parsed_after_scan(e)}
    types = CANONICAL_TYPES | {c: extra_type(e) for c, e in declared.items()} | {
        row_id: T.LongType()}
    df = df.select([column(c).cast(types[c]).alias(c) if c in types else column(c)
                    for c in df.columns])
    for e in extras:
        if _parsed_after_scan(e) and e.name in df.columns:
            raw = column(e.name).cast("string")
            parsed = F.to_date(raw, e.format) if e.type == "date" else \
                F.to_timestamp_ntz(raw, F.lit(e.format))
            df = df.withColumn(e.name, parsed)
    df = df.drop(*[c for c in OUTPUT_COLUMNS if c != "STATUS" and c in df.columns])
    if given:
        _require_unique(df, row_id)
    return df


def _calendar_date(col, dtype: T.DataType):
    """The stored wall-clock date of a timestamp, independent of the session
    time zone (a zone-aware TIMESTAMP is taken at UTC, as it is stored)."""
    if isinstance(dtype, T.TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_micros(col) / F.lit(86400000000)).cast("int"))
    return col.cast("date")


def derived_ledger(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """The reconciliation mix derived from ``orders``; ``spread`` deals the orders to so many
    partitions first, for sources of a few large row groups.

    Per order (``o_orderkey % 100``): 0-69 an exact GL/STMT pair, 70-79 a pair
    whose statement is one day later, 80-87 one GL row against 2-4 statement
    parts, 88-95 2-4 GL parts against one statement row, 96 two against two,
    97-99 one unmatched row.  ``row_id = o_orderkey * 16 + slot`` is stable.
    Parts are exact in cents: the first n-1 parts are floor(total/n) minus a
    side-specific step (7 for GL, 11 for STMT) times the part number, the last
    part takes the remainder.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = orders.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        _calendar_date(F.col("o_orderdate"), orders.schema["o_orderdate"].dataType).alias("d"))
    o = o.repartition(spread) if spread else o
    o = o.withColumn("kind", F.col("k") % 100).withColumn("parts", F.lit(2) + F.col("k") % 3)
    side = F.explode(F.array(
        F.struct(F.lit("GL").alias("ls"), F.lit("CR").alias("dc"), F.lit(0).alias("base")),
        F.struct(F.lit("STMT").alias("ls"), F.lit("DR").alias("dc"), F.lit(8).alias("base"))))
    n = o.select("*", side.alias("s")).select("*", "s.ls", "s.dc", "s.base").drop("s")
    kind, ls = F.col("kind"), F.col("ls")
    is_gl = ls == F.lit("GL")
    np_ = (F.when(kind < 80, 1)
           .when(kind < 88, F.when(is_gl, 1).otherwise(F.col("parts")))
           .when(kind < 96, F.when(is_gl, F.col("parts")).otherwise(1))
           .when(kind == 96, 2)
           .when(is_gl == ((F.col("k") % 200) < 100), 1).otherwise(0))
    n = n.withColumn("np", np_)
    rows = n.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("j")) \
        .where(F.col("j") < F.col("np"))
    step = F.when(is_gl, 7).otherwise(11)
    np_c, j = F.col("np"), F.col("j")
    share = F.floor(F.col("cents") / F.greatest(np_c, F.lit(1))).cast("bigint")
    units = (F.when(np_c == 1, F.col("cents"))
             .when(j < np_c - 1, share - (j + 1) * step)
             .otherwise(F.col("cents") - (np_c - 1) * share
                        + step * ((np_c - 1) * np_c / 2).cast("bigint")))
    k_str = F.col("k").cast("string")
    return rows.select(
        (F.col("k") * 16 + F.col("base") + j).alias("row_id"),
        ls.alias("LS_TYPE"), F.col("dc").alias("DR_CR_IND"), F.lit("OPEN").alias("STATUS"),
        (units.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,4)").alias("AMOUNT"),
        F.element_at(F.array(*[F.lit(x) for x in ("USD", "EUR", "GBP", "JPY")]),
                     (F.col("c") % 4 + 1).cast("int")).alias("CURRENCY"),
        F.when(kind.between(70, 79) & (ls == "STMT"), F.date_add(F.col("d"), 1))
         .otherwise(F.col("d")).alias("VALUE_DATE"),
        F.when((kind < 80) | (kind >= 97),
               F.concat(F.lit("NOSTRO-"), F.lpad((F.col("c") % 100).cast("string"), 4, "0")))
         .otherwise(F.concat(F.lit("NOSTRO-AGG-"), k_str)).alias("BANK_ACCOUNT"),
        F.when(np_c == 1, F.concat(F.lit("TRX-"), k_str))
         .otherwise(F.concat(F.lit("TRX-"), k_str, F.lit("-"), j.cast("string"))).alias("REFERENCE"))
