"""Small hand-made ledgers for edge cases."""

from datetime import date
from decimal import Decimal

from pyspark.sql import types as T

SF_SMALL = "/root/testdata/sf0.001"

LEDGER_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("LS_TYPE", T.StringType()),
    T.StructField("DR_CR_IND", T.StringType()),
    T.StructField("STATUS", T.StringType()),
    T.StructField("AMOUNT", T.DecimalType(18, 4)),
    T.StructField("CURRENCY", T.StringType()),
    T.StructField("VALUE_DATE", T.DateType()),
    T.StructField("BANK_ACCOUNT", T.StringType()),
    T.StructField("REFERENCE", T.StringType()),
])


def row(i, side, amount, d="2024-01-15", acct="ACC-1", ref="R", ccy="USD", status="OPEN"):
    ls, dc = ("GL", "CR") if side == "L" else ("STMT", "DR")
    amt = None if amount is None else Decimal(str(amount)).quantize(Decimal("0.0001"))
    return (i, ls, dc, status, amt, ccy, None if d is None else date.fromisoformat(d), acct, ref)


def ledger_df(spark, rows):
    return spark.createDataFrame(rows, LEDGER_SCHEMA)


def long_rows(df):
    return sorted((r["row_id"], r["MATCHING_ID"], r["MATCHED_BY_PASS"], r["MATCH_QUALITY"])
                  for r in df.collect())
