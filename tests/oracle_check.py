"""Run each registered query on Spark and its oracle SQL on DuckDB over the
same parquet tables and compare row count, column names and values."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ in ("date", "Timestamp", "datetime") and \
            getattr(v, "hour", 0) == 0 else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s_cols = sdf.columns
            s_rows = rows_of([tuple(r) for r in sdf.collect()], s_cols)
            ts = time.time() - t0
            if name not in sqls:
                report[name] = {"status": "no-oracle", "rows": len(s_rows)}
                continue
            t1 = time.time()
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_rows = rows_of(cur.fetchall(), d_cols)
            td = time.time() - t1
            ok_cols = sorted(s_cols) == sorted(d_cols)
            ok = ok_cols and s_rows == d_rows
            report[name] = {"status": "match" if ok else "MISMATCH", "spark_rows": len(s_rows),
                            "oracle_rows": len(d_rows), "cols_ok": ok_cols,
                            "spark_sec": round(ts, 2), "oracle_sec": round(td, 2)}
            if not ok and verbose:
                print(name, "cols", sorted(s_cols), sorted(d_cols))
                diff_s = [r for r in s_rows if r not in set(d_rows)][:3]
                diff_d = [r for r in d_rows if r not in set(s_rows)][:3]
                print("  spark-only", diff_s)
                print("  oracle-only", diff_d)
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "ERROR", "error": f"{type(e).__name__}: {str(e)[:400]}"}
        if verbose:
            print(f"{name:24s} {report[name]}", flush=True)
    return report


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from matchbook.session import build_session
    spark = build_session("local[8]", 8)
    compare(spark, sys.argv[1], sys.argv[2:] or None)
