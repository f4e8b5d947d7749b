"""Run a reconciliation from a config document, as a spark-submit job.

    spark-submit scripts/reconcile.py --config cfg.json --input <ledger> \
        --output <result dir> [--format csv|parquet] [--cycle-date YYYY-MM-DD] \
        [--runs <runs table dir>] [--run-id ID]

Writes the result (every input row, in input order, MATCHED/UNMATCHED with
group id, pass and quality) to ``--output`` and the one-row run manifest
(totals, pass breakdown, open items by side and currency) as JSON to
``<output>_manifest``; with ``--runs`` the manifest is also appended to the
runs table that ``matchbook.browse.run_history`` lists.  The cluster's own
settings (``spark.checkpoint.dir`` among them) come from spark-submit.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from matchbook.plans.run import run_passes  # noqa: E402
from matchbook.plans.summary import run_manifest  # noqa: E402
from matchbook.session import materialize  # noqa: E402
from matchbook.sources.ledger import load_ledger  # noqa: E402
from matchbook.sources.sinks import record_run, write_result  # noqa: E402
from matchbook.spec import RunSpec  # noqa: E402


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("--config", required=True)
    ap.add_argument("--input", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--format", default="csv", choices=("csv", "parquet"))
    ap.add_argument("--input-format", default=None, choices=("csv", "parquet"))
    ap.add_argument("--cycle-date", default=None)
    ap.add_argument("--runs", default=None)
    ap.add_argument("--run-id", default=None)
    args = ap.parse_args(argv)

    spark = SparkSession.builder.getOrCreate()
    with open(args.config) as f:                 # the config document is small
        spec = RunSpec.from_dict(json.load(f))
    in_fmt = args.input_format or ("parquet" if args.input.rstrip("/").endswith(".parquet")
                                   else "csv")
    ledger = load_ledger(spark, args.input, in_fmt, extras=spec.extra_columns)
    run_id = args.run_id or uuid.uuid4().hex[:12]
    run = run_passes(ledger, spec, args.cycle_date, run_id=run_id)
    # Written once; the ordered output and the manifest read the written rows.
    result = materialize(run.result, "result")
    write_result(result, args.output, fmt=args.format, ordered=True)
    manifest = materialize(run_manifest(
        result, spec, run_id, run.started_at, run.duration_sec, run.cycle_date,
        run.groups, run.skipped, run.durations(),
        {"input": args.input, "output": args.output, "config": args.config}), "manifest")
    manifest.coalesce(1).write.mode("overwrite").json(args.output.rstrip("/") + "_manifest")
    if args.runs:
        record_run(manifest, args.runs)
    totals = manifest.select("totals.*").first().asDict()   # one row
    print(json.dumps({"run_id": run_id, **totals}))
    return totals


if __name__ == "__main__":
    main()
