"""Benchmark: the standard four-pass reconciliation on the ledger derived
from ``orders`` at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``.  Prints one JSON line.

``value`` is the end-to-end wall time from the source table to the written,
ordered result and the manifest: ingest (derive and write the ledger), the
passes, numbering, the result (written once, then in order) and the summary.
A page query follows, on its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from matchbook.session import build_session, materialize, scratch_path
    extra = dict(kv.split("=", 1) for kv in os.environ.get("BENCH_CONF", "").split(",") if kv)
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), extra=extra)

    from matchbook.plans import browse, summary
    from matchbook.plans.configs import standard_spec
    from matchbook.plans.run import run_passes
    from matchbook.sources.ledger import derived_ledger
    from matchbook.sources.sinks import write_result

    def pipeline(sf: str):
        """Source table to ordered result and manifest; seconds by step."""
        steps, t = {}, time.time()

        def step(name: str) -> None:
            nonlocal t
            steps[name] = time.time() - t
            t = time.time()

        ledger = materialize(derived_ledger(spark, sf, cpus), "ledger")
        step("ingest")
        run = run_passes(ledger, standard_spec())
        t += sum(p.duration_sec for p in run.passes) + run.extra["numbering_sec"]
        steps.update({f"pass_{p.spec.id}": p.duration_sec for p in run.passes})
        steps["numbering"] = run.extra["numbering_sec"]
        step("plan_result")
        result = materialize(run.result, "result")
        step("result")
        write_result(result, scratch_path(spark, "ordered"), ordered=True)
        step("ordered_output")
        manifest = summary.run_manifest(
            result, standard_spec(), "bench", run.started_at, run.duration_sec, run.cycle_date,
            run.groups, run.skipped, run.durations()).first()
        step("summary")
        return result, manifest.totals, steps

    # Warm-up: JVM start, class loading, codegen and JIT (the hot loops only
    # get compiled after tens of thousands of rows) on smaller inputs.
    for warm in ("sf0.001", "sf0.01"):
        small = os.path.join(os.path.dirname(sf_dir), warm)
        if os.path.isdir(small) and small != sf_dir:
            pipeline(small)

    t0 = time.time()
    result, totals, timings = pipeline(sf_dir)
    total = time.time() - t0
    n_rows = totals["input_rows"]
    t = time.time()
    n, rows = browse.matches_page(result, {"currency": "EUR"}, 100, 1000)
    rows.collect()
    timings["page"] = time.time() - t

    out = {
        "metric": "reconciliation_wall_time",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in timings.items()},
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "rows": n_rows,
        "matched_rows": totals["matched_rows"],
        "match_groups": totals["match_groups"],
        "rows_per_sec": round(n_rows / total, 1) if total > 0 else None,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
