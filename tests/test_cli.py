"""The spark-submit script on the golden ledger with a config document."""

import csv
import glob
import json
import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.join(os.path.dirname(HERE), "scripts"))


def test_reconcile_script(spark, tmp_path):
    import reconcile
    cfg = os.path.join(HERE, "fixtures", "golden_config.json")
    out = str(tmp_path / "out")
    totals = reconcile.main(["--config", cfg, "--input",
                             os.path.join(HERE, "fixtures", "golden_input.csv"),
                             "--output", out, "--runs", str(tmp_path / "runs"), "--run-id", "r1"])
    assert totals == {"input_rows": 18, "matched_rows": 16, "unmatched_rows": 2, "match_groups": 6}
    rows = []
    for f in sorted(glob.glob(out + "/part-*.csv")):
        with open(f) as fh:
            rows += list(csv.DictReader(fh))
    assert len(rows) == 18 and [r["REFERENCE"] for r in rows][:2] == ["TRX001", "TRX001"]
    assert rows[0]["AMOUNT"] == "1000.0000" and rows[0]["MATCHED_BY_PASS"] == "MP_O2O"
    assert rows[-1]["STATUS"] == "UNMATCHED"
    man = [json.loads(l) for f in glob.glob(out + "_manifest/*.json") for l in open(f)]
    assert man[0]["run_id"] == "r1" and len(man[0]["pass_breakdown"]) == 4
    assert man[0]["config_path"] == cfg and man[0]["output_path"] == out
    assert all(p["duration_sec"] > 0 for p in man[0]["pass_breakdown"])
