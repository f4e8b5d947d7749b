"""Scratch cleanup and run detail merging."""

import os


import matchbook.session as S
from matchbook.plans import browse


def test_drop_scratch_removes_files_and_tables(spark, monkeypatch):
    monkeypatch.setattr(S, "_RUN_TAG", "droptest" + os.urandom(3).hex())
    monkeypatch.setattr(S, "_tables", [])
    plain = S.materialize(spark.range(5), "plain")
    bucketed = S.materialize(spark.range(5).withColumnRenamed("id", "row_id"), "b",
                             bucket_by="row_id")
    assert plain.count() == 5 and bucketed.count() == 5
    name = S._tables[0]
    root = f"{S.checkpoint_root(spark)}/matchbook/{S._RUN_TAG}".replace("file:", "")
    assert os.path.isdir(root) and spark.catalog.tableExists(name)
    assert S.drop_scratch(spark) is True
    assert not os.path.isdir(root) and not spark.catalog.tableExists(name)
    assert S.drop_scratch(spark) is False            # nothing left to remove


def test_run_detail_manifest_wins(spark, tmp_path):
    runs = str(tmp_path / "runs")
    spark.createDataFrame([("r1", "cfg-a", "SET", "2024-01-15T00:00:00")],
                          "run_id string, config_id string, set_id string, started_at string") \
        .write.parquet(runs)
    meta = spark.createDataFrame([("r1", "cfg-meta", "2024-01-16", "x")],
                                 "run_id string, config_id string, requested string, "
                                 "started_at string")
    row = browse.run_detail(spark, runs, "r1", meta).first().asDict()
    assert row["config_id"] == "cfg-a" and row["started_at"] == "2024-01-15T00:00:00"
    assert row["requested"] == "2024-01-16" and row["set_id"] == "SET"
    assert browse.run_detail(spark, runs, "nope", meta).count() == 0
