"""Every registered query against its DuckDB oracle on sf0.001."""


from helpers import SF_SMALL
import oracle_check


def test_all_queries_match_oracle(spark):
    report = oracle_check.compare(spark, SF_SMALL, verbose=False)
    bad = {k: v for k, v in report.items() if v["status"] != "match"}
    assert not bad, bad
    assert len(report) >= 30


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "MATCHING_ID" in df.columns
