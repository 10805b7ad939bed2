"""Every registered query against its DuckDB twin (row count, columns and
order-insensitive values), on the smallest driver tables."""


from tests.conftest import SF_SMALL
from tools.oracle_compare import compare


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF_SMALL, verbose=False)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "predicted_class" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
