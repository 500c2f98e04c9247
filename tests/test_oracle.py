"""Every registered query against its DuckDB oracle at sf0.001 (rows-only where no oracle)."""

import os
import sys

from conftest import SF0001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


def test_registered_queries_match_oracle(spark):
    from oracle_check import compare

    res = compare(spark, SF0001, verbose=False)
    empty = [k for k, v in res.items() if v in ("OK 0 rows", "rows-only 0") or v.startswith(("OK 0 rows", "rows-only 0 "))]
    assert not empty, empty
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and {"page_url", "batch_id", "idea", "cnt"} <= set(df.columns)
    assert set(E.oracle_sql()) <= set(E.queries())
