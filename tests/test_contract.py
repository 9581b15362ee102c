import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_oracle_sql_needs_no_spark():
    code = "import sys; sys.path.insert(0, '.'); from __spark_entry__ import oracle_sql; print(len(oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.strip()) > 40


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["window_start", "window_end", "store_id", "count"]
    assert df.count() > 0


def test_queries_return_dataframes(spark):
    from pyspark.sql import DataFrame

    from __spark_entry__ import queries
    for name, fn in queries().items():
        assert isinstance(fn(spark, SF_SMALL), DataFrame), name
