import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"image_features"}


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    return round(float(value), 6) if isinstance(value, float) else value.to_pydatetime() if hasattr(value, "to_pydatetime") else value


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry_module.oracle_sql() if n not in SLOW and not n.startswith("op")))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry_module.queries()[name](spark, SF).toPandas(), con.sql(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda df: sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)
    assert as_rows(got) == as_rows(want)
