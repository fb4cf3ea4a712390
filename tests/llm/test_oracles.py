import os

import duckdb
import pytest

from weftspark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{t}{'/*' if os.path.isdir(f'{sf}/{t}') else ''}')")
    theirs = con.execute(ORACLE_SQL[name]).df()
    ours = QUERIES[name](spark, sf).toPandas()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert sorted(map(tuple, ours[columns].values.tolist())) == sorted(map(tuple, theirs[columns].values.tolist()))
