import duckdb
import pytest

from palimpsest.plans import probes

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(probes.QUERIES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = probes.QUERIES[name](spark, DATA)
    want = c.execute(probes.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(map(str, r)) for r in got.select(*columns).collect()))
    assert rows == sorted(tuple(map(str, r)) for r in want.fetchall())
