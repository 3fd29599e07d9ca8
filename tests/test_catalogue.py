import os

import duckdb
import pytest

from lumberline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted(repr(dict(sorted(zip(columns, row)))) for row in result.fetchall())
    got = sorted(repr(dict(sorted(r.asDict().items()))) for r in catalogue.QUERIES[name](spark, SF).collect())
    assert got == want


def test_nearest_of_events_before_1970_equals_sql(spark, tmp_path):
    """The SQL cuts microseconds towards 1970, from both sides."""
    con = duckdb.connect()
    rows = "(0, '1969-12-31 23:59:59.9995', 'signup'), (1, '1969-12-31 23:59:58.0001', 'error'), (2, '1969-12-31 23:59:57.0009', 'signup'), (3, '1970-01-01 00:00:00.0009', 'error'), (4, null, 'signup')"
    con.execute(f"copy (select i::bigint as event_id, t::timestamp as ts, 7::bigint as user_id, k as event_type, 1.5 as value, '{{}}' as props from (values {rows}) v(i, t, k)) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = sorted(con.execute(catalogue.ORACLE_SQL["asof_nearest"]).fetchall())
    got = sorted(tuple(r) for r in catalogue.QUERIES["asof_nearest"](spark, str(tmp_path)).select("probe_id", "ts_ms", "line_no").collect())
    assert got == want == [(1, -2_999, 2), (3, 0, 0)]
