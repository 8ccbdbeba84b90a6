"""Every checked query against its SQL on the smallest tables."""

import datetime
import decimal
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from millaudit.plans import registry
from millaudit.plans.derived import BASE

SF = "/root/testdata/sf0.001"
registry.load_all()
NAMES = sorted(registry.CHECKS)


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def found(spark, request):
    """Columns and rows of every query, several at a time: on tables this small most of the time is planning."""

    def run(name):
        df = registry.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)

    wanted = {i.callspec.params["name"] for i in request.session.items if i.path == request.path}
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in NAMES if name in wanted}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(found, duck, name):
    columns, got = found[name].result()
    cursor = duck.execute(registry.CHECKS[name])
    described = [d[0] for d in cursor.description]
    assert sorted(described) == columns
    order = [described.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert got == want
