import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

TABLES = ["events", "orders", "lineitem", "customer", "part"]


def rows(frame, columns):
    show = lambda v: "null" if v is None or v != v or str(v) == "NaT" else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, sql, name):
    found = registry.QUERIES[name](spark, sf_dir).toPandas()
    wanted = sql.sql(registry.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert rows(found, columns) == rows(wanted, columns)


@pytest.mark.parametrize("name", ["chart_series", "to_series", "daily_average_series", "text_rows"])
def test_events_that_lack_kinds(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"""copy (select i::bigint as event_id, timestamp '2024-01-06' + to_days((i % 5)::int) as ts, i::bigint as user_id,
        case when i % 5 = 3 then 'purchase' else 'click' end as event_type, i / 3 as value, '{{"k": 1}}' as props from range(40) t(i)) to '{tmp_path}/events.parquet'""")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    found, wanted = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert rows(found, columns) == rows(wanted, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not math.isnan(len(entry.queries()))
