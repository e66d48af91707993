"""Every query with SQL equals it on the smallest tables; every other one runs."""

import datetime
import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from sluice.plans import adapters, catalog, platform  # noqa: F401  (platform adds its queries to the catalog)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = _rows(df.columns, df.collect())
    if name in catalog.ORACLE:
        found = duck.execute(catalog.ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert got == _rows(names, found.fetchall())


def test_bronze_takes_every_raw_row(spark):
    raw = adapters.raw_readings(spark, SF)
    dirty = raw.where(F.col("event_timestamp").try_cast("timestamp").isNull()).count()
    rows = catalog.QUERIES["bronze_lineage"](spark, SF).collect()
    assert dirty and sum(r.n for r in rows) == raw.count()
    assert sum(r.n for r in rows if r.folder == "__HIVE_DEFAULT_PARTITION__") == dirty
