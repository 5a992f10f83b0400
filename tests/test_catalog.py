"""Every query with SQL gives the SQL's rows; the others run."""

import duckdb
import pytest

import __spark_entry__
from mirrorfield import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    wanted = sorted(duck.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall(), key=repr)
    assert rows and len(rows) == len(wanted)
    for a, b in zip(rows, wanted):
        assert a == pytest.approx(b, abs=2e-6)


def test_groups_and_representatives_are_of_all_features(spark):
    groups = catalog.queries()["hc_groups"](spark, SF)
    assert {r["count"] for r in groups.groupBy("linkage").count().collect()} == {64}
    assert 0 < catalog.queries()["group_representatives"](spark, SF).count() <= 64


def test_entry_selects_something(spark):
    assert __spark_entry__.entry(spark).count() > 0
