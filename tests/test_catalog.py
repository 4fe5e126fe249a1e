"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

from riskgrove.catalog import REGISTRY
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [name for name, query in REGISTRY.items() if query.sql is not None]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, duck, name):
    query = REGISTRY[name]
    got = query.build(spark, SF_DIR).toPandas()
    assert len(got) > 0
    assert difference(got, duck.execute(query.sql).fetchdf()) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_references_are_sound(spark):
    from riskgrove.sources.tables import broken_references

    rows = broken_references(spark, SF_DIR).collect()
    assert len(rows) == 5
    assert all(r["orphans"] == 0 and r["doubled"] == 0 for r in rows)


def test_pruned_joins_keep_every_row(spark):
    from riskgrove.sources.tables import JOBS_SQL, jobs, load

    for name in ("lineitem", "orders", "part", "customer", "nation", "region"):
        load(spark, SF_DIR, name).createOrReplaceTempView(name)
    whole = spark.sql(JOBS_SQL)
    for cols in (["salary"], ["risk", "industry"], ["location"], ["education", "job_title"]):
        assert jobs(spark, SF_DIR, *cols).exceptAll(whole.select(*cols)).count() == 0
        assert whole.select(*cols).exceptAll(jobs(spark, SF_DIR, *cols)).count() == 0
