import pytest
from compare import same
from paths import SF

from plumeflow.plans import catalog, catalog_flow, catalog_mail, catalog_more, catalog_rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_fit_branch_occurs(spark):
    rows = catalog.QUERIES["rec04_category_fit"](spark, "/root/testdata/sf0.01").groupBy("fit").count().collect()
    assert {r["fit"] for r in rows} == {True, False}
