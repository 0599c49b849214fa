"""Every registered query of the engine against its SQL."""

import pytest

from lectern.plans import catalog


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in catalog.QUERIES.items() if sql))
def test_equals_sql(name, same):
    same(*catalog.QUERIES[name])


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in catalog.QUERIES.items() if not sql))
def test_runs(name, spark, sf):
    assert catalog.QUERIES[name][0](spark, sf).count() > 0


def test_dictionary_choice_keeps_unchanged_images(spark, sf):
    rows = catalog.QUERIES["dictionary_choice"][0](spark, sf).collect()
    chosen = {r.image for r in catalog.QUERIES["dictionary_rerank"][0](spark, sf).collect()}
    images = {r.l_orderkey for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    assert len(rows) == len(images) and {r.image for r in rows} == images and images - chosen
    assert all(r.before and r.after == r.before for r in rows if r.image not in chosen)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
