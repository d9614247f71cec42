"""Every query with SQL, row by row against DuckDB; the others by what must hold."""

from __future__ import annotations

import pytest

from nearfold import plans

from .oracle import database, differences


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_rows_agree_with_sql(spark, sf, con, name):
    assert differences(plans.QUERIES[name](spark, sf), con, plans.ORACLE_SQL[name]) == []


def test_every_oracle_has_a_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


def test_birch_holds_its_contract(spark, sf):
    rows = plans.QUERIES["birch_clusters"](spark, sf).collect()
    assert sum(r.n for r in rows) == 500  # in two batches
    assert all(r.n == 1 or r.radius < plans.search.THRESHOLD for r in rows)
    labels = plans.QUERIES["birch_labels"](spark, sf)
    assert labels.count() == labels.select("id").distinct().count() == 500


def test_projection_is_ordered_and_uncorrelated(spark, sf):
    x = plans.QUERIES["pca_project"](spark, sf).groupBy("id").pivot("pos").max("value").toPandas().drop(columns="id").to_numpy()
    var = x.var(0)
    assert (var[:-1] >= var[1:] - 1e-6).all()
    assert abs(((x - x.mean(0)).T @ (x - x.mean(0)) / len(x))[0, 1]) < 1e-4


def test_ranking_and_accuracy_are_repeatable(spark, sf):
    once, again = (plans.QUERIES["rf_importance_order"](spark, sf).collect() for _ in range(2))
    assert once == again and [r["rank"] for r in once] == list(range(1, 65))
    assert all(0 <= r.accuracy <= 1 for r in plans.QUERIES["cv_accuracy"](spark, sf).collect())
