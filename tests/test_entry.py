import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def test_contract():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 70


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "item_id", "rank", "score"] and df.count() >= 0


def test_split_leak(spark):
    """Query theorems aren't train theorems, and neighbours are."""
    from lemmary.plans.graph_queries import pipeline

    p = pipeline(spark, SF)
    train = {r[0] for r in p.m.theorems().where("split = 'train'").select("id").collect()}
    assert all(r["item_id"] in train and r["query_id"] not in train for r in p.theorem_neighbors.collect())
