import pytest

import __spark_entry__ as entry
from quillstone.plans import queries as own

from .oracle import same


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, own.QUERIES[name], own.ORACLES[name])


def test_entry_has_grounded_and_rejected_rows(spark):
    got = {r["grounded"] for r in entry.entry(spark).select("grounded").distinct().collect()}
    assert True in got


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_grounds_every_chunk(spark):
    from quillstone.plans.queries import chunks

    assert entry.entry(spark).count() == chunks(spark, "/root/testdata/sf0.001").count()


def test_rejections_have_both_stages(spark):
    assert {r["stage"] for r in own.QUERIES["q_rejections"](spark, "/root/testdata/sf0.001").collect()} == {"parse", "shape"}
