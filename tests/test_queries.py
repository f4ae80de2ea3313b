import pytest
from helpers import SMALL, rows_of

import __spark_entry__
from seqcover import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = rows_of(core.QUERIES[name](spark, SMALL))
    want = rows_of(duck.execute(core.ORACLE_SQL[name]).df())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_clusters(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["centroid", "density", "mode", "mode_seq"] and df.count() > 0


def test_iteration_covers_each_record_once(spark):
    members = core.one_iteration(spark, SMALL)
    assert members.count() == members.select("seq_id").distinct().count()
