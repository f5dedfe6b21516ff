"""Every registered core query: against its SQL; one without SQL gives rows, the same ones each time (its rules are tested in ``test_models``)."""

from collections import Counter

import pytest

from compare import check, database
from seqloom.queries import all_queries, all_sql


#: No hit of the small tables covers 95 % of its entry, and none of a DNA element lies in an LTR entry.
NONE_HERE = {"chain_g3_full_length", "clu_c9_contained_names"}


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, data, con, name):
    df = all_queries()[name](spark, data)
    sql = all_sql().get(name)
    if sql:
        check(con, df, sql)
    else:
        rows, again = (Counter(map(repr, x.collect())) for x in (df, all_queries()[name](spark, data)))
        assert len(df.columns) == len(set(df.columns)) and rows == again
        assert bool(rows) != (name in NONE_HERE)


def test_every_sql_has_a_query():
    assert not set(all_sql()) - set(all_queries())
