"""Queries that SQL can express, on the test tables and on odd rows."""

import pytest
from compare import connect, same

from tessera.llm import queries as Q
from tessera.llm.oracle import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    same(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name])
