"""Every query next to its SQL on the smallest tables."""

import pytest
from compare import connect, difference

from abstain_eval.checks import cases, domains, replies, scores

QUERIES = {**scores.QUERIES, **replies.QUERIES, **cases.QUERIES, **domains.QUERIES}
ORACLES = {**scores.ORACLES, **replies.ORACLES, **cases.ORACLES, **domains.ORACLES}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_names_are_registered_once():
    total = len(scores.QUERIES) + len(replies.QUERIES) + len(cases.QUERIES) + len(domains.QUERIES)
    assert len(QUERIES) == total
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, small, name):
    assert difference(spark, duck, QUERIES[name], ORACLES[name], small) == ""
