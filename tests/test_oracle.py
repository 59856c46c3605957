"""Every query against its SQL."""

import oracle
import pytest

from tapeworks.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith("entropy_") or "ac16_ctx8" in n))
def test_query(spark, con, sf, name):
    oracle.compare(spark, con, QUERIES[name], ORACLE[name], sf)
