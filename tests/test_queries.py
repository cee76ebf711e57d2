"""Every registered query of the road-network part against its SQL."""

import pytest

from spokewise.plans import registry

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    known = registry.ORACLES | registry.SLOW
    if name in known:
        compare(spark, registry.QUERIES[name], known[name], SF)
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0
