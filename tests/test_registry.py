from __future__ import annotations

import pytest

from tests.oracle import same
from tidewake import registry, registry_sources  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    same(registry.QUERIES[name](spark, small), registry.ORACLES[name], small)


def test_every_query_but_louvain_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"louvain"}


def test_checks_find_the_planted_faults(spark, small):
    for name in (n for n in registry.QUERIES if n.startswith("check_")):
        assert not registry.QUERIES[name](spark, small).isEmpty(), name


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
