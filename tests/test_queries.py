"""Every registered query against its SQL; those without are in test_plain.py."""

import pytest

from tessera.plans import catalogue
from tests.helpers import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sf, name):
    same(spark, sf, catalogue.QUERIES[name], catalogue.ORACLES[name])
