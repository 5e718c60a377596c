"""Operators on small inputs give the rows that are stated by hand."""

import pytest

from tests import fixtures
from tests.conftest import SF
from tests.fixture_rows import ROWS
from tests.oracle import plain


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_stated_rows(spark, name):
    columns, rows = ROWS[name]
    names = [c.strip().split(" ")[0].strip('"') for c in columns.split(",")]
    got = fixtures.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(repr(tuple(plain(v) for v in r)) for r in got) == sorted(repr(tuple(plain(v) for v in r)) for r in rows)
