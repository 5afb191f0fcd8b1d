"""Every registered query of the engine's operators runs, and equals its SQL twin where it has one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from tiepoint.plans import catalogue, files
from twins import compare

SF = "/root/testdata/sf0.001"
SLOW: set[str] = set()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_twin(spark, name):
    assert compare(spark, SF, catalogue.QUERIES[name], catalogue.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(files.SQL))
def test_files(spark, name):
    assert compare(spark, SF, files.QUERIES[name], files.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - SLOW))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
