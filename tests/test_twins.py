"""Every named query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connection  # noqa: E402
from teleproof.checks import load  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = load()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["record_id", "group_start", "group_stop", "channel", "fact", "value"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], TWINS.get(name), SF) == ""
