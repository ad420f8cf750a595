"""The same queries with blocks far smaller than the records, so that every long-record path is taken."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connection  # noqa: E402
from teleproof import settings  # noqa: E402
from teleproof.operators import pyramid  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = [
    "det_median_step", "det_time_faults", "det_zero_runs", "event_groups", "package_facts", "context_change_points", "cycle_segments",
    "active_runs", "interval_features", "window_stats", "batched_window_stats", "quality_profile", "longest_zero_run",
    "first_sustained", "first_crossing", "sustained_multi_threshold", "slice_last_seconds", "profile_bins", "query_batch", "evidence_replay", "phase_latch", "conflict_examples",
]


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.fixture(autouse=True)
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(settings, "BLOCK_ROWS", 50)
    monkeypatch.setattr(settings, "JOIN_BLOCK_ROWS", 32)
    monkeypatch.setattr(pyramid, "FAN", 4)
    monkeypatch.setattr(settings, "CHAIN_EVENTS", 3)


@pytest.mark.parametrize("name", NAMES)
def test_long(spark, duck, name):
    assert compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""
