"""The two whole jobs: telemetry to fact packages, and telemetry to a material of facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleproof.operators import evidence as E
from teleproof.operators import packages as P
from teleproof.operators import windows as W
from teleproof.operators.blocks import RECORD
from teleproof.operators.detect import MiningConfig, candidates
from teleproof.operators.quality import quality_profile
from teleproof.sources.workspace import written


@dataclass(frozen=True)
class Mined:
    candidates: DataFrame
    groups: DataFrame
    packages: DataFrame
    facts: DataFrame
    unavailable: DataFrame


def mine(rows: DataFrame, config: MiningConfig, max_cases: int | None = None) -> Mined:
    """All records at once: candidates, bounded groups, packages and their facts."""
    found = written(candidates(rows, config), "candidates")
    groups = written(P.event_groups(found, config), "groups")
    if max_cases is not None:
        groups = P.case_budget(groups, max_cases)
    chosen = groups.filter("processed").drop("processed") if max_cases is not None else groups
    packages = written(P.package_windows(chosen, rows, config), "packages")
    channels = list(dict.fromkeys([*config.channels, *config.zero_channels, *config.context_channels]))
    measured = written(P.package_measures(rows, packages, channels), "facts")
    return Mined(
        found, groups, packages,
        measured.filter(F.col("status") == "ok").drop("status"),
        measured.filter(F.col("status") != "ok").drop("value"),
    )


@dataclass(frozen=True)
class Material:
    catalog: DataFrame
    facts: DataFrame


def build_material(
    rows: DataFrame, regions: Sequence[tuple[str, int, int]], channels: Sequence[str], stats: Sequence[str]
) -> Material:
    """Record catalog with whole-record quality, and the grid of facts over the named regions."""
    bounds = W.extents(rows)
    whole = bounds.select(RECORD, F.col("first_row").alias("start_row"), F.col("end_row").alias("stop_row"))
    grid = E.fact_grid(bounds.select(RECORD), regions, channels, stats)
    return Material(quality_profile(rows, whole, channels), E.observe(rows, grid, channels))
