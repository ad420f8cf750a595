"""Session defaults and the sizes that bound the work of one task."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Rows of one record handled by one window task; longer records are cut into blocks of this size.
BLOCK_ROWS = 65_536
# Rows per bucket when windows are joined to rows.
JOIN_BLOCK_ROWS = 4_096
# Rows of a table that one task takes where records are dealt whole; more rows make more tasks, not larger ones.
TASK_ROWS = 131_072
# Events folded in one array; longer chains are cut into blocks.
CHAIN_EVENTS = 1_024


def session(app: str = "teleproof", cpus: str | int | None = None) -> SparkSession:
    """Local session for tests and the benchmark; on a cluster pass your own."""
    cores = str(cpus or os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
