"""Record frames over the given tables.

Each returns ``record_id, row, time_s`` plus channels (DOUBLE) and context columns (STRING). Numbering needs a
sort per record, so the numbered rows are ingested once as a working copy sorted by ``(record_id, row)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof import settings
from teleproof.functions.scalar import ntz_seconds
from teleproof.operators import pyramid
from teleproof.operators.blocks import RECORD
from teleproof.operators.numbering import long_records, number_rows
from teleproof.sources.workspace import working_copy

LINE_CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CONTEXT = ["l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(source: DataFrame, raw: DataFrame, order: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, int | None]:
    """``columns`` of the numbered rows of ``raw``, and the number of tasks that whole records are dealt into; none if some record is longer than a block."""
    long = long_records(raw)
    if not long.isEmpty():
        return number_rows(raw, order, long=long).select(*columns), None
    ways = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-source.count() // settings.TASK_ROWS))
    return number_rows(raw.repartition(ways, RECORD), order, long=long).select(*columns), ways


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: one record per user in time order; ``k`` comes from the JSON properties."""
    source = table(spark, sf_dir, "events")

    def build() -> tuple[DataFrame, int | None]:
        raw = source.select(
            F.col("user_id").alias("record_id"),
            "event_id",
            ntz_seconds(F.col("ts")).alias("time_s"),
            "value",
            F.get_json_object("props", "$.k").cast("double").alias("k"),
            "event_type",
        )
        return numbered(source, raw, ["time_s", "event_id"], ["record_id", "row", "time_s", "value", "k", "event_type"])

    return working_copy(source, "event_rows", build)


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem``: one record per supplier in order-line order; ship dates repeat and reverse along it."""
    source = table(spark, sf_dir, "lineitem")

    def build() -> tuple[DataFrame, int | None]:
        raw = source.select(
            F.col("l_suppkey").alias("record_id"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            ntz_seconds(F.col("l_shipdate")).alias("time_s"),
            *LINE_CHANNELS,
            *LINE_CONTEXT,
        )
        order = ["l_orderkey", "l_linenumber", "l_partkey", *LINE_CHANNELS, *LINE_CONTEXT, "time_s"]
        return numbered(source, raw, order, ["record_id", "row", "time_s", *LINE_CHANNELS, *LINE_CONTEXT])

    return working_copy(source, "line_rows", build)


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block summaries of ``line_rows``, written once beside them."""
    rows = line_rows(spark, sf_dir)
    label = f"line_blocks-{pyramid.FAN}-{pyramid.LEVELS}"
    return working_copy(table(spark, sf_dir, "lineitem"), label, lambda: (pyramid.summaries(rows, LINE_CHANNELS), None))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders``: one short record per customer."""
    source = table(spark, sf_dir, "orders")

    def build() -> tuple[DataFrame, int | None]:
        raw = source.select(
            F.col("o_custkey").alias("record_id"),
            "o_orderkey",
            ntz_seconds(F.col("o_orderdate")).alias("time_s"),
            F.col("o_totalprice"),
            "o_orderstatus",
        )
        return numbered(source, raw, ["o_orderkey"], [*raw.columns, "row"])

    return working_copy(source, "order_rows", build)


def embedding_rows(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """``embeddings``: one record per label, vectors in id order, components as channels."""
    source = table(spark, sf_dir, "embeddings")

    def build() -> tuple[DataFrame, int | None]:
        raw = source.select(
            F.col("label").cast("bigint").alias("record_id"),
            "vec_id",
            F.col("vec_id").cast("double").alias("time_s"),
            *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)],
        )
        return numbered(source, raw, ["vec_id"], [c for c in [*raw.columns, "row"] if c != "vec_id"])

    return working_copy(source, f"embedding_rows_{dims}", build)


def long_layout(rows: DataFrame, channels: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per (row, channel): ``channel, reading``."""
    return rows.unpivot(keep or ["record_id", "row", "time_s"], channels, "channel", "reading")


def wide_layout(long: DataFrame, channels: list[str], keep: list[str] | None = None) -> DataFrame:
    return long.groupBy(*(keep or ["record_id", "row", "time_s"])).pivot("channel", channels).agg(F.first("reading"))
