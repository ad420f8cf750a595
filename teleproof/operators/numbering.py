"""Dense acquisition numbers per record, without a task per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleproof import settings
from teleproof.operators.blocks import RECORD
from teleproof.sources.workspace import written

PLACE = "_place"


def in_order(df: DataFrame, order: Sequence[str | Column], key: str = RECORD) -> DataFrame:
    """``df`` dealt into ranges of ``(key, *order)`` and sorted, with ``_place``: range number and position in the range.

    Ranges are cut by the whole order, ties included, so neither a long record nor many rows of one time end in one task. The table is written:
    cuts come from samples and would differ if it were computed twice.
    """
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return written(ranged.withColumn(PLACE, F.monotonically_increasing_id()), "ordered")


def long_records(df: DataFrame, key: str = RECORD) -> DataFrame:
    """``_long``: the keys of more than ``BLOCK_ROWS`` rows."""
    sizes = df.groupBy(F.col(key).alias("_long")).agg(F.count(F.lit(1)).alias("_n"))
    return written(sizes.filter(F.col("_n") > settings.BLOCK_ROWS).select("_long"), "long")


def number_rows(df: DataFrame, order: Sequence[str | Column], key: str = RECORD, long: DataFrame | None = None) -> DataFrame:
    """Add the dense acquisition index ``row`` (BIGINT) per ``key`` along ``order``.

    Records of at most ``BLOCK_ROWS`` rows are numbered by one window, with one shuffle and nothing written; longer ones (``long``, as ``long_records``
    gives them) are dealt into ranges.
    """
    long = long_records(df, key) if long is None else long
    one = lambda rows: rows.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint") - 1)
    if long.isEmpty():
        return one(df)
    # One long record stands for a block's worth of rows at least, so there are few.
    mine = F.col(key).eqNullSafe(F.col("_long"))
    rest, held = (df.join(F.broadcast(long), mine, how) for how in ("left_anti", "left_semi"))
    return one(rest).unionByName(number_long(held, order, key))


def number_long(df: DataFrame, order: Sequence[str | Column], key: str = RECORD) -> DataFrame:
    """``number_rows`` for records of any length.

    A row's number is its position after the first row of its record in the same range, plus the rows of the record in earlier ranges.
    """
    placed = in_order(df, order, key)
    part = F.shiftrightunsigned(PLACE, 33)
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy(part.alias("_part"), F.col(key).alias("_key")).agg(F.min(PLACE).alias("_first"), F.count(F.lit(1)).alias("_n"))
    shift = held.select("_part", "_key", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = (part == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key"))
    return placed.join(shift, same).withColumn("row", F.col(PLACE) + F.col("_shift")).drop(PLACE, "_part", "_key", "_shift")
