"""Order-aware building blocks that stay parallel inside one long record.

A record is a sequence of rows with a dense zero-based ``row``. Window functions partitioned by the record
alone would put a long record into a single task, so every operator here partitions by
``(keys, block)`` with ``block = row div block_rows`` and exchanges only block summaries or halo rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleproof import settings

RECORD = "record_id"


def block_of(position: str, block_rows: int) -> Column:
    return F.expr(f"`{position}` div {block_rows}")


def known_length(df: DataFrame, position: str = "row") -> int | None:
    """Upper bound of the rows per record, if the ingest measured one and ``position`` still carries it."""
    return df.schema[position].metadata.get("longest") if position in df.columns else None


def fits(df: DataFrame, rows: int, position: str = "row") -> bool:
    """Is every record known to be at most ``rows`` long? Then one task per record is enough."""
    longest = known_length(df, position)
    return longest is not None and longest <= rows


def with_length(df: DataFrame, longest: int | None, position: str = "row") -> DataFrame:
    """Attach the measured length to ``position``; filters and projections keep it."""
    if longest is None:
        return df
    return df.withMetadata(position, {"longest": longest})


def with_halo(
    df: DataFrame, before: int, after: int, position: str = "row", block_rows: int | None = None
) -> DataFrame:
    """Copy rows near a block edge into the neighbouring block, so bounded frames see their neighbours."""
    size = block_rows or settings.BLOCK_ROWS
    if fits(df, size, position):
        return df.withColumn("block", F.lit(0).cast("bigint"))
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col(position) - after) / size))
    last = F.expr(f"(`{position}` + {before}) div {size}")
    return df.withColumn("block", F.explode(F.sequence(first, last)))


def at_home(position: str = "row", block_rows: int | None = None) -> Column:
    return block_of(position, block_rows or settings.BLOCK_ROWS) == F.col("block")


def ordered(keys: Sequence[str] = (RECORD,), position: str = "row"):
    """The window used after ``with_halo``."""
    return Window.partitionBy(*keys, "block").orderBy(position)


def neighbours(
    df: DataFrame, columns: dict[str, tuple[str, int]], keys: Sequence[str] = (RECORD,), block_rows: int | None = None
) -> DataFrame:
    """Add shifted copies: ``{"prev_time": ("time_s", -1)}`` is the value one row earlier."""
    back = max([0, *(-shift for _, shift in columns.values())])
    ahead = max([0, *(shift for _, shift in columns.values())])
    w = ordered(keys)
    out = with_halo(df, back, ahead, block_rows=block_rows)
    for name, (source, shift) in columns.items():
        out = out.withColumn(name, F.lag(source, -shift).over(w))
    return out.filter(at_home(block_rows=block_rows)).drop("block")


def running(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    how: str,
    position: str = "row",
    tie: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Running ``sum`` or ``max`` along ``position``: inside each block, plus the carry of the earlier blocks."""
    size = block_rows or settings.BLOCK_ROWS
    total = {"sum": F.sum, "max": F.max}[how]
    keys = list(keys)
    if fits(df, size, position):
        whole = Window.partitionBy(*keys).orderBy(position, *tie).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, total(value).over(whole))
    df = df.withColumn("_blk", block_of(position, size)).withColumn("_v", value)
    carry = (
        df.groupBy(*keys, "_blk")
        .agg(total("_v").alias("_t"))
        .withColumn(
            "_carry",
            total("_t").over(Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .filter((F.col("_blk") > 0) & F.col("_carry").isNotNull())
        .drop("_t")
    )
    w = Window.partitionBy(*keys, "_blk").orderBy(position, *tie).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_local", total("_v").over(w)).join(carry, [*keys, "_blk"], "left")
    if how == "sum":
        merged = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        merged = F.greatest("_local", "_carry")
    return local.withColumn(out, merged).drop("_blk", "_v", "_local", "_carry")


def mask_runs(
    hits: DataFrame,
    keys: Sequence[str] = (RECORD,),
    position: str = "row",
    carry: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Maximal runs ``[start_row, stop_row)`` of consecutive rows among ``hits``.

    ``carry`` columns come back as ``first_<name>`` and ``last_<name>``, their values at the ends of the run.

    Runs are found inside blocks; only runs touching a block edge (at most two per block) are then stitched.
    """
    size = block_rows or settings.BLOCK_ROWS
    keys = list(keys)
    columns = [*keys, "start_row", "stop_row", *[f"{end}_{c}" for end in ("first", "last") for c in carry]]
    single = fits(hits, size, position)
    inside = Window.partitionBy(*keys, "_blk").orderBy(position)
    local = (
        hits.select(*keys, position, *carry)
        .withColumn("_blk", F.lit(0).cast("bigint") if single else block_of(position, size))
        .withColumn("_island", F.col(position) - F.row_number().over(inside))
        .groupBy(*keys, "_blk", "_island")
        .agg(
            F.min(position).alias("start_row"),
            (F.max(position) + 1).alias("stop_row"),
            *[F.min_by(c, position).alias(f"first_{c}") for c in carry],
            *[F.max_by(c, position).alias(f"last_{c}") for c in carry],
        )
    )
    if single:
        return local.select(*columns)
    at_edge = ((F.col("start_row") == F.col("_blk") * size) & (F.col("_blk") > 0)) | (
        F.col("stop_row") == (F.col("_blk") + 1) * size
    )
    along = Window.partitionBy(*keys).orderBy("start_row")
    stitched = (
        local.filter(at_edge)
        .withColumn("_new", F.when(F.lag("stop_row").over(along) == F.col("start_row"), 0).otherwise(1))
        .withColumn("_piece", F.sum("_new").over(along))
        .groupBy(*keys, "_piece")
        .agg(
            F.min("start_row").alias("start_row"),
            F.max("stop_row").alias("stop_row"),
            *[F.min_by(f"first_{c}", "start_row").alias(f"first_{c}") for c in carry],
            *[F.max_by(f"last_{c}", "start_row").alias(f"last_{c}") for c in carry],
        )
    )
    return local.filter(~at_edge).select(*columns).unionByName(stitched.select(*columns))


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, salt: Column, ways: int = 32):
    """The first ``k`` rows of every group: ranked inside ``ways`` salted parts, then among at most ``k * ways``."""
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.hash(salt), F.lit(ways)))
        .withColumn("_rank", F.row_number().over(part))
        .filter(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= k)
        .drop("_salt", "_rank")
    )
