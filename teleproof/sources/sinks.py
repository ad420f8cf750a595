"""Writers. A target that exists is refused, and no non-finite number leaves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleproof.functions.scalar import is_finite
from teleproof.operators.release import public_view


def non_finite(value: Column, kind: T.DataType) -> Column | None:
    """Whether a value holds a NaN or an infinity at any depth; None if its type cannot."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~is_finite(value)
    if isinstance(kind, T.StructType):
        found = [x for f in kind.fields if (x := non_finite(value[f.name], f.dataType)) is not None]
        return reduce(lambda a, b: a | b, found) if found else None
    if isinstance(kind, T.ArrayType):
        return None if non_finite(F.lit(None), kind.elementType) is None else F.coalesce(F.exists(value, lambda x: non_finite(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        inside = T.ArrayType(kind.valueType)
        return non_finite(F.map_values(value), inside)
    return None


def non_finite_rows(df: DataFrame) -> DataFrame:
    """Rows with a NaN or infinite number in any column, nested ones too."""
    found = [x for f in df.schema.fields if (x := non_finite(F.col(f"`{f.name}`"), f.dataType)) is not None]
    return df.filter(reduce(lambda a, b: a | b, found)) if found else df.limit(0)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; a non-finite number stops the write, which runs the plan once."""
    found = [x for f in df.schema.fields if (x := non_finite(F.col(f"`{f.name}`"), f.dataType)) is not None]
    if found:
        refused = F.raise_error(F.lit("non-finite numbers cannot be written as JSON"))
        df = df.filter(F.when(reduce(lambda a, b: a | b, found), refused.cast("boolean")).otherwise(F.lit(True)))
    try:
        df.write.mode("append" if append else "errorifexists").json(path)
    except Exception as error:
        if "non-finite numbers" in str(error):
            raise ValueError("non-finite numbers cannot be written as JSON") from error
        raise


def write_split(df: DataFrame, public_path: str, private_path: str, key: str, public: Sequence[str]) -> None:
    """Public columns to one place, everything else (with the key) to another."""
    public_view(df, public).write.mode("errorifexists").json(public_path)
    private = [c for c in df.columns if c == key or c not in public]
    df.select(*private).write.mode("errorifexists").json(private_path)


def write_per_record(df: DataFrame, path: str, key: str = "record_id") -> None:
    """One folder per record; rows of a large record stay spread over several files."""
    df.write.mode("errorifexists").partitionBy(key).parquet(path)
