"""Columns of any depth: fields dropped, renumbered or cleaned by the schema, without a word about single paths."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleproof.functions.scalar import finite_or_null


def rebuilt(value: Column, kind: T.DataType, drop: frozenset[str], leaf: Callable[[Column, T.DataType], Column]) -> Column:
    """``value`` with the fields named in ``drop`` gone at every depth and ``leaf`` applied to what is no struct, array or map; nulls stay null."""
    if isinstance(kind, T.StructType):
        fields = [rebuilt(value[f.name], f.dataType, drop, leaf).alias(f.name) for f in kind.fields if f.name not in drop]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast(T.StructType())
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rebuilt(x, kind.elementType, drop, leaf))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda k, _: ~k.isin(list(drop))) if drop and isinstance(kind.keyType, T.StringType) else value
        return F.transform_values(kept, lambda _, v: rebuilt(v, kind.valueType, drop, leaf))
    return leaf(value, kind)


def pruned(df: DataFrame, private: Iterable[str]) -> DataFrame:
    """The frame without any field or map entry of a private name, however deep in structs, arrays and maps."""
    drop = frozenset(private)
    return df.select(*[rebuilt(F.col(f"`{f.name}`"), f.dataType, drop, lambda v, _: v).alias(f.name) for f in df.schema.fields if f.name not in drop])


def cleaned(df: DataFrame) -> DataFrame:
    """The frame with every NaN and infinity null, at any depth."""
    leaf = lambda v, kind: finite_or_null(v) if isinstance(kind, (T.DoubleType, T.FloatType)) else v
    return df.select(*[rebuilt(F.col(f"`{f.name}`"), f.dataType, frozenset(), leaf).alias(f.name) for f in df.schema.fields])


def field_names(kind: T.DataType) -> set[str]:
    """Names of all fields of a type, at any depth."""
    if isinstance(kind, T.StructType):
        return {f.name for f in kind.fields}.union(*(field_names(f.dataType) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return field_names(kind.elementType)
    if isinstance(kind, T.MapType):
        return field_names(kind.valueType)
    return set()
