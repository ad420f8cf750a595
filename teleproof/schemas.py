"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, D, B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CHANNEL = struct(unit=S, component=S)
AUXILIARY = struct(path=S, time_column=S, fields=T.ArrayType(S), role=S)
# Accepted words of a manifest entry.
SPLITS = ["development", "train", "validation", "test"]
ORIGINS = ["synthetic", "real"]
TIME_KINDS = ["seconds", "datetime"]
ROLES = ["context", "private_label"]

MANIFEST = struct(
    experiment_id=S, lineage_group=S, split=S, data_origin=S, telemetry_path=S, time_column=S, time_kind=S, time_format=S,
    channels=T.MapType(S, CHANNEL), auxiliary_files=T.ArrayType(AUXILIARY),
)
REGION = struct(record_id=S, region=S, start_row=L, stop_row=L)
CANDIDATE = struct(
    record_id=S, detector=S, start_row=L, stop_row=L, channel=S, rule=T.MapType(S, S), candidate_id=S
)
FACT = struct(fact_id=S, record_id=S, start_row=L, stop_row=L, channel=S, stat=S, value=D, unit=S)
REQUEST = struct(
    index=L, url=S, model=S, max_tokens=L, temperature=D, tool_names=T.ArrayType(S), message_count=L, payload_sha256=S,
    input_bytes=L, prompt_tokens_preflight=L,
)
RESPONSE = struct(
    index=L, http_status=L, models=T.ArrayType(S), response_ids=T.ArrayType(S),
    usage=struct(prompt_tokens=L, completion_tokens=L), reasoning_content_seen=B,
)
TOOL_CALL = struct(tool_call_id=S, name=S, arguments=T.MapType(S, S), result=T.MapType(S, S))
