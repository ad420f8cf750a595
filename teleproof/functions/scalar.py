"""Column functions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "no reading".
NULL_TOKENS = ["", "NA", "NaN", "nan", "null"]
# Unit of a channel by the first letter of its name.
CHANNEL_UNITS = {"U": "V", "I": "A", "P": "W", "T": "degC"}
# Unit of a quality metric.
METRIC_UNITS = {
    "rows": "records",
    "duplicate_extra_rows": "records",
    "conflicting_timestamp_groups": "timestamp_groups",
    "conflict_channel_count": "channels",
    "time_reversals": "intervals",
    "gaps_gt_1s": "intervals",
    "max_gap_s": "s",
    "elapsed_span_s": "s",
}
# Words that never belong in a public artifact.
PRIVATE_TOKENS = ["expected_verdict", "expected_value", "source_hashes", "telemetry_path", "anomalylabel"]
# Identifier format.
IDENTIFIER = "^[A-Za-z][A-Za-z0-9_-]{0,79}$"
# What a number looks like.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
# Strptime directives and the matching Spark datetime letters.
TIME_DIRECTIVES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS",
    "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh", "%z": "XX",
}

QUALITY_METRICS = list(METRIC_UNITS)


def spark_pattern(directives: str) -> str:
    """Datetime pattern of a strptime format; a configuration value, translated once. Other letters stand for themselves."""

    def translated(part: re.Match) -> str:
        text = part[0]
        if text.startswith("%"):
            if text == "%%":
                return "%"
            if text not in TIME_DIRECTIVES:
                raise ValueError(f"unknown time directive {text}")
            return TIME_DIRECTIVES[text]
        return "''" if text == "'" else f"'{text}'"

    return re.sub(r"%.|[A-Za-z]+|'", translated, directives)


def ntz_seconds(ts: Column) -> Column:
    """Seconds of a zone-less timestamp on its own axis.

    Built from calendar fields, so no session time zone or daylight saving rule takes part.
    """
    minutes = F.unix_date(F.to_date(ts)).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (minutes * 60_000_000 + micros) / F.lit(1e6)


def parse_time(text: Column, kind: str = "datetime", pattern: str | None = None) -> Column:
    """Text to seconds: plain numbers, ISO text (a zone counts, none means a local axis), or a given pattern."""
    if kind == "seconds":
        seconds = written_number(F.trim(text))
        return F.when(is_finite(seconds), seconds)
    if pattern:
        zoned = "%z" in pattern
        fmt = F.lit(spark_pattern(pattern))
        if zoned:
            return F.unix_micros(F.try_to_timestamp(text, fmt)) / F.lit(1e6)
        return ntz_seconds(F.try_to_timestamp(text, fmt).cast("timestamp_ntz"))
    zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zone, F.unix_micros(text.try_cast("timestamp")) / F.lit(1e6)).otherwise(
        ntz_seconds(text.try_cast("timestamp_ntz"))
    )


def is_finite(value: Column) -> Column:
    # NaN is above every number. The value stands here once, as it may be costly.
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def written_number(text: Column) -> Column:
    """Text in decimal notation, or a written infinity, as a double; type suffixes and hexadecimal forms are no numbers."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_number(token: Column) -> Column:
    """Null token or unreadable text to null; see ``number_status`` for which of the two it was."""
    clean = F.trim(token)
    return number_of(clean, written_number(clean))


def number_of(clean: Column, number: Column) -> Column:
    """``parse_number`` of a trimmed token whose ``written_number`` is known."""
    return F.when(~clean.isin(NULL_TOKENS) & is_finite(number), number)


def number_status(token: Column) -> Column:
    clean = F.trim(token)
    return status_of(clean, written_number(clean))


def status_of(clean: Column, number: Column) -> Column:
    """``number_status`` of a trimmed token whose ``written_number`` is known."""
    return (
        F.when(clean.isin(NULL_TOKENS), "missing")
        .when(number.isNull(), "not_a_number")
        .when(~is_finite(number), "non_finite")
        .otherwise("ok")
    )


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def close_to(a: Column, b: Column, rel: float, absolute: float) -> Column:
    """Tolerance compare; null agrees with null only."""
    near = F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def digest_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """Content id: prefix and the first hex digits of a digest over the parts.

    Numbers enter by their Spark text form, so ids are stable inside this engine only.
    """
    tagged = [F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *tagged), 256), 1, length))


def unit_of(channel: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CHANNEL_UNITS.items() for x in pair])
    return F.when(channel.rlike("^[UIPT]_"), F.element_at(table, F.substring(channel, 1, 1)))


def fold_case(text: Column) -> Column:
    """Full case folding: sharp s counts as ss, ligatures as their letters, and a final sigma as any other."""
    # The optimizer takes lower(upper(x)) for lower(x), so the sigma is handled between the two.
    return F.lower(F.translate(F.upper(text), "Σ", "σ"))


def extension_of(path: Column) -> Column:
    """Lower-cased suffix of the last path part, ``(none)`` without one."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^./]+)$", 1))
    return F.when(suffix == "", "(none)").otherwise(suffix)


def small_median(values: Column, size: int) -> Column:
    """Median of an array of known small length."""
    ordered = F.array_sort(values)
    if size % 2:
        return F.get(ordered, F.lit(size // 2))
    return (F.get(ordered, F.lit(size // 2 - 1)) + F.get(ordered, F.lit(size // 2))) / F.lit(2.0)
