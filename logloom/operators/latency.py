"""Latency in milliseconds from a line. The first pattern that matches decides, even if its number can't be read."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PerformanceMetrics
from ..functions.patterns import translate

log = logging.getLogger(__name__)

# Milliseconds in a unit; any other unit counts as milliseconds.
UNITS = {
    1 / 1000: ("us", "µs", "micros", "microseconds"),
    1.0: ("ms", "millis", "milliseconds"),
    1000.0: ("s", "sec", "secs", "seconds"),
    60_000.0: ("m", "min", "mins", "minutes"),
}
DEFAULT_PATTERNS = tuple(PerformanceMetrics().latency_patterns)


def to_ms(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin(*UNITS[1 / 1000]), value / 1000).when(u.isin(*UNITS[1000.0]), value * 1000).when(u.isin(*UNITS[60_000.0]), value * 60_000).otherwise(value)


def latency_of(content: Column, patterns: Sequence[str] = DEFAULT_PATTERNS) -> Column:
    out = F.lit(None).cast("double")
    for p in reversed(list(patterns)):
        known = translate(p)
        if known is None or known.groups == 0:
            continue
        value = F.regexp_extract(content, known.text, known.place("duration") or 1)
        at = known.place("unit") or (2 if known.groups >= 2 else None)
        unit = F.regexp_extract(content, known.text, at) if at else F.lit("")
        number = F.when(value.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), value.try_cast("double"))
        out = F.when(content.rlike(known.text), to_ms(number, unit)).otherwise(out)
    return out


def with_latency(df: DataFrame, patterns: Sequence[str] = DEFAULT_PATTERNS, content: str = "content") -> DataFrame:
    return df.withColumn("latency_ms", latency_of(F.col(content), patterns))


def parse_duration(text: str) -> int | None:
    """Microseconds of `30s`, `5m`, `1h`, `2d` or a bare number of minutes; None for anything else."""
    m = re.fullmatch(r"\s*(\d+)([smhd]?)\s*", text)
    if not m:
        log.warning("window left out: %r", text)
        return None
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "": 60}[m[2]] * 1_000_000
