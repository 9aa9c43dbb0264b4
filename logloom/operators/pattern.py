"""Severity level, error code and custom tags of a line, as column expressions.

Null content has no level, code or tags; the leftmost match wins, whatever its severity.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NamedPattern
from ..functions.patterns import translate

# The patterns by which levels and error codes are known, and what some level words stand for.
LEVEL = r"(?i)\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|SEVERE)\b"
CODE = r"(?i)(?:error[_-]?code|err(?:or)?|code|status)[=:\s]*([A-Z]*\d+[A-Z0-9_-]*)|\b([A-Z]{1,3}[-_]?\d{3,5})\b"
STANDS_FOR = {"WARNING": "WARN", "CRITICAL": "FATAL", "SEVERE": "ERROR"}


def level_of(content: Column) -> Column:
    word = F.upper(F.regexp_extract(content, LEVEL, 1))
    out = F.when(word != "", word)
    for k, v in STANDS_FOR.items():
        out = F.when(word == k, v).otherwise(out)
    return out


def error_code_of(content: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(content, CODE, 1), F.lit("")), F.nullif(F.regexp_extract(content, CODE, 2), F.lit("")))


def tags_of(content: Column, patterns: Iterable[NamedPattern]) -> Column:
    """A map of tags: `pattern_group` for each named group, else `pattern` for the first group or the whole match.

    A group that took no part and a group that matched nothing add no tag.
    """
    pairs = []
    for p in patterns:
        known = translate(p.pattern)
        if known is None:
            continue
        if known.names:
            pairs += [(f"{p.name}_{n}", i, known.text) for n, i in known.names]
        else:
            pairs.append((p.name, min(known.groups, 1), known.text))
    if not pairs:
        return F.create_map().cast("map<string,string>")
    found = F.array(*[F.struct(F.lit(k).alias("key"), F.nullif(F.regexp_extract(content, text, i), F.lit("")).alias("value")) for k, i, text in pairs])
    return F.coalesce(F.map_from_entries(F.filter(found, lambda x: x["value"].isNotNull())), F.create_map().cast("map<string,string>"))


def with_level(df: DataFrame, content: str = "content", enabled: bool = True) -> DataFrame:
    return df.withColumn("level", level_of(F.col(content)) if enabled else F.lit(None).cast("string"))


def with_error_code(df: DataFrame, content: str = "content", enabled: bool = True) -> DataFrame:
    return df.withColumn("error_code", error_code_of(F.col(content)) if enabled else F.lit(None).cast("string"))


def with_tags(df: DataFrame, patterns: Iterable[NamedPattern], content: str = "content") -> DataFrame:
    return df.withColumn("tags", tags_of(F.col(content), patterns))
