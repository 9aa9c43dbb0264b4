"""Structured fields of a line: JSON, key=value, access log (Apache/Nginx combined) and syslog.

The result is a VARIANT. Detection looks at the trimmed line and prefers JSON, then access log, syslog and key=value (two pairs at
least). JSON is strict: the whole trimmed text must be one value. A line without a known format, and null content, give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of each format.
PAIR = r"""(\w+)=(?:"([^"]*)"|'([^']*)'|(\S+))"""
ACCESS = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s*([^"]*)"\s+(\d+)\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
SYSLOG = r"^(?:<(\d+)>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s*(.*)$"

FORMATS = {"json": "json", "kv": "kv", "key_value": "kv", "apache": "apache", "apache_combined": "apache", "nginx": "apache", "syslog": "syslog"}


def trimmed(content: Column) -> Column:
    return F.regexp_replace(content, r"^\s+|\s+$", "")


def json_of(content: Column) -> Column:
    """The one JSON value of the trimmed text. Read inside brackets, text after the value makes the whole invalid."""
    inside = F.concat(F.lit("["), trimmed(content), F.lit("]"))
    return F.when(F.json_array_length(inside) == 1, F.try_variant_get(F.try_parse_json(inside), "$[0]", "variant"))


def is_json(content: Column) -> Column:
    t = trimmed(content)
    return ((t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))) & json_of(content).isNotNull()


def pair_count(content: Column) -> Column:
    return F.regexp_count(content, F.lit(PAIR))


def format_of(content: Column) -> Column:
    t = trimmed(content)
    return F.when(content.isNull(), None).when(is_json(content), "json").when(t.rlike(ACCESS), "apache").when(t.rlike(SYSLOG), "syslog").when(pair_count(t) >= 2, "kv").otherwise("unknown")


def value_kind(value: Column) -> Column:
    """What a value reads as: integer, float, boolean or string. Forms that only Java takes for numbers stay strings."""
    whole = value.rlike(r"^[+-]?\d+$") & value.try_cast("bigint").isNotNull()
    number = value.rlike(r"(?i)^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$") | value.rlike(r"(?i)^[+-]?(?:nan|inf|infinity)$")
    return F.when(whole, "integer").when(number, "float").when(value.isin("true", "false"), "boolean").otherwise("string")


def typed(value: Column) -> Column:
    kind = value_kind(value)
    special = value.rlike(r"(?i)^[+-]?(?:nan|inf|infinity)$")
    return (
        F.when(kind == "integer", value.try_cast("bigint").cast("variant"))
        .when(special, F.lit(0).cast("bigint").cast("variant"))
        .when(kind == "float", value.try_cast("double").cast("variant"))
        .when(kind == "boolean", (value == "true").cast("variant"))
        .otherwise(value.cast("variant"))
    )


def pairs_of(content: Column) -> Column:
    """All pairs as an array of key and value text, in order; quoted values without their quotes."""
    at = lambda i: F.regexp_extract_all(content, F.lit(PAIR), F.lit(i))
    zipped = F.arrays_zip(at(1).alias("key"), at(2).alias("d"), at(3).alias("s"), at(4).alias("b"))
    return F.transform(zipped, lambda p: F.struct(p["key"].alias("key"), F.concat(p["d"], p["s"], p["b"]).alias("value")))


def key_value_of(content: Column) -> Column:
    """All pairs of the untrimmed line as an object of typed values, the last of equal keys; null without a pair."""
    pairs = pairs_of(content)
    entries = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), typed(p["value"]).alias("value")))
    return F.when(F.size(pairs) > 0, F.to_variant_object(F.map_from_entries(entries)))


def access_fields(content: Column) -> Column:
    """The fields of an access line as a struct: `-` and an empty protocol are null, so are numbers out of range."""
    t = trimmed(content)
    g = lambda i: F.regexp_extract(t, ACCESS, i)
    dash = lambda c: F.when(c != "-", c)
    agent = t.rlike(ACCESS.replace(r'(?:\s+"([^"]*)"\s+"([^"]*)")?', r'\s+"[^"]*"\s+"[^"]*"'))
    return F.when(
        t.rlike(ACCESS),
        F.struct(
            g(1).alias("client_ip"), dash(g(2)).alias("ident"), dash(g(3)).alias("user"), g(4).alias("timestamp"), g(5).alias("method"), g(6).alias("path"),
            F.nullif(g(7), F.lit("")).alias("protocol"), F.when(g(8).try_cast("int").between(0, 65535), g(8).try_cast("int")).alias("status"),
            F.when(g(9).rlike(r"^\+?\d+$"), g(9).try_cast("decimal(20,0)")).alias("bytes"), F.when(agent, dash(g(10))).alias("referrer"), F.when(agent, g(11)).alias("user_agent"),
            F.lit("apache_combined").alias("_format"),
        ),
    )


def syslog_fields(content: Column) -> Column:
    t = trimmed(content)
    g = lambda i: F.regexp_extract(t, SYSLOG, i)
    priority = F.when(g(1).try_cast("int").between(0, 255), g(1).try_cast("int"))
    return F.when(
        t.rlike(SYSLOG),
        F.struct(
            priority.alias("priority"), F.floor(priority / 8).cast("int").alias("facility"), (priority % 8).alias("severity"), g(2).alias("timestamp"), g(3).alias("hostname"),
            trimmed(g(4)).alias("process"), F.when(g(5).try_cast("bigint").between(0, 4294967295), g(5).try_cast("bigint")).alias("pid"), g(6).alias("message"), F.lit("syslog").alias("_format"),
        ),
    )


def _object(fields: Column) -> Column:
    """A VARIANT object of a struct's fields that are present."""
    return F.when(fields.isNotNull(), F.try_parse_json(F.to_json(fields)))


def structured_of(content: Column, auto_detect: bool = True, fmt: str = "auto") -> Column:
    of = {"json": json_of(content), "apache": _object(access_fields(content)), "syslog": _object(syslog_fields(content)), "kv": key_value_of(content)}
    if not auto_detect:
        return of.get(FORMATS.get(fmt, ""), F.lit(None).cast("variant"))
    kind = format_of(content)
    return F.when(kind == "json", of["json"]).when(kind == "apache", of["apache"]).when(kind == "syslog", of["syslog"]).when(kind == "kv", of["kv"])


def with_structured(df: DataFrame, auto_detect: bool = True, fmt: str = "auto", content: str = "content") -> DataFrame:
    return df.withColumn("structured", structured_of(F.col(content), auto_detect, fmt))
