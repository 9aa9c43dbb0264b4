"""How an enriched line reads on a console, in a text file, as JSON and as a pushed line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entries import source_uri
from ..operators.security import debug_name


def stamp(ts: Column | str, digits: int = 3) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd HH:mm:ss." + "S" * digits)


def _flags() -> Column:
    return F.when(F.size("security_flags") > 0, F.concat(F.lit("[SECURITY:"), F.array_join(F.transform("security_flags", debug_name), ","), F.lit("]")))


def _boxed(c: Column | str) -> Column:
    return F.concat(F.lit("["), F.col(c) if isinstance(c, str) else c, F.lit("]"))


def two_digits(v: Column) -> Column:
    """With two digits after the point, rounded from the exact binary value, a tie to the even digit."""
    return F.call_function("format_number", v, F.lit("0.00"))


def text_line(with_code: bool = True) -> Column:
    """`[time] [source] [LEVEL] [code:X] [n.nnms] [SECURITY:A,B] content`; what is absent is left out. Files leave out the code."""
    code = [F.when(F.col("error_code").isNotNull(), F.concat(F.lit("[code:"), F.col("error_code"), F.lit("]")))] if with_code else []
    latency = F.when(F.col("latency_ms").isNotNull(), F.concat(F.lit("["), two_digits(F.col("latency_ms")), F.lit("ms]")))
    return F.concat_ws(" ", _boxed(stamp("received_at")), _boxed(source_uri("source")), _boxed("level"), *code, latency, _flags(), F.col("content"))


def json_source(source: str = "source") -> Column:
    """`"stdin"`, or an object with the kind as its key."""
    s = F.col(source)
    inner = F.when(s["kind"] == "file", F.to_json(F.struct(s["path"]))).otherwise(F.to_json(F.struct(s["addr"])))
    return F.when(s["kind"] == "stdin", F.lit('"stdin"')).otherwise(F.concat(F.lit('{"'), s["kind"], F.lit('":'), inner, F.lit("}")))


def json_line(df: DataFrame) -> Column:
    """The enriched line as JSON: nulls, empty flags and empty tags left out, empty metadata kept."""
    flag = lambda f: F.when(f["flag"] == "sensitive_data", F.concat(F.lit('{"sensitive_data":'), F.to_json(F.struct(f["pattern_name"].alias("pattern_name"))), F.lit("}"))).otherwise(F.concat(F.lit('"'), f["flag"], F.lit('"')))
    structured = F.to_json("structured") if dict(df.dtypes).get("structured") == "variant" else F.col("structured")
    member = lambda key, json: F.when(json.isNotNull(), F.concat(F.lit(f'"{key}":'), json))
    text = lambda c: F.when(F.col(c).isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))
    parts = [
        member("received_at", F.concat(F.lit('"'), F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"'))),
        member("source", json_source()),
        member("content", text("content")),
        member("metadata", F.coalesce(F.to_json("metadata"), F.lit("{}"))),
        member("level", text("level")),
        member("error_code", text("error_code")),
        member("latency_ms", F.col("latency_ms").cast("string")),
        member("security_flags", F.when(F.size("security_flags") > 0, F.concat(F.lit("["), F.array_join(F.transform("security_flags", flag), ","), F.lit("]")))),
        member("structured", structured),
        member("tags", F.when(F.size("tags") > 0, F.to_json("tags"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def console_format(name: str) -> str:
    return name if name in ("json", "raw") else "pretty"


def file_format(name: str) -> str:
    return "json" if name == "json" else "text" if name in ("text", "txt", "plain") else "jsonl"


def render(df: DataFrame, fmt: str, to_file: bool = False) -> DataFrame:
    """One column `value` with the line in the format asked for."""
    if to_file:
        line = text_line(with_code=False) if file_format(fmt) == "text" else json_line(df)
    else:
        kind = console_format(fmt)
        line = json_line(df) if kind == "json" else F.col("content") if kind == "raw" else text_line()
    return df.select(line.alias("value"))
