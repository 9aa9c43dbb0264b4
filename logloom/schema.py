"""The two row types of the engine: a raw line and the enriched line, and their batch equivalents with text instead of VARIANT."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "addr", "path")])
FLAG = T.StructType([T.StructField("flag", T.StringType()), T.StructField("pattern_name", T.StringType())])
RAW = T.StructType(
    [
        T.StructField("received_at", T.TimestampType()),
        T.StructField("source", SOURCE),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
ENRICHED = T.StructType(
    [
        *RAW.fields,
        T.StructField("level", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("security_flags", T.ArrayType(FLAG)),
        T.StructField("structured", T.VariantType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
