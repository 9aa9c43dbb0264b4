"""Raw lines from texts, files and packets, each with the rule its source has for blank lines.

Standard input and TCP skip empty lines only; a packet is trimmed and cut at line ends; files drop trailing blanks and skip lines
of nothing but blanks. Invalid UTF-8 is replaced in files and lines, and drops a whole packet.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW


def _source(kind: str, addr: Column | None = None, path: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (null if addr is None else addr).alias("addr"), (null if path is None else path).alias("path"))


def as_raw(df: DataFrame, source: Column, content: Column | str = "content") -> DataFrame:
    """The four columns of a raw line, received now."""
    c = F.col(content) if isinstance(content, str) else content
    return df.select(F.current_timestamp().alias("received_at"), source.alias("source"), c.alias("content"), F.create_map().cast("map<string,string>").alias("metadata"))


def stdin_lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Lines that the driver read; empty ones are skipped."""
    rows = [(x.rstrip("\n").removesuffix("\r"),) for x in lines]
    return as_raw(spark.createDataFrame(rows, "content string").where("content <> ''"), _source("stdin"))


def file_lines(df: DataFrame, content: str = "value") -> DataFrame:
    """The rule of files on any column of lines."""
    return df.withColumn(content, F.regexp_replace(content, r"\s+$", "")).where(F.col(content).rlike(r"\S"))


def packet_lines(df: DataFrame, packet: str) -> DataFrame:
    """A row for each line of a packet that isn't empty, with its place: `pos` and `content`."""
    cut = F.split(F.regexp_replace(packet, r"^\s+|\s+$", ""), r"\r?\n")
    return df.select("*", F.posexplode(cut).alias("pos", "content")).where("content <> ''")


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All lines of the files that the patterns match, from their beginning. No match gives no rows."""
    found = [p for p in dict.fromkeys(paths) if _matches(spark, p)]
    if not found:
        return spark.createDataFrame([], RAW)
    text = spark.read.text(found).select("value", F.regexp_replace(F.col("_metadata.file_path"), "^file:(?://)?", "").alias("path"))
    kept = file_lines(text)
    return as_raw(kept, _source("file", path=F.col("path")), "value")


def stream_files(spark: SparkSession, folder: str, pattern: str = "*", max_files: int | None = None) -> DataFrame:
    """Lines of files as they appear in a folder; new files are read at once."""
    reader = spark.readStream.format("text").option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = reader.load(folder).select("value", F.regexp_replace(F.col("_metadata.file_path"), "^file:(?://)?", "").alias("path"))
    return as_raw(file_lines(text), _source("file", path=F.col("path")), "value")


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    try:
        return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))
    except Exception:  # a pattern that can't be read matches nothing
        return False


def union(sources: Sequence[DataFrame]) -> DataFrame:
    """Union all of the enabled sources."""
    return reduce(DataFrame.unionByName, sources)
