"""Rotated and compressed line files: a directory a day or an hour, parts of bounded size, retention by age."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FileOutput
from .formats import file_format, json_line, text_line

# Bytes of each unit, and what an unreadable size counts as.
UNITS = (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10), ("B", 1))
FALLBACK = 100


def parse_size(text: str) -> int:
    """Bytes of `100MB`, `1GB`, `500KB`, `1024B`; a bare number is megabytes; an unreadable number counts as 100."""
    s = text.strip().upper()
    for unit, n in UNITS:
        if s.endswith(unit):
            number = s[: -len(unit)].strip()
            return int(number) * n if number.isdigit() else FALLBACK * n
    return int(s) * (1 << 20) if s.isdigit() else FALLBACK * (1 << 20)


def rotation_of(name: str) -> str:
    return {"daily": "daily", "hourly": "hourly", "size": "size", "none": "none", "disabled": "none"}.get(name, "daily")


def dated_path(path: str, stamp: str) -> str:
    """`/var/log/app.log` and `2024-01-15` give `/var/log/app-2024-01-15.log`."""
    p = Path(path)
    return str(p.with_name(f"{p.stem}-{stamp}{p.suffix}"))


def with_rotation(df: DataFrame, rotation: str, zone: str = "UTC") -> tuple[DataFrame, list[str]]:
    """The partition columns of a rotation, by the wall clock of `zone`."""
    local = F.from_utc_timestamp(F.col("received_at"), zone) if zone != "UTC" else F.col("received_at")
    kind = rotation_of(rotation)
    if kind in ("daily", "hourly"):
        df = df.withColumn("date", F.date_format(local, "yyyy-MM-dd"))
    if kind == "hourly":
        df = df.withColumn("hour", F.date_format(local, "HH"))
    return df, {"daily": ["date"], "hourly": ["date", "hour"]}.get(kind, [])


def write_lines(enriched: DataFrame, config: FileOutput, mode: str = "append") -> int:
    """Append the lines below the configured path and return their bytes. Rotation by size bounds the lines a file, from the mean
    length of a line."""
    dated, by = with_rotation(enriched, config.rotation, config.zone)
    lines = dated.select(*by, file_line(dated, config.format).alias("value"))
    written = Observation()
    observed = lines.observe(written, F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))
    writer = observed.write.mode(mode).option("compression", "gzip" if config.compress else "none")
    if rotation_of(config.rotation) == "size":
        mean = lines.agg(F.avg(F.octet_length("value") + 1)).first()[0] or 1
        writer = writer.option("maxRecordsPerFile", max(1, int(parse_size(config.max_size) / mean)))
    (writer.partitionBy(*by) if by else writer).text(config.path)
    return written.get["bytes"]


def file_line(df: DataFrame, fmt: str) -> Column:
    return text_line(with_code=False) if file_format(fmt) == "text" else json_line(df)


def beyond_newest(files: DataFrame, keep: int, at: str, tie: str, groups: Sequence[str] = ()) -> DataFrame:
    """The rows of a listing that retention removes: all but the `keep` newest of each group. A row listed twice counts once."""
    own = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(at), F.desc(tie)))
    return files.dropDuplicates([*groups, tie]).withColumn("_newer", own).where(F.col("_newer") > keep).drop("_newer")


def listing(spark: SparkSession, config: FileOutput) -> DataFrame:
    """What a rotation has made below the path, as unit and mtime: the folders of days or hours, or the files of a rotation by size.
    A listing has a row a file, whatever the files hold."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(config.path)
    fs = root.getFileSystem(conf)
    units: dict[str, int] = {}
    if fs.exists(root):
        found = fs.listFiles(root, True)
        while found.hasNext():
            f = found.next()
            path = f.getPath()
            if path.getName().startswith(("_", ".")):
                continue
            unit = (path if rotation_of(config.rotation) == "size" else path.getParent()).toString()
            units[unit] = max(units.get(unit, 0), f.getModificationTime())
    return spark.createDataFrame(list(units.items()), "unit string, mtime bigint")


def retain(spark: SparkSession, config: FileOutput) -> list[str]:
    """Remove all but the `max_files` newest days, hours or files below the path; what was removed. Without rotation all stays."""
    if rotation_of(config.rotation) == "none":
        return []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    # Folders are named by their time, which late lines written into an old one don't change.
    order = "mtime" if rotation_of(config.rotation) == "size" else "unit"
    gone = [r["unit"] for r in beyond_newest(listing(spark, config), config.max_files, order, "unit").collect()]
    for unit in gone:
        path = jvm.org.apache.hadoop.fs.Path(unit)
        path.getFileSystem(conf).delete(path, True)
    return gone
