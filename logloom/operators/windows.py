"""Statistics of latencies: trailing windows in a batch, groups, and the report of a window.

A trailing window of d holds the values with a time after t - d, up to and including t. Values count in whole microseconds, as
the histograms of a running engine keep them: fractions are dropped, negative values are zero, and those over a minute are left out.

Trailing windows are cut into blocks of time: a block holds its own rows and, as a margin, those of the block before that its
windows reach back to. So neither a key with a third of all rows nor a window over all rows ends up in one task. All windows share
the blocks of the longest one, so rows are shuffled and sorted once. Where counts, sums and extremes are enough,
`bucketed_rolling` sums up seconds first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latency import parse_duration

LIMIT_US = 60_000_000

#: Length of a block of time, in windows: its margin adds an eighth to the rows.
BLOCK_WINDOWS = 8


def to_micros(ms: Column) -> Column:
    """Whole microseconds as the histograms keep them, or null beyond their limit."""
    us = F.floor(F.greatest(ms * 1000, F.lit(0.0)))
    return F.when(ms * 1000 < LIMIT_US + 1, us)


def to_millis(ms: Column) -> Column:
    return to_micros(ms) / 1000


def in_blocks(df: DataFrame, at: str, reach: int, least: int = 0) -> DataFrame:
    """Each row in its block, `_b`, and once more as the `_margin` of the next block if windows of `reach` reach back to it."""
    length = max(BLOCK_WINDOWS * reach, least)
    block = F.floor(F.col(at) / length)
    margin = F.when(F.col(at) > (block + 1) * length - reach, F.struct((block + 1).alias("b"), F.lit(True).alias("margin")))
    placed = df.withColumn("_in", F.explode(F.array_compact(F.array(F.struct(block.alias("b"), F.lit(False).alias("margin")), margin))))
    return placed.withColumns({"_b": F.col("_in.b"), "_margin": F.col("_in.margin")}).drop("_in")


def rolling_stats(df: DataFrame, ts: str, value: str, windows: Sequence[str], percentiles: Sequence[int] = (50, 90, 95, 99), keys: Sequence[str] = ()) -> DataFrame:
    """Each row once a window, with count, min_ms, max_ms, mean_ms and percentiles of the trailing window that ends with it."""
    named = [(w, us) for w in windows if (us := parse_duration(w)) is not None]
    base = df.withColumns({"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_v": to_millis(F.col(value))})
    placed = in_blocks(base, "_at", max(us for _, us in named), 60_000_000)
    v = F.col("_v")

    def stats(name: str, us: int) -> Column:
        w = Window.partitionBy(*keys, "_b").orderBy("_at").rangeBetween(-(us - 1), 0)
        ranks = [F.percentile_approx(v, F.lit(p / 100), F.lit(100_000)).over(w).alias(f"p{p}_ms") for p in percentiles]
        return F.struct(F.lit(name).alias("window"), F.count(v).over(w).alias("count"), F.min(v).over(w).alias("min_ms"), F.max(v).over(w).alias("max_ms"), F.avg(v).over(w).alias("mean_ms"), *ranks)

    framed = placed.withColumns({f"_w{i}": stats(name, us) for i, (name, us) in enumerate(named)}).where("not _margin")
    return framed.withColumn("_s", F.explode(F.array(*[f"_w{i}" for i in range(len(named))]))).select(*df.columns, "_s.*")


def bucketed_rolling(df: DataFrame, ts: str, value: str, window_us: int, bucket_us: int = 1_000_000) -> DataFrame:
    """Trailing count, sum, min and max at the end of each bucket, over all rows: a task sees the buckets of a block of time."""
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / bucket_us)
    v = to_millis(F.col(value))
    sums = df.select(bucket.alias("bucket"), v.alias("_v")).where("_v is not null").groupBy("bucket").agg(F.count("_v").alias("n"), F.sum("_v").alias("s"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    reach = window_us // bucket_us
    w = Window.partitionBy("_b").orderBy("bucket").rangeBetween(-(reach - 1), 0)
    placed = in_blocks(sums, "bucket", reach, 3600)
    return placed.select("bucket", "_margin", F.sum("n").over(w).alias("count"), F.sum("s").over(w).alias("sum_ms"), F.min("lo").over(w).alias("min_ms"), F.max("hi").over(w).alias("max_ms")).where("not _margin").drop("_margin")


def window_stats(df: DataFrame, value: str, percentiles: Sequence[int] = (50, 90, 95, 99), keys: Sequence[str] = ()) -> DataFrame:
    """One record a group: count, min, max, mean and an array of (percentile, value_ms) by nearest rank; zeros and no percentiles if empty."""
    v = to_millis(F.col(value))
    ranks = [F.struct(F.lit(p).cast("smallint").alias("percentile"), F.percentile_approx(v, F.lit(p / 100), F.lit(100_000)).alias("value_ms")) for p in percentiles]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count(v).alias("count"), zero(F.min(v)).alias("min_ms"), zero(F.max(v)).alias("max_ms"), zero(F.avg(v)).alias("mean_ms"), F.filter(F.array(*ranks), lambda r: r["value_ms"].isNotNull()).alias("percentiles")
    )


def report_line(percentiles: Column) -> Column:
    """`P50=1.00ms, P90=...` of an array of (percentile, value_ms)."""
    return F.array_join(F.transform(percentiles, lambda p: F.concat(F.lit("P"), p["percentile"].cast("string"), F.lit("="), F.call_function("format_number", p["value_ms"], F.lit("0.00")), F.lit("ms"))), ", ")
