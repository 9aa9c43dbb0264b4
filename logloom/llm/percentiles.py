"""Exact percentiles by group over very large columns (problem 7) by radix selection.

Each value is mapped to a 64-bit integer of the same order. A round counts one 16-bit digit of it by group, on the map side
first, and keeps for every wanted rank only the digit in which it falls; the next round counts the next digit among the values
that share the digits so far. Four rounds give the value itself. What is shuffled are counts, so a group with a third of all
rows costs no more than another, and no group is ever in one task.

The counts of any digit are sums: histograms of separate files or days combine by adding them (`digit_histogram`, `combine`).
Stopping after `bits` bits bounds the value from both sides (`bounds_from`): with 20 bits the relative error is under 2**-8.

Defined cases: null, NaN and infinite values have no rank; -0.0 is 0.0; a row delivered twice (same id) counts once; a
percentile is the value of rank ceil(p n), so it is always one of the values; an empty table gives no rows; a null source is a
group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.entries import source_key
from ..session import materialise

#: Percentiles in thousandths.
PERMILLE = (10, 50, 250, 500, 750, 900, 950, 990, 999)
DIGIT = 16
BROADCAST_ROWS = 100_000


@F.pandas_udf(T.LongType())
def ordered_bits(v):  # no type hints: Spark's default is Series to Series
    """An integer that orders as the value does, signed."""
    import numpy as np
    import pandas as pd

    b = (v.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b))


@F.pandas_udf(T.DoubleType())
def value_of_bits(k):
    import numpy as np
    import pandas as pd

    b = k.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view(np.float64))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def keyed(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The group columns and `k`, the ordered bits of the finite values."""
    v = F.col(value).cast("double")
    return df.where(_finite(v)).select(*groups, ordered_bits(v).alias("k"))


def digit_histogram(df: DataFrame, groups: Sequence[str], value: str, bits: int = 20) -> DataFrame:
    """Counts by group of the first `bits` bits: groups, prefix, n. Add them up over files or days to combine."""
    return keyed(df, groups, value).groupBy(*groups, F.shiftright("k", 64 - bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def combine(histograms: DataFrame, groups: Sequence[str]) -> DataFrame:
    return histograms.groupBy(*groups, "prefix").agg(F.sum("n").alias("n"))


def bounds_from(histogram: DataFrame, groups: Sequence[str], permille: Sequence[int] = PERMILLE, bits: int = 20) -> DataFrame:
    """Percentiles from counts alone, as the least and greatest value the digit may stand for: groups, n, permille, lo, hi."""
    rest = 64 - bits
    w = Window.partitionBy(*groups).orderBy("prefix")
    upto = histogram.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*groups)))
    asked = upto.withColumn("permille", F.explode(F.array(*map(F.lit, permille))))
    rank = F.floor((F.col("permille") * F.col("total") + 999) / 1000)
    low = F.shiftleft(F.col("prefix"), rest)
    return asked.where((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("n"))).select(
        *groups, F.col("total").alias("n"), "permille", value_of_bits(low).alias("lo"), value_of_bits(low + F.lit((1 << rest) - 1)).alias("hi")
    )


def select_ranks(df: DataFrame, groups: Sequence[str], value: str, permille: Sequence[int] = PERMILLE) -> DataFrame:
    """groups, n, permille, value: exact percentiles of the finite values."""
    names = list(groups)
    groups = [f"_c{i}" for i in range(len(names))]  # own names, so that none of the columns made here clashes
    renamed = df.select(*[F.col(n).alias(c) for n, c in zip(names, groups, strict=True)], F.col(value).alias("_value"))
    data = materialise(keyed(renamed, groups, "_value"))
    own = [f"_k{i}" for i in range(len(groups))]

    def matching(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Joined by group and parent; null groups are groups too."""
        same = left["parent"] == right["_parent"]
        for c, k in zip(groups, own, strict=True):
            same = same & left[c].eqNullSafe(right[k])
        return left.join(right, same, how)

    targets = None
    for r in range(1, 64 // DIGIT + 1):
        shift = 64 - DIGIT * r
        prefix, parent = F.shiftright("k", shift), F.shiftright("k", min(63, shift + DIGIT))
        if targets is None:
            hist = data.groupBy(*groups, prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).withColumn("parent", F.lit(0).cast("long"))
            total = F.sum("n").over(Window.partitionBy(*groups))
            ranks = F.transform(F.array(*map(F.lit, permille)), lambda p: F.struct(p.alias("permille"), F.floor((p * F.col("total") + 999) / 1000).alias("rank")))
            wanted = hist.withColumn("total", total).withColumn("ranks", ranks)
        else:
            asked = targets.groupBy(F.col("prefix").alias("_parent"), *[F.col(c).alias(k) for c, k in zip(groups, own, strict=True)], "total").agg(F.collect_list(F.struct("permille", "rank")).alias("ranks"))
            asked = materialise(asked)
            keys = asked.select("_parent", *own)
            keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
            kept = matching(data.select(*groups, parent.alias("parent"), prefix.alias("prefix")), keys, "left_semi")
            hist = kept.groupBy(*groups, "parent", "prefix").agg(F.count(F.lit(1)).alias("n"))
            wanted = matching(hist, asked, "inner").drop("_parent", *own)
        upto = F.sum("n").over(Window.partitionBy(*groups, "parent").orderBy("prefix"))  # at most 65,536 digits
        cut = wanted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        here = F.filter("ranks", lambda x: (x["rank"] > F.col("before")) & (x["rank"] <= F.col("upto")))
        found = cut.withColumn("hit", F.explode(here))
        targets = found.select(*groups, "total", "prefix", F.col("hit.permille").alias("permille"), (F.col("hit.rank") - F.col("before")).alias("rank"))
    return targets.select(*[F.col(c).alias(n) for n, c in zip(names, groups, strict=True)], F.col("total").alias("n"), "permille", value_of_bits(F.col("prefix")).alias("value"))


def latency_readings(entries: DataFrame) -> DataFrame:
    """source, day, latency_ms: every entry once."""
    return entries.select(
        "entry_id", source_key("source").alias("source"), F.to_date(F.col("received_at").cast("timestamp")).alias("day"), F.col("latency_ms").cast("double").alias("latency_ms")
    ).where("latency_ms is not null").dropDuplicates(["entry_id"]).drop("entry_id")


def by_source_and_day(entries: DataFrame, permille: Sequence[int] = PERMILLE) -> DataFrame:
    """Percentiles of each source for each day and, with a null day, for all days together."""
    both = latency_readings(entries).withColumn("day", F.explode(F.array(F.col("day"), F.lit(None).cast("date"))))
    return select_ranks(both, ["source", "day"], "latency_ms", permille)
