"""Rolling statistics of a stream by the time of processing, and fan-out of a stream to several sinks.

What a window holds are counts by slot of time and by cell of the value, not the values, so its size is bounded by the width of the
window and the number of cells (some 17,000), whatever the number of lines. A cell holds the microseconds that agree in three
significant figures, by powers of two as the usual histograms of high dynamic range have them.

`Rolling` is the state of the running engine, on the driver: of each batch it takes the sums by cell. `rolling_stream` keeps the state
by key in Spark's own state store; every task sums up its lines before they are shuffled, so a key with a third of all lines, or the
one key of a stream without keys, sends sums only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.latency import parse_duration
from ..operators.windows import to_micros

STATS = "key string, window string, count bigint, min_ms double, max_ms double, mean_ms double, percentiles array<struct<percentile:smallint,value_ms:double>>"

#: Figures of a value that its cell keeps, in bits, and slots of time in the longest window.
FIGURES, SLOTS = 11, 900


def cell_of(us: Column) -> Column:
    """The least number of the cell of a number of microseconds."""
    drop = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(us, F.lit(1)))).cast("int") - (FIGURES - 1))
    return us - F.pmod(us, F.pow(F.lit(2), drop).cast("bigint"))


def sums_by_cell(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, cell, n, total, lo and hi of rows with `us`."""
    return rows.groupBy(*keys, cell_of(F.col("us")).alias("cell")).agg(F.count("us").alias("n"), F.sum("us").alias("total"), F.min("us").alias("lo"), F.max("us").alias("hi"))


def merged(into: dict[int, list], cells: Iterable[tuple]) -> dict[int, list]:
    """Cells (cell, n, total, lo, hi) added to those by number."""
    for cell, n, total, lo, hi in cells:
        b = into.get(cell)
        into[cell] = [n, total, lo, hi] if b is None else [b[0] + n, b[1] + total, min(b[2], lo), max(b[3], hi)]
    return into


def summary(cells: dict[int, list], percentiles: Sequence[int]) -> dict[str, Any]:
    """count, extremes, mean and nearest-rank percentiles in milliseconds; zeros and no percentiles where there is nothing."""
    n = sum(b[0] for b in cells.values())
    if n == 0:
        return {"count": 0, "min_ms": 0.0, "max_ms": 0.0, "mean_ms": 0.0, "percentiles": []}
    order, ranks, seen, i = sorted(cells), [], 0, 0
    for p in sorted(percentiles):
        rank = max(1, -(-p * n // 100))
        while seen + cells[order[i]][0] < rank:
            seen += cells[order[i]][0]
            i += 1
        ranks.append({"percentile": p, "value_ms": cells[order[i]][3] / 1000})
    return {
        "count": n, "min_ms": min(b[2] for b in cells.values()) / 1000, "max_ms": max(b[3] for b in cells.values()) / 1000,
        "mean_ms": sum(b[1] for b in cells.values()) / n / 1000, "percentiles": ranks,
    }


def seconds_of(windows: Sequence[str]) -> list[tuple[str, float]]:
    return [(w, us / 1_000_000) for w in windows if (us := parse_duration(w)) is not None]


class Rolling:
    """The windows of the running engine: all lines, by the time at which they were processed. What has left a window goes when
    something is recorded, so an idle engine goes on reporting its last state."""

    def __init__(self, windows: Sequence[str], percentiles: Sequence[int], clock: Callable[[], float] = time.time) -> None:
        self.windows, self.percentiles, self.clock = seconds_of(windows), tuple(percentiles), clock
        self.slots: dict[float, dict[int, list]] = {}
        self.now = clock()

    def record(self, enriched: DataFrame) -> None:
        """The latencies of a batch. What comes to the driver are sums by cell, some 17,000 rows at most."""
        rows = enriched.select(to_micros(F.col("latency_ms")).alias("us")).where("us is not null")
        self.add([tuple(r) for r in sums_by_cell(rows).collect()])

    def add(self, cells: list[tuple]) -> None:
        if not self.windows or not cells:
            return
        self.now = self.clock()
        longest = max(s for _, s in self.windows)
        width = max(longest / SLOTS, 0.001)
        merged(self.slots.setdefault(self.now // width * width, {}), cells)
        self.slots = {at: c for at, c in self.slots.items() if at > self.now - longest - width}

    def stats(self) -> list[dict[str, Any]]:
        out = []
        for name, seconds in self.windows:
            cells: dict[int, list] = {}
            for at, c in self.slots.items():
                if at > self.now - seconds:
                    merged(cells, ((k, *b) for k, b in c.items()))
            out.append({"window": name, **summary(cells, self.percentiles)})
        return out

    def report(self) -> list[str]:
        """A line for each window that isn't empty."""
        return [
            f"window={s['window']} count={s['count']} min_ms={s['min_ms']:.2f} max_ms={s['max_ms']:.2f} mean_ms={s['mean_ms']:.2f} percentiles={', '.join('P{percentile}={value_ms:.2f}ms'.format(**p) for p in s['percentiles'])}"
            for s in self.stats()
            if s["count"]
        ]


class RollingStats(StatefulProcessor):
    """Keeps, for one key, the cells of each slot of time; gives the statistics of every window after each batch."""

    def __init__(self, windows: Sequence[str], percentiles: Sequence[int]) -> None:
        self.windows = [(w, int(s)) for w, s in seconds_of(windows)]
        self.percentiles = tuple(percentiles)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot bigint", "cells array<bigint>, ns array<bigint>, totals array<bigint>, los array<bigint>, his array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        new: dict[int, dict[int, list]] = {}
        for pdf in rows:
            for slot, *cell in pdf[["slot", "cell", "n", "total", "lo", "hi"]].itertuples(index=False, name=None):
                merged(new.setdefault(int(slot), {}), [tuple(map(int, cell))])
        for slot, cells in new.items():
            if self.slots.containsKey((slot,)):
                merged(cells, zip(*self.slots.getValue((slot,)), strict=True))
            order = sorted(cells)
            self.slots.updateValue((slot,), (order, *([cells[c][i] for c in order] for i in range(4))))
        held = [(k[0], v) for k, v in self.slots.iterator()]
        longest, now = max(s for _, s in self.windows), max(k for k, _ in held)
        for k, _ in held:
            if k <= now - longest:
                self.slots.removeKey((k,))
        out = []
        for name, seconds in self.windows:
            cells: dict[int, list] = {}
            for k, v in held:
                if k > now - seconds:
                    merged(cells, zip(*v, strict=True))
            out.append({"key": key[0], "window": name, **summary(cells, self.percentiles)})
        yield pd.DataFrame(out, columns=["key", "window", "count", "min_ms", "max_ms", "mean_ms", "percentiles"])

    def close(self) -> None:
        pass


def rolling_stream(enriched: DataFrame, windows: Sequence[str] = ("1m", "5m", "15m"), percentiles: Sequence[int] = (50, 90, 95, 99), key: str | None = None) -> DataFrame:
    """A record a window and key after each batch, by the time of receipt; without a key all lines share one."""
    spark = enriched.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    k = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    width = max(1, int(max(s for _, s in seconds_of(windows)) // SLOTS))
    slot = F.floor(F.unix_seconds("received_at") / width) * width
    rows = enriched.select(k.alias("key"), slot.alias("slot"), to_micros(F.col("latency_ms")).alias("us")).where("us is not null").withColumn("cell", cell_of(F.col("us")))

    def partial(batches: Iterable) -> Iterator:
        for pdf in batches:
            yield pdf.groupby(["key", "slot", "cell"], as_index=False)["us"].agg(n="count", total="sum", lo="min", hi="max")

    summed = rows.mapInPandas(partial, "key string, slot bigint, cell bigint, n bigint, total bigint, lo bigint, hi bigint")
    return summed.groupBy("key").transformWithStateInPandas(statefulProcessor=RollingStats(windows, percentiles), outputStructType=STATS, outputMode="Update", timeMode="None")


def fan_out(stream: DataFrame, sinks: Sequence[tuple[str, Callable[[DataFrame], None]]], checkpoint: str, trigger: dict | None = None, on_error: Callable[[str, Exception], None] | None = None) -> StreamingQuery:
    """Write every batch to each sink; a sink that fails doesn't hold up the others, and is counted by `on_error`."""

    def each(batch: DataFrame, batch_id: int) -> None:
        deliver(batch, sinks, on_error)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deliver(batch: DataFrame, sinks: Sequence[tuple[str, Callable[[DataFrame], None]]], on_error: Callable[[str, Exception], None] | None = None) -> None:
    """One batch to each sink, computed once."""
    batch = batch.persist()
    try:
        for name, write in sinks:
            try:
                write(batch)
            except Exception as e:  # each sink fails for itself
                if on_error is None:
                    raise
                on_error(name, e)
    finally:
        batch.unpersist()
