"""Lines grouped by labels for a push over HTTP: label sets, keys, lines, batches and the push itself."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Loki
from ..errors import SinkError
from ..functions.entries import source_uri
from .formats import json_line

def labels_of(config: Loki) -> Column:
    """Static labels, overwritten by source and level; `job` where none is given."""
    fixed = {"job": config.job} | config.labels
    pairs = [x for k, v in fixed.items() if k not in ("source", "level") for x in (F.lit(k), F.lit(v))]
    source = F.create_map(F.lit("source"), F.coalesce(source_uri("source"), F.lit("")))
    level = F.when(F.col("level").isNotNull(), F.create_map(F.lit("level"), F.col("level"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(F.create_map(*pairs), source, level)


def key_of(labels: Column) -> Column:
    """`a=1,b=2` in order of the names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def labels_from(key: Column) -> Column:
    """The labels of a key; lossy where a value has a comma."""
    return F.str_to_map(key, F.lit(","), F.lit("="))


def push_line(df: DataFrame) -> Column:
    """JSON where the line has fields, flags or a latency, else its content."""
    rich = F.col("structured").isNotNull() | (F.size("security_flags") > 0) | F.col("latency_ms").isNotNull()
    return F.when(rich, json_line(df)).otherwise(F.col("content"))


def labelled(enriched: DataFrame, config: Loki, arrival: str | None = None) -> DataFrame:
    """key, stream (labels), us, seq and line of each line. `seq` is its number of arrival: a column, else the order of the rows."""
    seq = F.col(arrival).cast("bigint") if arrival else F.monotonically_increasing_id()
    return enriched.select(key_of(labels_of(config)).alias("key"), labels_of(config).alias("stream"), F.unix_micros("received_at").alias("us"), seq.alias("seq"), push_line(enriched).alias("line"))


def value_of(us: Column, line: Column) -> Column:
    return F.struct((us * 1000).cast("string").alias("ts_ns"), line.alias("line"))


def streams(enriched: DataFrame, config: Loki | None = None, batch_size: int | None = None, arrival: str | None = None) -> DataFrame:
    """batch, stream (labels) and values, [nanoseconds, line]: batches of at most `batch_size` lines, one after the other in order of
    arrival, and in each its lines by labels.

    Lines are range-partitioned by time and number of arrival and numbered within a partition, which cuts batches without regard to
    labels. So neither a label set nor a moment with most of the lines makes a large group; the last batch of a partition may be
    shorter than the others. Lines without a time come first, at zero.
    """
    c = config or Loki()
    per = batch_size or c.batch_size
    parts = int(enriched.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = labelled(enriched, c, arrival).withColumn("us", F.coalesce("us", F.lit(0)))
    ordered = rows.repartitionByRange(parts, "us", "seq").sortWithinPartitions("us", "seq")
    number = F.monotonically_increasing_id()  # partition in the upper 31 bits, row in the lower 33
    cut = ordered.withColumn("at", number).withColumn("batch", F.concat_ws("-", F.shiftright("at", 33), F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / per)))
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", "us", "line"))), lambda r: value_of(r["us"], r["line"]))
    return cut.repartition("batch").groupBy("batch", "key").agg(F.first("stream").alias("stream"), values.alias("values")).drop("key")


def requests(enriched: DataFrame, config: Loki | None = None, batch_size: int | None = None, arrival: str | None = None) -> DataFrame:
    """A batch a row, with its streams: the body of one push."""
    return streams(enriched, config, batch_size, arrival).groupBy("batch").agg(F.collect_list(F.struct("stream", "values")).alias("streams"))


def post(batches: Iterable[dict], url: str, timeout: int) -> int:
    """Send one request; its bytes."""
    body = json.dumps({"streams": list(batches)}).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        if answer.status // 100 != 2:
            raise SinkError(f"{url}: HTTP {answer.status}")
    return len(body)


def push(enriched: DataFrame, config: Loki) -> tuple[int, int]:
    """Push all lines from the executors, a request a batch; the lines and bytes pushed. A refused batch fails its task, which Spark repeats."""
    url, timeout = config.url, config.timeout_seconds

    def send(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            n = size = 0
            for ss in pdf["streams"]:
                body = [{"stream": dict(s["stream"]), "values": [[v["ts_ns"], v["line"]] for v in s["values"]]} for s in ss]
                size += post(body, url, timeout)
                n += sum(len(x["values"]) for x in body)
            yield pd.DataFrame({"n": [n], "size": [size]})

    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return tuple(requests(enriched, config).select("streams").mapInPandas(send, "n long, size long").agg(zero("n"), zero("size")).first())


class Pusher:
    """The push of a running engine: lines wait until there are `batch_size` of them or the flush interval is over, which is looked
    at when lines come. Fewer than `batch_size` lines ever wait, on the driver; larger batches are pushed by the executors."""

    def __init__(self, config: Loki, clock: Callable[[], float] = time.monotonic) -> None:
        self.config, self.clock = config, clock
        self.held: list[tuple[str, dict, int, str]] = []
        self.last, self.sent_bytes = clock(), 0

    @property
    def buffered_count(self) -> int:
        return len(self.held)

    def push(self, batch: DataFrame) -> None:
        per = self.config.batch_size
        few = labelled(batch, self.config).limit(per).collect()
        if not few:
            return
        due = len(self.held) + len(few) >= per or self.clock() - self.last >= self.config.flush_interval_seconds
        if len(few) < per:
            self.held += [(r["key"], r["stream"], r["us"] or 0, r["line"]) for r in sorted(few, key=lambda r: (r["us"] or 0, r["seq"]))]
            if due:
                self.flush()
            return
        self.flush()
        self.sent_bytes += push(batch, self.config)[1]
        self.last = self.clock()

    def flush(self) -> None:
        """Push what waits. Lines of a refused request are lost, as they are when the driver ends without a flush."""
        rows, self.held = self.held, []
        for i in range(0, len(rows), self.config.batch_size):
            grouped: dict[str, dict] = {}
            for key, stream, us, line in rows[i : i + self.config.batch_size]:
                grouped.setdefault(key, {"stream": stream, "values": []})["values"].append([str(us * 1000), line])
            self.sent_bytes += post(grouped.values(), self.config.url, self.config.timeout_seconds)
        if rows:
            self.last = self.clock()
