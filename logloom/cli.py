"""Run the engine from a configuration: sources to enrichment to outputs, until the sources end or a signal comes."""

from __future__ import annotations

import argparse
import logging
import queue
import signal
import sys
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from . import sources
from .config import Config
from .operators.metrics import DURATION_BUCKETS, FAMILIES, LATENCY_BUCKETS, metrics, render
from .plans.pipeline import Engine, without_errors
from .session import checkpoint_dir
from .sinks import files, formats, push
from .sinks.server import MetricsServer
from .sources.lines import stdin_lines, union
from .streaming.rolling import Rolling, deliver, fan_out

log = logging.getLogger(__name__)

Sink = tuple[str, Callable[[DataFrame], None]]


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("logloom", description=__doc__)
    p.add_argument("-c", "--config", help="TOML file; defaults where absent")
    p.add_argument("-f", "--format", choices=["pretty", "json", "raw"], help="how lines are printed")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--print-config", action="store_true", help="print the defaults as TOML and end")
    return p.parse_args(argv)


class Counters:
    """The samples of every family: sums over all batches so far, and the latest value of gauges."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.sums: dict[tuple[str, str, str], float] = {}
        for name, (kind, _) in FAMILIES.items():
            if kind == "histogram":
                bounds = DURATION_BUCKETS if name == "processing_duration_seconds" else LATENCY_BUCKETS
                self.sums |= {(f"{name}_bucket", "le", str(b)): 0.0 for b in (*bounds, "+Inf")} | {(f"{name}_{x}", "", ""): 0.0 for x in ("sum", "count")}
            elif not name.startswith(("logs_by", "security_flags", "output")):
                self.sums[name, "", ""] = 0.0

    def add(self, enriched: DataFrame) -> int:
        """Count a batch; the number of its lines. The samples are a few hundred a batch."""
        rows = metrics(enriched).collect()
        for r in rows:
            self.count(r["metric"], r["label"], r["label_value"], r["value"])
        return int(next(r["value"] for r in rows if r["metric"] == "logs_received_total"))

    def count(self, metric: str, label: str, value: str, n: float = 1) -> None:
        with self.lock:
            self.sums[metric, label, value] = self.sums.get((metric, label, value), 0.0) + n

    def set(self, metric: str, value: float) -> None:
        with self.lock:
            self.sums[metric, "", ""] = float(value)

    def observe_duration(self, seconds: float, n: int) -> None:
        """`n` lines that took as long each."""
        name = "processing_duration_seconds"
        for b in (*DURATION_BUCKETS, "+Inf"):
            if b == "+Inf" or seconds <= b:
                self.count(f"{name}_bucket", "le", str(b), n)
        self.count(f"{name}_sum", "", "", seconds * n)
        self.count(f"{name}_count", "", "", n)

    def text(self, spark: SparkSession, prefix: str) -> str:
        with self.lock:
            rows = [(*k, v) for k, v in sorted(self.sums.items())]
        return render(spark.createDataFrame(rows, "metric string, label string, label_value string, value double"), prefix)


class Outputs:
    """What becomes of enriched batches: counts, rolling statistics, and the outputs that are configured."""

    def __init__(self, spark: SparkSession, config: Config, out=None) -> None:
        self.spark, self.config, self.out = spark, config, out or sys.stdout
        self.counters = Counters()
        m = config.modules.performance_metrics
        self.rolling = Rolling(m.windows, m.percentiles) if m.enabled else None
        self.pusher = push.Pusher(config.output.grafana.loki) if config.output.grafana.loki.enabled else None
        self.reported = time.monotonic()

    def failed(self, name: str, e: Exception) -> None:
        log.error("%s: %s", name, e)
        self.counters.count("output_errors_total", "output", name)

    def _count(self, batch: DataFrame) -> None:
        began = time.monotonic()
        n = self.counters.add(batch)  # the first to read the batch, so this is what enriching it takes
        if n:
            self.counters.observe_duration((time.monotonic() - began) / n, n)

    def _roll(self, batch: DataFrame) -> None:
        self.rolling.record(without_errors(batch))
        if time.monotonic() - self.reported >= self.config.modules.performance_metrics.report_seconds:
            self.report()

    def report(self) -> None:
        self.reported = time.monotonic()
        for line in self.rolling.report() if self.rolling else ():
            log.info("latency statistics: %s", line)

    def _console(self, batch: DataFrame) -> None:
        n = 0
        for r in formats.render(without_errors(batch), self.config.output.stdout.format).toLocalIterator():
            if r["value"] is not None:
                print(r["value"], file=self.out, flush=True)
                n += len(r["value"].encode()) + 1
        self.counters.count("output_bytes_total", "output", "stdout", n)

    def _file(self, batch: DataFrame) -> None:
        c = self.config.output.file
        self.counters.count("output_bytes_total", "output", "file", files.write_lines(without_errors(batch), c))
        for unit in files.retain(self.spark, c):
            log.debug("removed %s", unit)

    def _push(self, batch: DataFrame) -> None:
        before = self.pusher.sent_bytes
        try:
            self.pusher.push(without_errors(batch))
        finally:
            self.counters.set("push_buffer_size", self.pusher.buffered_count)
            self.counters.count("output_bytes_total", "output", "push", self.pusher.sent_bytes - before)

    def sinks(self) -> list[Sink]:
        o = self.config.output
        made: list[Sink] = [("metrics", self._count)]
        for on, name, write in ((self.rolling is not None, "rolling", self._roll), (o.stdout.enabled, "stdout", self._console), (o.file.enabled, "file", self._file), (self.pusher is not None, "push", self._push)):
            if on:
                made.append((name, write))
                self.counters.count("output_errors_total", "output", name, 0)
        return made

    def close(self) -> None:
        """Flush what waits, and report once more."""
        if self.pusher is not None:
            try:
                self.pusher.flush()
            except Exception as e:
                self.failed("push", e)
            self.counters.set("push_buffer_size", self.pusher.buffered_count)
        self.report()


def streams_of(spark: SparkSession, config: Config) -> list[DataFrame]:
    sources.register(spark)
    i, out = config.ingestion, []
    bound = config.general.buffer_size
    if i.tcp.enabled:
        out.append(spark.readStream.format("tcp_lines").options(host=i.tcp.bind_address, port=i.tcp.port, maxConnections=i.tcp.max_connections, buffer=bound).load())
    if i.udp.enabled:
        out.append(spark.readStream.format("udp_lines").options(host=i.udp.bind_address, port=i.udp.port, buffer=bound).load())
    if i.file.enabled and i.file.paths:
        out.append(spark.readStream.format("tail_lines").options(paths=",".join(i.file.paths), tail=str(i.file.tail).lower()).load())
    return out


def active_sources(config: Config) -> list[str]:
    """The names of the sources that a configuration turns on; files need a pattern."""
    i = config.ingestion
    return [n for n, on in (("stdin", i.stdin.enabled), ("tcp", i.tcp.enabled), ("udp", i.udp.enabled), ("file", i.file.enabled and bool(i.file.paths))) if on]


class Standard:
    """Lines of standard input as they come: a thread reads them into a bounded queue, and a batch is what has come by its time."""

    def __init__(self, lines: Iterable[str], bound: int, seconds: float) -> None:
        self.queue: queue.Queue = queue.Queue(bound)
        self.bound, self.seconds, self.ended = bound, seconds, False
        threading.Thread(target=self._read, args=(lines,), daemon=True).start()

    def _read(self, lines: Iterable[str]) -> None:
        for line in lines:
            self.queue.put(line)
        self.queue.put(None)

    def batch(self) -> list[str]:
        """At most `bound` lines, as soon as there are so many or the time is over; none if nothing came."""
        out: list[str] = []
        until = time.monotonic() + self.seconds
        while not self.ended and len(out) < self.bound:
            try:
                line = self.queue.get(timeout=max(0.0, until - time.monotonic()))
            except queue.Empty:
                break
            if line is None:
                self.ended = True
            else:
                out.append(line)
        return out


def run(spark: SparkSession, config: Config, stdin=None, out=None, stop: threading.Event | None = None) -> int:
    """Run until the sources end or `stop` is set; the number of sources that were started."""
    stop = stop or threading.Event()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    engine, outputs = Engine(spark, config), Outputs(spark, config, out)
    sinks = outputs.sinks()
    p = config.output.grafana.prometheus
    server = MetricsServer(lambda: outputs.counters.text(spark, p.prefix), p.bind_address, p.port, p.path).start() if p.enabled else None
    seconds = config.general.batch_millis / 1000
    query = None
    try:
        if streams := streams_of(spark, config):
            at = config.general.checkpoint or f"{checkpoint_dir(spark)}/stream"
            query = fan_out(engine.enrich(union(streams)), sinks, at, {"processingTime": f"{config.general.batch_millis} milliseconds"}, outputs.failed)
        if config.ingestion.stdin.enabled:
            lines = Standard(stdin or sys.stdin, config.general.buffer_size, seconds)
            while not (stop.is_set() or lines.ended):
                if chunk := lines.batch():
                    outputs.counters.set("buffer_size", lines.queue.qsize())
                    deliver(engine.enrich(stdin_lines(spark, chunk)), sinks, outputs.failed)
        while query is not None and query.isActive and not stop.is_set():
            if (progress := query.lastProgress) is not None:
                outputs.counters.set("buffer_size", progress["numInputRows"])
            stop.wait(0.2)
        if query is not None:
            query.stop()
            if (e := query.exception()) is not None:
                raise e
    finally:
        outputs.close()
        if server:
            server.stop()
    return len(active_sources(config))


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    if args.print_config:
        print(Config().to_toml(), end="")
        return 0
    config = Config.from_file(args.config) if args.config else Config()
    if args.format:
        config.output.stdout.format = args.format
    logging.basicConfig(level=logging.DEBUG if args.verbose else getattr(logging, config.general.log_level.upper(), logging.INFO), stream=sys.stderr)
    spark = SparkSession.builder.appName("logloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if run(spark, config) == 0:
        log.warning("no source is enabled")
    return 0


if __name__ == "__main__":
    sys.exit(main())
