"""Configuration, pipeline, sinks and metrics."""

import datetime as dt
import io
import json
import os
import random
import threading
import time
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from logloom import cli
from logloom.config import Config, FileOutput, Loki
from logloom.errors import ConfigError
from logloom.operators import metrics, windows
from logloom.plans.pipeline import Engine, Pipeline, passthrough, row_module, without_errors
from logloom.sinks import files, formats, push
from logloom.sinks.server import MetricsServer
from logloom.streaming.rolling import Rolling, cell_of

UTC = dt.UTC
ALL = Config.from_text("[modules.security]\nenabled = true\n[modules.structural_parser]\nenabled = true\n[modules.performance_metrics]\nenabled = true\n")


def raw(spark, lines):
    rows = [(dt.datetime(2023, 1, 2, 3, 4, 5, 678000, UTC) + dt.timedelta(seconds=i), s, c, {}) for i, (s, c) in enumerate(lines)]
    return spark.createDataFrame(rows, "received_at timestamp, source struct<kind:string,addr:string,path:string>, content string, metadata map<string,string>")


LINES = [
    (("stdin", None, None), "ERROR code=E100 took 12ms ' or 1=1"),
    (("tcp", "127.0.0.1:1234", None), "INFO all well"),
    (("file", None, "/var/log/test.log"), "a plain line"),
    (("udp", "10.0.0.1:5", None), '{"level": "warn", "n": 1}'),
]


def test_config_defaults_and_round_trip():
    c = Config()
    assert (c.ingestion.stdin.enabled, c.modules.pattern_detection.enabled, c.output.stdout.enabled) == (True, True, True)
    assert not any((c.ingestion.tcp.enabled, c.ingestion.udp.enabled, c.ingestion.file.enabled, c.modules.security.enabled, c.modules.performance_metrics.enabled, c.output.file.enabled))
    c.modules.pattern_detection.custom_patterns = Config.from_text('[[modules.pattern_detection.custom_patterns]]\nname = "a\\"b"\npattern = "\\\\d+"').modules.pattern_detection.custom_patterns
    assert Config.from_text(c.to_toml()) == c
    assert Config.from_text("[unknown]\nx = 1\n[ingestion.tcp]\nport = 5\nbogus = 2").ingestion.tcp.port == 5
    for bad in ("[ingestion.tcp]\nport = 'x'", "not toml", "ingestion = 3"):
        with pytest.raises(ConfigError):
            Config.from_text(bad)


def test_modules_in_any_order_give_the_same_rows(spark):
    df = raw(spark, LINES)
    p = Pipeline.from_config(ALL.modules)
    assert (p.names, len(p)) == (["pattern_detection", "structural_parser", "performance_metrics", "security"], 4)
    q = Pipeline()
    for name, module in reversed(p._modules):
        q.add(name, module)
    q.add("nothing", passthrough)
    show = lambda d: sorted(map(str, d.withColumn("structured", F.to_json(F.struct("structured"))).select("content", "level", "error_code", "latency_ms", "security_flags", "structured", "tags").collect()))
    assert show(p.run(df)) == show(q.run(df))


def test_enrichment_keeps_extra_columns_and_survives_null(spark):
    df = raw(spark, [*LINES, (None, None), (("stdin", None, None), "")]).withColumn("extra", F.lit(7))
    rows = Engine(spark, ALL).enrich(df).orderBy("received_at").collect()
    assert len(rows) == 6 and all(r["extra"] == 7 for r in rows)
    assert (rows[0]["level"], rows[0]["error_code"], rows[0]["latency_ms"], [f["flag"] for f in rows[0]["security_flags"]]) == ("ERROR", "E100", 12.0, ["sql_injection"])
    assert (rows[4]["level"], rows[4]["security_flags"], rows[4]["tags"]) == (None, [], {})


def test_lines_of_each_format(spark):
    df = Engine(spark, ALL).enrich(raw(spark, LINES)).orderBy("received_at")
    pretty = [r["value"] for r in formats.render(df, "anything").collect()]
    assert pretty[0] == "[2023-01-02 03:04:05.678] [stdin] [ERROR] [code:E100] [12.00ms] [SECURITY:SqlInjection] ERROR code=E100 took 12ms ' or 1=1"
    assert pretty[2] == "[2023-01-02 03:04:07.678] [file:///var/log/test.log] a plain line"
    assert [r["value"] for r in formats.render(df, "raw").collect()] == [c for _, c in LINES]
    assert "[code:" not in formats.render(df, "txt", to_file=True).first()["value"]
    j = [json.loads(r["value"]) for r in formats.render(df, "json").collect()]
    assert list(j[0]) == ["received_at", "source", "content", "metadata", "level", "error_code", "latency_ms", "security_flags", "structured"]
    assert (j[0]["source"], j[1]["source"], j[2]["source"], j[0]["security_flags"], j[2]["metadata"]) == ("stdin", {"tcp": {"addr": "127.0.0.1:1234"}}, {"file": {"path": "/var/log/test.log"}}, ["sql_injection"], {})
    assert j[3]["structured"] == {"level": "warn", "n": 1} and "level" in j[3] and "tags" not in j[0]


def test_sizes_and_paths():
    assert [files.parse_size(x) for x in ("100MB", "1GB", "500KB", "1024B", "50", "x", "xGB")] == [100 << 20, 1 << 30, 500 << 10, 1024, 50 << 20, 100 << 20, 100 << 30]
    assert files.dated_path("/var/log/app.log", "2024-01-15") == "/var/log/app-2024-01-15.log"
    assert [files.rotation_of(x) for x in ("daily", "hourly", "size", "none", "disabled", "?")] == ["daily", "hourly", "size", "none", "none", "daily"]


def test_retention_keeps_the_newest_days(spark, tmp_path):
    lines = raw(spark, LINES)
    config = FileOutput(True, str(tmp_path / "out"), "jsonl", "daily", max_files=2)
    for day in range(4):
        moved = lines.withColumn("received_at", F.col("received_at") + F.expr(f"make_dt_interval({day})"))
        assert files.write_lines(Engine(spark, ALL).enrich(moved), config) > 100
    gone = files.retain(spark, config)
    assert sorted(g[-15:] for g in gone) == ["date=2023-01-02", "date=2023-01-03"] and files.retain(spark, config) == []
    assert {str(r["date"]) for r in spark.read.text(config.path).select("date").distinct().collect()} == {"2023-01-04", "2023-01-05"}
    by_size = FileOutput(True, str(tmp_path / "sized"), "jsonl", "size", "1KB", max_files=1, compress=False)
    for _ in range(3):
        files.write_lines(Engine(spark, ALL).enrich(lines), by_size)
    assert len(files.retain(spark, by_size)) > 0 and files.listing(spark, by_size).count() == 1
    assert files.retain(spark, FileOutput(True, str(tmp_path / "out"), rotation="none")) == [] and files.listing(spark, FileOutput(path=str(tmp_path / "none"))).count() == 0
    listed = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "g string, at int, id int")
    assert [tuple(r) for r in files.beyond_newest(listed, 1, "at", "id", ["g"]).collect()] == [("a", 1, 1)]


@pytest.mark.parametrize("rotation, compress", [("daily", True), ("hourly", False), ("size", False), ("none", True)])
def test_files_round_trip(spark, tmp_path, rotation, compress):
    df = Engine(spark, ALL).enrich(raw(spark, LINES))
    files.write_lines(df, FileOutput(True, str(tmp_path / "out"), "jsonl", rotation, "1KB", 7, compress))
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted(json.loads(r["value"])["content"] for r in back.collect()) == sorted(c for _, c in LINES)
    assert back.columns == ["value", *{"daily": ["date"], "hourly": ["date", "hour"]}.get(rotation, [])]


def test_labels_and_batches(spark):
    config = Loki(labels={"app": "test"})
    df = Engine(spark, ALL).enrich(raw(spark, [LINES[0], LINES[0], LINES[1], LINES[2]]))
    rows = df.select(push.key_of(push.labels_of(config)).alias("k")).distinct().collect()
    assert sorted(r["k"] for r in rows)[0] == "app=test,job=logloom,level=ERROR,source=stdin"
    assert spark.range(1).select(push.labels_from(F.lit("a=1,b=2")).alias("m")).first()["m"] == {"a": "1", "b": "2"}
    s = push.streams(df, config, batch_size=1).collect()
    assert len(s) == 4 and all(len(r["values"]) == 1 for r in s) and len({r["batch"] for r in s}) == 4
    lines = {r["stream"]["source"]: r["values"][0]["line"] for r in s}
    assert lines["tcp://127.0.0.1:1234"] == "INFO all well" and lines["stdin"].startswith('{"received_at"')


def test_lines_of_one_moment_are_pushed_in_order_by_many_tasks(spark):
    n = 2000
    same = spark.range(n, numPartitions=3).select(F.lit(dt.datetime(2023, 1, 1, tzinfo=UTC)).cast("timestamp").alias("received_at"), F.expr("named_struct('kind', 'stdin', 'addr', null, 'path', null)").cast("struct<kind:string,addr:string,path:string>").alias("source"), F.format_string("line %d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("content"), F.col("id").alias("n"))
    df = Engine(spark, Config()).enrich(same)
    for arrival in (None, "n"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
        rows = push.streams(df, Loki(batch_size=64), arrival=arrival).withColumn("task", F.spark_partition_id()).collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert max(len(r["values"]) for r in rows) == 64 and len({r["task"] for r in rows}) > 1 and len({r["batch"].split("-")[0] for r in rows}) > 1
        ordered = sorted(rows, key=lambda r: tuple(map(int, r["batch"].split("-"))))
        assert [v["line"] for r in ordered for v in r["values"]] == [f"line {i * 7919 % n}" for i in range(n)]
    assert push.streams(df.where("false")).count() == 0


def test_push_over_http(spark):
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204 if self.path == "/ok" else 500)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    df = Engine(spark, ALL).enrich(raw(spark, LINES))
    assert push.push(df, Loki(url=url + "/ok"))[0] == 4
    assert sum(len(s["values"]) for g in got for s in g["streams"]) == 4
    got.clear()
    now = [0.0]
    waiting = push.Pusher(Loki(url=url + "/ok", batch_size=6, flush_interval_seconds=5), lambda: now[0])
    waiting.push(df)
    assert (waiting.buffered_count, got) == (4, [])
    waiting.push(df)  # eight lines: a full request and the rest
    assert waiting.buffered_count == 0 and [sum(len(s["values"]) for s in g["streams"]) for g in got] == [6, 2] and waiting.sent_bytes > 0
    waiting.push(df.limit(1))
    now[0] = 6.0
    waiting.push(df.limit(1))  # the interval is over
    assert waiting.buffered_count == 0 and len(got) == 3
    waiting.push(df.limit(1))
    waiting.flush()
    assert waiting.buffered_count == 0 and len(got) == 4
    with pytest.raises(Exception, match="500|HTTP"):
        push.push(df, Loki(url=url + "/bad"))
    server.shutdown()


def test_metrics_and_endpoint(spark):
    samples = metrics.metrics(Engine(spark, ALL).enrich(raw(spark, LINES)))
    values = {(r["metric"], r["label_value"]): r["value"] for r in samples.collect()}
    assert values["logs_processed_total", ""] == 4 and values["logs_by_level_total", "ERROR"] == 1 and values["latency_ms_bucket", "25"] == 1 and values["latency_ms_bucket", "10"] == 0
    assert {k for m, k in values if m == "logs_by_source_total"} == {"stdin", "tcp", "file", "udp"} and values["security_flags_total", "SqlInjection"] == 1
    text = metrics.render(samples)
    assert '# TYPE logloom_latency_ms histogram' in text and 'logloom_latency_ms_bucket{le="+Inf"} 1' in text
    server = MetricsServer(lambda: text, port=0).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.port}{p}").read().decode()
    assert get("/metrics") == text and get("/health") == get("/healthz") == "OK"
    with pytest.raises(urllib.error.HTTPError):
        get("/else")
    server.stop()


def test_window_statistics(spark):
    t0 = dt.datetime(2023, 1, 1, tzinfo=UTC)
    df = spark.createDataFrame([(t0 + dt.timedelta(seconds=10 * i), float(10 * (i + 1))) for i in range(10)], "received_at timestamp, latency_ms double")
    s = windows.window_stats(df, "latency_ms").first()
    assert (s["count"], s["min_ms"], s["max_ms"], s["mean_ms"]) == (10, 10.0, 100.0, 55.0)
    assert [tuple(p) for p in s["percentiles"]] == [(50, 50.0), (90, 90.0), (95, 100.0), (99, 100.0)]
    empty = windows.window_stats(df.where("false"), "latency_ms").first()
    assert (empty["count"], empty["max_ms"], empty["percentiles"]) == (0, 0.0, [])
    odd = spark.createDataFrame([(-5.0,), (0.0, ), (60_000.0,), (60_001.0,), (1.23456,)], "v double")
    assert [r["v"] for r in odd.select(windows.to_millis(F.col("v")).alias("v")).collect()] == [0.0, 0.0, 60_000.0, None, 1.234]
    last = windows.rolling_stats(df, "received_at", "latency_ms", ["30s", "bad"]).orderBy(F.desc("received_at")).first()
    assert (last["window"], last["count"], last["min_ms"]) == ("30s", 3, 80.0)  # the value exactly 30 s old is out
    assert spark.range(1).select(windows.report_line(F.lit([]).cast("array<struct<percentile:smallint,value_ms:double>>")).alias("r")).first()["r"] == ""


def test_lines_that_a_module_cannot_read(spark):
    """They are counted and left out; the others go on, and later modules leave them alone."""
    calls = Pipeline.from_config(ALL.modules)
    calls.add("half", row_module(lambda x: {"half": int(x["content"].split()[-1]) // 2}, ["content"], "half int")).add("twice", row_module(lambda x: {"twice": x["half"] * 2}, ["half"], "twice int"))
    lines = ["n 4", "ERROR n x", "n 9", "WARN took 5ms"]
    df = calls.run(raw(spark, [(("stdin", None, None), x) for x in lines]))
    rows = {r["content"]: r for r in df.collect()}
    assert (rows["n 9"]["half"], rows["n 9"]["twice"], rows["n 9"]["error"]) == (4, 8, None)
    assert rows["ERROR n x"]["error"].startswith("ValueError") and rows["ERROR n x"]["twice"] is None
    kept = without_errors(df)
    assert kept.count() == 2 and "error" not in kept.columns and without_errors(kept) is kept
    values = {(r["metric"], r["label_value"]): r["value"] for r in metrics.metrics(df).collect()}
    assert [values[f"{m}_total", ""] for m in ("logs_received", "logs_processed", "processing_errors", "latency_extracted")] == [4, 2, 2, 0] and ("logs_by_level_total", "ERROR") not in values


def test_rolling_windows_of_the_engine(spark):
    now = [1000.0]
    r = Rolling(["1m", "5m", "bad"], [50, 100], lambda: now[0])
    assert r.report() == [] and r.stats()[0] == {"window": "1m", "count": 0, "min_ms": 0.0, "max_ms": 0.0, "mean_ms": 0.0, "percentiles": []}
    df = Engine(spark, ALL).enrich(raw(spark, [(("stdin", None, None), f"took {10 * i}ms") for i in range(1, 11)]))
    r.record(df)
    assert [(s["count"], s["min_ms"], s["max_ms"], s["mean_ms"]) for s in r.stats()] == [(10, 10.0, 100.0, 55.0)] * 2
    assert r.report()[0] == "window=1m count=10 min_ms=10.00 max_ms=100.00 mean_ms=55.00 percentiles=P50=50.00ms, P100=100.00ms"
    now[0] += 120
    assert r.stats()[0]["count"] == 10  # an idle window keeps its last state
    r.record(df.limit(1))
    assert [s["count"] for s in r.stats()] == [1, 11]


def test_cells_keep_three_figures(spark):
    rnd = random.Random(1)
    values = [0, 1, 2047, 2048, 2049, 60_000_000] + [int(10 ** rnd.uniform(0, 7.7)) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "us long").select("us", cell_of(F.col("us")).alias("cell")).collect()
    assert all(0 <= r["us"] - r["cell"] <= r["us"] / 1000 and (r["us"] > 2047 or r["us"] == r["cell"]) for r in rows)


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["--print-config"]) == 0 and Config.from_text(capsys.readouterr().out) == Config()
    out = io.StringIO()
    config = Config()
    config.output.stdout.format = "raw"
    assert cli.run(spark, config, io.StringIO("one\n\n two \n"), out) == 1
    assert out.getvalue() == "one\n two \n"


def test_running_engine_counts_reports_and_stops(spark, tmp_path, caplog):
    """Lines come out before standard input ends, every family has samples, old files go, and a stop ends an open input."""
    config = Config.from_text("[general]\nbatch_millis = 200\n[modules.performance_metrics]\nenabled = true\n[output.stdout]\nformat = 'raw'\n")
    config.output.file = FileOutput(True, str(tmp_path / "out"), "jsonl", "hourly", max_files=1)
    r, w = os.pipe()
    out, stop, done = io.StringIO(), threading.Event(), []
    thread = threading.Thread(target=lambda: done.append(cli.run(spark, config, os.fdopen(r), out, stop)))
    thread.start()
    os.write(w, b"ERROR took 5ms\n")
    end = time.time() + 60
    while "ERROR" not in out.getvalue() and time.time() < end:
        time.sleep(0.1)
    assert out.getvalue() == "ERROR took 5ms\n" and thread.is_alive()
    end = time.time() + 60
    while not list((tmp_path / "out").glob("date=*/hour=*/part-*")) and time.time() < end:
        time.sleep(0.1)
    with caplog.at_level("INFO", logger="logloom.cli"):
        stop.set()
        thread.join(60)
    os.close(w)
    assert done == [1] and "count=1" in caplog.text and list((tmp_path / "out").glob("date=*/hour=*/part-*"))
    outputs = cli.Outputs(spark, config, io.StringIO())
    batch = Engine(spark, config).enrich(raw(spark, LINES))
    for _, write in outputs.sinks():
        write(batch)
    outputs.close()
    text = outputs.counters.text(spark, "logloom")
    assert all(f"# TYPE logloom_{name} " in text for name in metrics.FAMILIES if name != "security_flags_total")
    assert "logloom_processing_duration_seconds_count 4" in text and 'logloom_output_bytes_total{output="stdout"}' in text and 'logloom_output_errors_total{output="file"} 0' in text
    config.ingestion.tcp.enabled = config.ingestion.file.enabled = True
    assert cli.active_sources(config) == ["stdin", "tcp"]
