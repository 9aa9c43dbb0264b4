"""Sources and streams: files, packets, sockets, tails, rolling statistics, restart from a checkpoint."""

import os
import random
import socket
import subprocess
import sys
import time

from pyspark.sql import functions as F

from logloom import sources
from logloom.config import Config
from logloom.plans.pipeline import Engine
from logloom.sources import lines, network, tail
from logloom.streaming.rolling import fan_out, rolling_stream


def test_files_and_packets(spark, tmp_path):
    (tmp_path / "a.log").write_text("one  \n\n   \ntwo\n")
    (tmp_path / "b.txt").write_text("no\n")
    got = lines.read_files(spark, [str(tmp_path / "*.log"), str(tmp_path / "*.log"), str(tmp_path / "none*")]).collect()
    assert sorted(r["content"] for r in got) == ["one", "two"] and got[0]["source"]["path"] == str(tmp_path / "a.log")
    assert lines.read_files(spark, [str(tmp_path / "none*")]).count() == 0
    assert lines.union([lines.stdin_lines(spark, ["a\n"]), lines.stdin_lines(spark, ["b"])]).count() == 2
    packets = spark.createDataFrame([(" a\r\n\nb ",), ("",), (None,)], "p string")
    assert [r["content"] for r in lines.packet_lines(packets, "p").collect()] == ["a", "b"]
    assert network.packet_to_lines(b" a\r\n\nb ") == ["a", "b"] and network.packet_to_lines(b"\xff") == []
    assert [r["content"] for r in lines.stdin_lines(spark, ["x\n", "\n", " \n"]).collect()] == ["x", " "]


def test_tail_offsets(tmp_path):
    f = tmp_path / "x.log"
    f.write_bytes(b"old\nnew par")
    at = tail.where_to_start(str(f), None, True)
    assert at[1] == 11 and tail.where_to_start(str(f), None, False)[1] == 0
    assert tail.last_break(str(f), 0, 11) == 4 and list(tail.lines_between(str(f), 0, 4, 0, 4)) == ["old"]  # the unfinished line waits
    with f.open("ab") as h:
        h.write(b"t  \n\n")
    assert tail.last_break(str(f), 4, os.path.getsize(f)) == 16 and list(tail.lines_between(str(f), 4, 16, 4, 16)) == ["new part"]
    f.write_bytes(b"s\n")
    assert tail.where_to_start(str(f), [at[0], 16], True) == (at[0], 0)  # truncated
    g = tmp_path / "y.log"
    g.write_bytes(b"rotated in\n")
    os.replace(g, f)
    assert tail.where_to_start(str(f), [at[0], 2], True)[1] == 0  # another inode


def test_byte_ranges_give_every_line_once(tmp_path):
    rnd = random.Random(3)
    lines = ["x" * rnd.choice([0, 1, 5, 40, 300]) + str(i) for i in range(400)]
    f = tmp_path / "x.log"
    f.write_text("\n".join(lines) + "\n")
    size = f.stat().st_size
    for step in (1, 7, 100, 10**6) if size < 60_000 else (7, 100, 10**6):
        assert [x for i in range(0, size, step) for x in tail.lines_between(str(f), 0, size, i, min(i + step, size))] == lines
    reader = tail._Tail({"paths": str(f), "tail": "false", "maxBytes": "1", "taskBytes": "1000", "quietSeconds": "0"})
    tail.BLOCK, block = 500, tail.BLOCK
    try:
        got, at = [], {os.path.realpath(f): [f.stat().st_ino, 0]}
        with f.open("a") as h:
            h.write("y" * 2000 + "\nunended")
        while (end := reader.latestOffset()) != at:
            got += [r[2] for p in reader.partitions(at, end) for r in reader.read(p)]
            at = end
            reader.latestOffset  # noqa: B018
        assert got[:-1] == [*lines, "y" * 2000] and got[-1] == "unended" or got == [*lines, "y" * 2000]
        end = reader.latestOffset()  # quiet, so the unended line comes out
        got += [r[2] for p in reader.partitions(at, end) for r in reader.read(p)]
        assert got == [*lines, "y" * 2000, "unended"]
    finally:
        tail.BLOCK = block


def free_port(kind=socket.SOCK_STREAM):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def connect(port, seconds=60):
    end = time.time() + seconds
    while True:
        try:
            return socket.create_connection(("127.0.0.1", port))
        except OSError:
            if time.time() > end:
                raise
            time.sleep(0.1)


def wait_for(done, query, seconds=90):
    end = time.time() + seconds
    while not done() and query.isActive and time.time() < end:
        time.sleep(0.1)
    assert done(), query.exception()


def test_sockets_on_fixed_ports_and_tail_as_streams(spark, tmp_path):
    sources.register(spark)
    f = tmp_path / "t.log"
    f.write_text("before\n")
    tcp, udp = free_port(), free_port(socket.SOCK_DGRAM)
    streams = [spark.readStream.format("tcp_lines").options(port=tcp).load(), spark.readStream.format("udp_lines").options(port=udp).load(), spark.readStream.format("tail_lines").options(paths=str(f)).load()]
    seen = []
    query = fan_out(Engine(spark, Config()).enrich(lines.union(streams)), [("seen", lambda b: seen.extend((r["source"]["kind"], r["content"], r["level"]) for r in b.collect()))], str(tmp_path / "cp"), {"processingTime": "200 milliseconds"})
    try:
        with connect(tcp) as s:
            s.sendall(b"ERROR one\n\ntwo\r\n")

        def datagram_and_line():  # until the others listen too
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                s.sendto(b"  INFO three\nfour  ", ("127.0.0.1", udp))
            with f.open("a") as h:
                h.write("WARNING five \n")
            time.sleep(0.5)
            return len(set(seen)) >= 5

        wait_for(datagram_and_line, query)
    finally:
        query.stop()
    assert set(seen) == {("file", "WARNING five", "WARN"), ("tcp", "ERROR one", "ERROR"), ("tcp", "two", None), ("udp", "INFO three", "INFO"), ("udp", "four", None)}
    assert sum(k == "tcp" for k, _, _ in seen) == 2


def test_every_line_of_a_fixed_port_comes_once_over_restarts(spark, tmp_path):
    sources.register(spark)
    port = free_port()
    seen = []
    for turn in range(3):
        stream = spark.readStream.format("tcp_lines").options(port=port, buffer=300).load()  # the buffer holds senders back
        query = fan_out(stream, [("seen", lambda b: seen.extend(r["content"] for r in b.collect()))], str(tmp_path / "cp"), {"processingTime": "100 milliseconds"})
        try:
            with connect(port) as s:
                s.sendall(b"".join(b"%d-%d\n" % (turn, i) for i in range(1000)))
            wait_for(lambda t=turn: len(seen) >= 1000 * (t + 1), query)
        finally:
            query.stop()
    assert sorted(seen) == sorted(f"{t}-{i}" for t in range(3) for i in range(1000))


def test_sources_work_from_another_folder(tmp_path):
    """The processes that read streams get the sources' code although they can't import the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "a.log").write_text("one\ntwo\n")
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from logloom import sources
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sources.register(spark)
df = spark.readStream.format("tail_lines").options(paths={str(tmp_path / "a.log")!r}, tail="false").load()
seen = []
q = df.writeStream.foreachBatch(lambda b, i: seen.extend(r["content"] for r in b.collect())).option("checkpointLocation", {str(tmp_path / "cp")!r}).start()
q.processAllAvailable()
print("SEEN", sorted(seen))
q.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "SEEN ['one', 'two']" in done.stdout, done.stderr[-2000:]


def test_rolling_stream_goes_on_after_a_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stream = lambda: spark.readStream.schema("received_at timestamp, latency_ms double").json(str(src))
    out = {}

    def run():
        def keep(b, _):
            out.update({r["window"]: r for r in b.collect()})

        rolling_stream(stream(), ["1m", "5m"], [50, 100]).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    (src / "1.json").write_text("".join(f'{{"received_at":"2023-01-01T00:00:{i:02d}Z","latency_ms":{10 * (i + 1)}}}\n' for i in range(10)))
    run()
    assert (out["1m"]["count"], out["1m"]["min_ms"], out["1m"]["max_ms"], out["1m"]["mean_ms"]) == (10, 10.0, 100.0, 55.0)
    assert [p["value_ms"] for p in out["1m"]["percentiles"]] == [50.0, 100.0]
    (src / "2.json").write_text('{"received_at":"2023-01-01T00:02:00Z","latency_ms":7}\n{"received_at":"2023-01-01T00:02:00Z"}\n')
    run()
    assert (out["1m"]["count"], out["5m"]["count"], out["5m"]["min_ms"]) == (1, 11, 7.0)


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("ERROR a=1 b=2\nplain\n")
    engine = Engine(spark, Config())
    seen = []
    fan_out(engine.enrich(lines.stream_files(spark, str(src), "*.log")), [("x", lambda b: seen.extend((r["content"], r["level"]) for r in b.collect()))], str(tmp_path / "cp")).awaitTermination()
    batch = engine.enrich(lines.read_files(spark, [str(src / "*.log")])).select("content", F.col("level")).collect()
    assert sorted(map(str, seen)) == sorted(str(tuple(r)) for r in batch)


def test_a_failing_sink_does_not_hold_up_others(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("x\n")
    seen, failed = [], []

    def bad(_):
        raise OSError("full")

    fan_out(lines.stream_files(spark, str(src)), [("bad", bad), ("good", lambda b: seen.append(b.count()))], str(tmp_path / "cp"), on_error=lambda n, e: failed.append(n)).awaitTermination()
    assert (seen, failed) == ([1], ["bad"])
