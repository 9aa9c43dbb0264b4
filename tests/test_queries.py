"""Queries over small tables of their own, against their SQL and by hand."""

import datetime as dt

import pytest

import __spark_entry__ as registered

SOURCE = {"kind": "tcp", "addr": "127.0.0.1:1", "path": None}
ENTRIES = "entry_id long, received_at timestamp, source struct<kind:string,addr:string,path:string>, content string"


def folder(spark, tmp_path, contents):
    """log_entries with the given contents, each delivered twice."""
    df = spark.createDataFrame([(i, dt.datetime(2023, 1, 1, tzinfo=dt.UTC), SOURCE, x) for i, x in enumerate(contents)], ENTRIES)
    df.unionByName(df).write.parquet(f"{tmp_path}/log_entries.parquet")
    return str(tmp_path)


def by_sql(name, at):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view log_entries as select * from read_parquet('{at}/log_entries.parquet/*.parquet')")
    return sorted(con.execute(registered.oracle_sql()[name]).fetchall(), key=repr)


def test_pairs_of_every_line(spark, tmp_path):
    at = folder(spark, tmp_path, ["ts=1 app=a level=INFO", "GET /x?app=b latency=5ms", "app='c d' level=\"WARN\" app=007", "none", None, 'app="" level =x'])
    got = sorted((tuple(r) for r in registered.queries()["kv_extract"](spark, at).collect()), key=repr)
    assert got == [(0, "a", "INFO", 3), (1, "b", None, 2), (2, "007", "WARN", 3), (5, "", None, 1)]
    assert got == by_sql("kv_extract", at)


def test_text_lines_with_their_latency(spark, tmp_path):
    at = folder(spark, tmp_path, ["ERROR E1234 took 1500us", "INFO latency=12.345 done", "no time", "latency=0.125ms", "latency=1.005ms"])
    head = "[2023-01-01 00:00:00.000] [tcp://127.0.0.1:1]"
    for name, code in (("pretty_line", " [code:E1234]"), ("file_text_line", "")):
        got = {r["entry_id"]: r["line"] for r in registered.queries()[name](spark, at).collect()}
        assert got[0].startswith(f"{head} [ERROR]{code}") and " [1.50ms]" in got[0] and got[0].endswith(" ERROR E1234 took 1500us")
        assert got[1].startswith(f"{head} [INFO]") and len(got) == 5 and got[2] == f"{head} no time"
        assert " [0.12ms]" in got[3] and " [1.00ms]" in got[4]  # a tie to the even digit; 1.005 is a little less than that in binary
        assert sorted(got.items(), key=repr) == by_sql(name, at)


def test_every_row_of_the_metrics(spark, tmp_path):
    at = folder(spark, tmp_path, ["ERROR took 1500us", "INFO latency=12.5", "login failed <script>", None])
    got = sorted((tuple(r) for r in registered.queries()["metrics_long"](spark, at).collect()), key=repr)
    values = {r[::2]: r[3] for r in got}
    assert values["logs_received_total", ""] == 4 and values["processing_errors_total", ""] == 0 and values["security_flags_total", "Xss"] == 1
    assert values["latency_ms_sum", ""] == 14 and values["latency_ms_count", ""] == 2 and [values["latency_ms_bucket", str(b)] for b in (1, 5, 10, 25, 5000, "+Inf")] == [0, 1, 1, 2, 2, 2]
    assert got == by_sql("metrics_long", at)
