"""Literal lines and what each operator makes of them."""

import pytest
from pyspark.sql import functions as F

from logloom.config import NamedPattern, Security
from logloom.operators import latency, parser, pattern, security


def each(spark, lines, *columns):
    rows = [(i, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "i int, content string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


LEVELS = [
    ("2031-07-08 21:00:09 ERROR: replica 4 is behind by two hours", "ERROR"), ("[WARN] battery of sensor 12 at 9 %", "WARN"), ("WARNING: queue of tenant b grows", "WARN"), ("INFO - harvest began", "INFO"),
    ("[DEBUG] cache line evicted", "DEBUG"), ("FATAL: no quorum left", "FATAL"), ("CRITICAL: coolant lost", "FATAL"), ("error: lens cap is on", "ERROR"), ("trace me", "TRACE"),
    ("gulls over the harbour", None), ("info first, then ERROR", "INFO"), ("SEVERE trouble", "ERROR"), ("informational", None), ("", None), (None, None),
]
CODES = [("Error code: K077 - rotor jammed", "K077"), ("upstream said status=418", "418"), ("XR-902: valve stuck", "XR-902"), ("nothing here", None), (None, None)]


def test_levels_and_codes(spark):
    assert each(spark, [x for x, _ in LEVELS], pattern.level_of(F.col("content"))) == [(y,) for _, y in LEVELS]
    assert each(spark, [x for x, _ in CODES], pattern.error_code_of(F.col("content"))) == [(y,) for _, y in CODES]


def test_custom_tags(spark):
    named = pattern.tags_of(F.col("content"), [NamedPattern("request_id", "req_id=(?P<id>[a-f0-9-]+)"), NamedPattern("n", r"n=(\d+)?"), NamedPattern("word", "Sorting"), NamedPattern("bad", "(")])
    assert each(spark, ["INFO req_id=f00-42-beef Sorting parcels", "n=", None], named) == [({"request_id_id": "f00-42-beef", "word": "Sorting"},), ({},), ({},)]


LATENCIES = [
    ("merge took 812ms in all", 812.0), ("the crane took 3s for it", 3000.0), ("lookup took 250us", 0.25), ("pump cycle latency=61ms valve=3", 61.0), ("oven took 1.5s", None),
    ("latency=5us", 5.0), ("latency: 7", 7.0), ("nothing", None), (None, None),
]


def test_latencies(spark):
    assert each(spark, [x for x, _ in LATENCIES], latency.latency_of(F.col("content"))) == [(y,) for _, y in LATENCIES]
    assert each(spark, ["oven took 1.5s", "took 3 min"], latency.latency_of(F.col("content"), [r"took (\d+\.\d+)(s)", r"took (\d+) (min)"])) == [(1500.0,), (180_000.0,)]
    assert each(spark, ["x took 9ms"], latency.latency_of(F.col("content"), ["(x) took", r"took (\d+)ms"])) == [(None,)]  # the first match decides


def test_durations():
    us = 1_000_000
    assert [latency.parse_duration(x) for x in ("1m", "30s", "1h", "2d", "7", "5ms", "x")] == [60 * us, 30 * us, 3600 * us, 2 * 86400 * us, 420 * us, None, None]


FLAGS = [
    ("q=7 UnIoN sElEcT pin FROM vault", ["sql_injection"]), ("name=x' OR 1=1 --", ["sql_injection"]), ("note; drop table harvest", ["sql_injection"]), ("id=3 or sleep(9)", ["sql_injection"]),
    ("SELECT depth FROM wells WHERE dry = false", []), ("bio=<ScRiPt>go()</script>", ["xss"]), ("pic onerror=run()", ["xss"]), ("href=javascript:document.cookie", ["xss"]), ("<iframe src='//bad.example'>", ["xss"]),
    ("drawing <div> in <span>", []), ("GET /a/../../b", ["path_traversal"]), ("f=..%2Fkeys", ["path_traversal"]), ("open ..\\windows\\system32\\drivers", ["path_traversal"]), ("read /etc/shadow", ["path_traversal"]), ("a\0b", ["path_traversal"]),
    ("sshd: failed  login of gull", ["auth_failure"]), ("gate 4: Access denied", ["auth_failure"]), ("token expired at noon", ["auth_failure"]), ("unknown user heron", ["auth_failure"]),
    ("paid by 5500-0000-0000-0004", ["sensitive_data"]), ("no. 219-09-9999", ["sensitive_data"]), ("api-secret: abcdefghij0123456789", ["sensitive_data"]), ("pwd: tr0ut", ["sensitive_data"]),
    ("failed login with ' or 1=1", ["sql_injection", "auth_failure"]), ("INFO: heron came home from 10.1.2.3", []), ("", []), (None, []),
]


def test_flags(spark):
    got = each(spark, [x for x, _ in FLAGS], F.transform(security.flags_of(F.col("content")), lambda f: f["flag"]))
    assert got == [(y,) for _, y in FLAGS]


def test_custom_sensitive_pattern_and_toggles(spark):
    c = Security(True, False, False, False, False, [NamedPattern("crate", r"CRATE-\d{6}"), NamedPattern("bad", "[")])
    got = each(spark, ["moved CRATE-004217 aside", "<script> password=x"], F.transform(security.flags_of(F.col("content"), c), lambda f: f["pattern_name"]))
    assert got == [(["crate"],), (["pii"],)]


FORMATS = [
    ('{"depth": "nine"}', "json"), ('  {"a": "b"}  ', "json"), ("[1, 2, 3]", "json"), ('{"a":1} {"b":2}', "unknown"), ("reef=3 tide=low", "kv"), ("a=1", "unknown"), ("gulls over the harbour", "unknown"),
    ('10.7.0.9 - heron [03/Feb/2031:04:05:06 +0100] "GET /tides?d=1 HTTP/2" 206 77 "https://reef.example" "probe/1"', "apache"), ("<29>Feb  3 04:05:06 pier7 tided: level is 'low'", "syslog"), ("", "unknown"), (None, None),
]


def test_formats(spark):
    assert each(spark, [x for x, _ in FORMATS], parser.format_of(F.col("content"))) == [(y,) for _, y in FORMATS]


def test_access_lines(spark):
    lines = [FORMATS[7][0], '10.0.0.2 - - [04/Mar/2031:00:00:00 +0000] "POST /moor HTTP/1.1" 303 0', '1.1.1.1 - - [x] "GET / " 70000 - "" "-"']
    rows = each(spark, lines, parser.access_fields(F.col("content")))
    a, b, c = (r[0] for r in rows)
    assert (a["client_ip"], a["user"], a["status"], a["bytes"], a["referrer"], a["user_agent"]) == ("10.7.0.9", "heron", 206, 77, "https://reef.example", "probe/1")
    assert (b["user"], b["status"], b["referrer"], b["user_agent"]) == (None, 303, None, None)
    assert (c["status"], c["bytes"], c["protocol"], c["referrer"], c["user_agent"]) == (None, None, None, "", "-")


def test_syslog_lines(spark):
    lines = ["Mar  4 05:06:07 pier7 moord[4242]: rope 3 is loose", FORMATS[8][0], "Dec 31 23:59:59 lamp kernel: lens: turning"]
    a, b, c = (r[0] for r in each(spark, lines, parser.syslog_fields(F.col("content"))))
    assert (a["process"], a["pid"], a["priority"]) == ("moord", 4242, None)
    assert (b["priority"], b["facility"], b["severity"], b["hostname"]) == (29, 3, 5, "pier7")
    assert (c["process"], c["pid"], c["message"]) == ("kernel", None, "lens: turning")


def test_key_values(spark):
    v = parser.key_value_of(F.col("content"))
    lines = ["bird=heron tide=17 wait=90ms", "say=\"low tide\" bird='grey heron' n=5", "enabled=true x=5d y=1.5 z=nan e=\"\" k=1 k=2", "none"]
    got = [r[0] for r in each(spark, lines, F.to_json(v))]
    assert got[0] == '{"bird":"heron","tide":17,"wait":"90ms"}'
    assert got[1] == '{"bird":"grey heron","n":5,"say":"low tide"}'
    assert got[2] == '{"e":"","enabled":true,"k":2,"x":"5d","y":1.5,"z":0}'
    assert got[3] is None


@pytest.mark.parametrize("fmt, line, want", [("json", "5", "5"), ("nginx", "x", None), ("auto", "a=1 b=2", None), ("key_value", "a=1", '{"a":1}')])
def test_explicit_format(spark, fmt, line, want):
    assert each(spark, [line], F.to_json(F.struct(parser.structured_of(F.col("content"), False, fmt).alias("v")))) == [('{"v":' + want + "}" if want else "{}",)]
