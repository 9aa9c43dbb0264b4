"""The data-preparation operators of the core on small inputs, against brute force and on the rows that break things."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import drift, spikes, templates, timestamps
from logloom.operators.sequences import long_runs

UTC = dt.UTC
SENDERS = [("s://ny", "America/New_York", "en_US"), ("s://be", "Europe/Berlin", "de_DE"), ("s://lo", "Europe/London", "en_GB"), ("s://in", "Asia/Kolkata", "en_GB")]


def us(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp()) * 1_000_000


def stamps(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "export_id long, received_at string, content string, source_uri string").withColumn("tz_name", F.lit("clash"))
    who = spark.createDataFrame(SENDERS, "uri string, tz_name string, locale string")
    got = timestamps.export_stamps(df.unionByName(df), who).collect()
    assert len(got) == len(set(got))
    return {(r["export_id"], r["field"]): r["utc_us"] for r in got}


def test_notations_of_one_instant(spark):
    want = us("2023-06-05T12:34:56")
    forms = [
        ("s://ny", "2023-06-05 08:34:56"), ("s://ny", "06/05/2023 08:34:56 AM"), ("s://lo", "05/06/2023 13:34:56"), ("s://be", "05.06.2023 14:34:56"), ("s://be", "2023/06/05 14:34:56"), ("s://ny", "Jun 5, 2023 8:34:56 AM EDT"),
        ("s://in", "Mon, 05 Jun 2023 18:04:56 +0530"), ("s://in", "[05/Jun/2023:18:04:56 +0530]"), ("s://ny", "20230605T123456Z"), ("s://ny", "2023-156T12:34:56Z"), ("s://ny", "1685968496"), ("s://ny", "1685968496000"),
        ("s://ny", "1685968496000000"), ("s://ny", "1685968496000000999"), ("s://ny", "1685968496.000000"), ("s://ny", "2023-06-05T14:34:56+02:00[Europe/Berlin]"), ("s://in", "2023-06-05 18:04:56 IST"),
        ("s://ny", "05-Jun-2023 08:34:56.000"), ("s://ny", "  2023-06-05T08:34:56,000000 "), ("s://ny", "2023-06-05T12:34:56.000000999Z"), ("s://be", "2023-06-05 12:34:56 UTC"), ("s://be", "2023-06-05T14:34:56 +02"),
    ]
    got = stamps(spark, [(text, None, uri) for uri, text in forms])
    assert got == {(i, "received_at"): want for i in range(len(forms))}


def test_stamps_inside_lines(spark):
    r, want = "2023-06-05T12:35:00Z", us("2023-06-05T12:34:56")
    lines = [
        '{"ts": "2023-06-05T12:34:56Z", "level": "INFO"}', '{"time": 1685968496, "x": 1}', 'level=info time="2023-06-05 08:34:56" msg="until 2031-05-07 by peer"', '1.1.1.1 - - [05/Jun/2023:08:34:56 -0400] "GET / HTTP/1.1" 200 1',
        "  [2023-06-05 08:34:56] INFO: x", "Jun  5 08:34:56 ERROR window 2019-11-03 01:30", "2023-06-05T08:34:56 DEBUG x", "[05/Jun/2023:08:34:56 -0400] [warn] x", "1685968496 WARN x", "ts=2023-06-05T12:34:56Z msg=x",
    ]
    got = stamps(spark, [(r, x, "s://ny") for x in [*lines, "INFO until 2031-05-07 01:02:03", "", None]])
    assert {k: v for k, v in got.items() if k[1] == "content"} == {(i, "content"): want for i in range(len(lines))}


def test_clock_changes_new_year_and_placeholders(spark):
    rows = [
        ("2023-10-29 02:30:10", "2023-10-29T02:30:00+01:00 INFO x", "s://be"),  # the second of two
        ("2023-10-29 02:30:10", "2023-10-29T02:30:00+02:00 INFO x", "s://be"),  # the first of two
        ("2023-10-29 02:30:10", "INFO x", "s://be"),  # nothing tells which
        ("2023-03-26 02:30:10", None, "s://be"),  # skipped by the clock
        ("2024-01-01T00:00:30Z", "Dec 31 23:59:50 INFO x", "s://lo"),
        ("2024-02-30 00:00:00", "Feb 30 00:00:00 INFO x", "s://lo"), ("-", "unknown", "s://lo"), ("N/A", None, None), ("0000-00-00 00:00:00", "", "s://none"), (None, None, None),
        ("2023-01-01 00:00:05", None, "s://none"),
    ]
    assert stamps(spark, rows) == {
        (0, "received_at"): us("2023-10-29T01:30:10"), (0, "content"): us("2023-10-29T01:30:00"), (1, "received_at"): us("2023-10-29T00:30:10"), (1, "content"): us("2023-10-29T00:30:00"),
        (4, "received_at"): us("2024-01-01T00:00:30"), (4, "content"): us("2023-12-31T23:59:50"), (10, "received_at"): us("2023-01-01T00:00:05"),
    }
    assert stamps(spark, []) == {}


def test_years_far_from_now(spark):
    rows = [("2040-07-01 12:00:00", None, "s://ny"), ("1965-01-15 12:00:00", None, "s://ny"), ("2036-07-01 12:00:00", None, "s://be"), ("2150-12-24T18:00:00", None, "s://be"), ("1890-03-01 00:00:00", None, "s://lo"), ("2150-07-01 12:00:00 EDT", None, "s://ny"), ("0001-01-01 00:00:00", None, "s://none"), ("9999-12-31 23:59:59", None, "s://none")]
    want = ["2040-07-01T16:00:00", "1965-01-15T17:00:00", "2036-07-01T10:00:00", "2150-12-24T17:00:00", "1890-03-01T00:00:00", "2150-07-01T16:00:00", "0001-01-01T00:00:00", "9999-12-31T23:59:59"]
    assert stamps(spark, rows) == {(i, "received_at"): us(w) for i, w in enumerate(want)}


FILE = "line_id long, received_at timestamp, source struct<kind:string,addr:string,path:string>, line_no int, content string, stamp string"


def file_rows(spark, files):
    rows, n = [], 0
    for path, lines in files.items():
        for i, x in enumerate(lines, 1):
            n += 1
            rows.append((n, dt.datetime(2023, 1, 1, 0, 5, tzinfo=UTC), ("file", None, path), i, x, "clash"))
    df = spark.createDataFrame(rows, FILE)
    return df.unionByName(df)


def test_records_of_several_layouts(spark):
    words = ["alpha beta 1", "x: y 2 z", "a | b 3 - c", "value [q] for 4", "one two three"]
    rust = [f"2023-01-01T00:00:0{i}.5Z  INFO app::core: {w}" for i, w in enumerate(words)]
    glog = [f"W1231 23:59:0{i}.000001 77 main.cc:12] {w}" for i, w in enumerate(words)]
    pretty = ["{", '  "ts": "2023-01-01T00:00:09.1Z",', '  "severity": "CRITICAL",', '  "logger": "disk",', '  "message": "is full now"', "}", "\tat x.y(Z.java:1)"]
    flat = [f'{{"ts": "2023-01-01T00:00:0{i}.5Z", "severity": "WARN", "logger": "net", "message": "{w}"}}' for i, w in enumerate(words)]
    lines = ["  cut off", *rust, "Traceback (most recent call last):", None, *glog, "2023-01-01 is a day", *flat, *pretty, ""]
    got = {r["line_id"]: tuple(r)[1:] for r in templates.records(file_rows(spark, {"/a": lines, "/b": [*rust[:2]]})).collect()}
    assert len(got) == 18
    assert got[2] == (1, "2023-01-01 00:00:00", "INFO", "app::core", "alpha beta 1")
    assert got[6] == (3, "2023-01-01 00:00:04", "INFO", "app::core", "one two three")
    assert got[9] == (1, "2022-12-31 23:59:00", "WARN", "main.cc", "alpha beta 1")
    assert got[15][1:] == ("2023-01-01 00:00:00", "WARN", "net", "alpha beta 1")
    assert got[20] == (8, "2023-01-01 00:00:09", "FATAL", "disk", "is full now")
    assert templates.records(file_rows(spark, {"/a": ["x"]}).where("false")).count() == 0


def test_a_rare_line_does_not_shorten_a_head(spark):
    stamp = "2023-01-04 02:35:41,396"
    said = ["sent 3 mails", "x: y 2 z", "a | b - c", "done", "value [q] for 4"]
    lines = [f"{stamp} INFO [worker-{i % 7}] app.slots.Mailer - {said[i % 5]}" for i in range(300)]
    for cut in (f"{stamp} INFO [worker-3", f"{stamp} INFO [worker-3] app", f"{stamp} INFO [worker-3] odd line = of 4 (five) words"):
        got = {r["line_id"]: tuple(r)[1:] for r in templates.records(file_rows(spark, {"/a": lines, "/b": [cut, *lines[:3]]})).collect()}
        want = {i + 1: (1, "2023-01-04 02:35:41", "INFO", "app.slots.Mailer", said[(i if i < 300 else i - 301) % 5]) for i in range(304) if i != 300}
        assert {i: r for i, r in got.items() if i != 301} == want
        assert got[301][:3] == (1, "2023-01-04 02:35:41", "INFO")


def test_counted_beginnings():
    end = templates.END
    lines = [(("a", "b", "-", str(i), "x", end), 1) for i in range(500)] + [(("a", "b", end), 1), (("a", "c", end), 2), (("a", "d", "e", "f", end), 1)]
    assert templates.beginnings(lines)[0] == (("a", "b", "-"), 500)
    assert sum(k for _, k in templates.beginnings(lines)) == 504
    few = templates.pruned(lines)
    assert len(few) < 10 and sum(k for _, k in few) == 504 and templates.beginnings(few)[0] == (("a", "b", "-"), 500)
    assert templates.beginnings([(("a", "b", "c", end), 50), (("a", "d", "e", "f", end), 50)]) == [(("a",), 100)]


def test_heads_have_the_constants_of_the_common_subsequence():
    w, n = templates.WORD_T, templates.NUMBER_T
    assert templates.anchored((w, "[", n, "]", ":", w, "-"), ("[", "]", ":", w)) == (w, "[", n, "]", ":")
    assert templates.anchored((w, "[", n, "|", ":"), ("[", ":")) == (w, "[") and templates.anchored((w, " "), ()) == (w,) and templates.anchored((), ("a",)) == ()
    long = tuple("abc" * 3000), tuple("acb" * 3000)
    assert len(templates.common(*long)) == templates.common_length(*long) >= 6000


def test_longest_common_subsequence():
    rnd = random.Random(1)

    def length(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    table = templates.TABLE_BITS
    for k in range(400):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in "12")
        templates.TABLE_BITS = table if k % 2 else 6  # halved again and again
        c = templates.common(tuple(a), tuple(b))
        templates.TABLE_BITS = table
        assert len(c) == length(a, b) == templates.common_length(tuple(a), tuple(b))
        for s in (a, b):
            it = iter(s)
            assert all(x in it for x in c)


RECORDS = "record_id long, file_id long, structured string, metadata map<string,string>, name string"


def test_schema_changes(spark):
    files = spark.createDataFrame([(1, "f", 1), (2, "f", 2), (3, "f", 3), (9, "g", 1)], "file_id long, feed string, file_seq int")
    ids = [str(1000 + i) for i in range(8)]
    rows = [(i, 1, f'{{"user": "{ids[i]}", "ok": true, "n": 1, "ctx": {{"zone": "z{i % 3}"}}, "old": [1], "empty": null}}', {"Host": f"h{i % 4}"}, "x") for i in range(8)]
    rows += [(10 + i, 2, f'{{"UserId": "{ids[i]}", "ok": {i % 2}, "n": 1.5, "ctx": {{"zone_v": "z{i % 3}"}}, "fresh": "q{i}"}}', {"host": f"h{i % 4}"}, "x") for i in range(8)]
    rows += [(20, 3, "not json", None, "x"), (21, 3, None, {}, "x"), (22, 3, "[1]", None, "x"), (30, 9, '{"a": 1}', None, "x")]
    df = spark.createDataFrame(rows, RECORDS)
    got = sorted(tuple(r) for r in drift.changes(df.unionByName(df), files).collect())
    second = [x[1:] for x in got if x[0] == 2]
    assert second == sorted([
        ("metadata", "renamed", "Host", "host"), ("structured", "added", "", "fresh"), ("structured", "removed", "old", ""), ("structured", "renamed", "ctx.zone", "ctx.zone_v"),
        ("structured", "renamed", "user", "UserId"), ("structured", "retyped", "n", "n"), ("structured", "retyped", "ok", "ok"),
    ])
    assert {x[2] for x in got if x[0] == 3} == {"removed"} and {x[0] for x in got} == {2, 3}
    table = {r["record_id"]: json.loads(r["c"]) for r in drift.unified(df.unionByName(df), files).select("record_id", F.to_json("columns").alias("c")).collect()}
    assert len(table) == 20 and table[11]["structured.user"] == "1001" and table[11]["metadata.Host"] == "h1" and table[20] == {} and table[30] == {"structured.a": 1}
    assert table[1]["structured.n"] == 1.0 and table[1]["structured.ok"] == "true" and table[11]["structured.ok"] == "1" and table[1]["structured.old"] == [1]
    assert drift.changes(df.where("false"), files).count() == 0


def unify(spark, files):
    """The unified records of one feed's files, given as lists of JSON texts."""
    listed = spark.createDataFrame([(i, "f", i) for i in range(len(files))], "file_id long, feed string, file_seq int")
    rows = [(100 * i + k, i, x, None, "clash") for i, part in enumerate(files) for k, x in enumerate(part)]
    got = drift.unified(spark.createDataFrame(rows, RECORDS), listed).select("record_id", F.to_json("columns").alias("c"))
    return {r["record_id"]: json.loads(r["c"]) for r in got.collect()}


def test_fields_that_change_places_keep_their_values(spark):
    of = lambda **k: [json.dumps({n: f"{v}{i}" for n, v in k.items()}) for i in range(6)]
    got = unify(spark, [of(a="v"), of(b="v"), of(b="v", a="other"), of(b="v", a="other")])
    assert got[200] == {"structured.a": "v0", "structured.a@2": "other0"} and got[305] == {"structured.a": "v5", "structured.a@2": "other5"} and got[103] == {"structured.a": "v3"}
    swapped = unify(spark, [of(a="v", b="w"), of(a="w", b="v")])  # by name only, since both names go on
    assert swapped[100] == {"structured.a": "w0", "structured.b": "v0"}
    back = unify(spark, [of(a="v", k="k"), of(k="k"), of(a="n", k="k")])
    assert back[200] == {"structured.a": "n0", "structured.k": "k0"}
    crossed = unify(spark, [of(a="v"), of(b="v"), of(c="v", b="x")])
    assert crossed[200] in ({"structured.a": "x0", "structured.c": "v0"}, {"structured.a": "x0", "structured.c@2": "v0"})


def test_leaves_of_any_depth(spark):
    deep = {"x": 1, "o": {}, "n": None}
    for i in range(8):
        deep = {f"k{i}": deep, "t": i}
    rows = [(1, 1, json.dumps(deep), {"m": "v", "z": None}), (2, 1, '{"a": 1.0, "b": 10, "c": 1e3, "d": 12345678901234567890123, "e": [1, {"f": 2}], "g": "", "h": false}', None), (3, 1, "not json", None), (4, 1, "[1]", {}), (5, 1, None, None)]
    df = spark.createDataFrame(rows, "record_id long, file_id long, structured string, metadata map<string,string>").withColumn("name", F.lit("clash")).withColumn("key", F.lit(1))
    got = {(r["record_id"], r["root"], r["name"]): (r["type"], r["value"]) for r in drift.fields(df).collect()}
    path = "".join(f"k{i}." for i in range(7, -1, -1))
    want = {(1, "structured", path + "x"): ("integer", "1"), (1, "metadata", "m"): ("text", "v")}
    want |= {(1, "structured", "".join(f"k{k}." for k in range(7, i, -1)) + "t"): ("integer", str(i)) for i in range(8)}
    want |= {(2, "structured", k): v for k, v in {"a": ("fraction", "1"), "b": ("integer", "10"), "c": ("fraction", "1000.0"), "d": ("integer", "12345678901234567890123"), "e": ("array", '[1,{"f":2}]'), "g": ("text", ""), "h": ("boolean", "false")}.items()}
    assert got == want


def test_assignment_is_the_best_one():
    import itertools

    rnd = np.random.default_rng(0)
    for _ in range(60):
        r, c = rnd.integers(1, 6, 2)
        w = np.where(rnd.random((r, c)) < 0.4, 0, rnd.random((r, c)))
        got = drift.assign(w)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used))
        padded = np.zeros((r, max(r, c)))
        padded[:, :c] = w
        best = max(sum(padded[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(r, c)), int(r)))
        assert sum(w[i, j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best)


def test_long_runs_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), i, i, float(rnd.random() < 0.85) if rnd.random() > 0.02 else float("nan")) for i in range(3000)]
    rows += rows[:50]
    got = {r["id"] for r in long_runs(spark.createDataFrame(rows, "entity string, at long, id long, value double"), 6).collect()}
    want = set()
    for e in "ab":
        run = []
        for x in [*sorted({(a, i, v) if v == v else (a, i, "nan") for ee, a, i, v in rows if ee == e}), (1 << 40, -1, None)]:
            if run and run[-1][2] != x[2]:
                want |= {r[1] for r in run} if len(run) >= 6 else set()
                run = []
            run.append(x)
    assert got == want
    whole = spark.createDataFrame([("a", i, i, 5.0) for i in range(500)], "entity string, at long, id long, value double")
    assert long_runs(whole, 6).count() == 500 and long_runs(whole.where("id < 5"), 6).count() == 0


def test_faults(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2023, 1, 1, tzinfo=UTC)
    rows = []
    for i in range(600):
        level = 10.0 if i < 300 else 200.0  # a lasting change
        v = level * 2 ** rnd.gauss(0, 0.3)
        if i % 3 == 0:
            v *= 12  # a second habitual level
        rows.append([i, t0 + dt.timedelta(minutes=10 * i), ("stdin", None, None), v])
    special = {50: -1.0, 51: float("nan"), 52: float("inf"), 53: 4e6, 100: 10.0 * 500, 101: 0.01, 450: 200.0 * 900, 200: 7.0, 201: 7.0, 202: 7.0, 203: 7.0, 204: 7.0, 205: 7.0}
    for k, v in special.items():
        rows[k][3] = v
    rows.append([900, t0, None, None])
    df = spark.createDataFrame(rows, "entry_id long, received_at timestamp, source struct<kind:string,addr:string,path:string>, latency_ms double").withColumn("value", F.lit("clash")).withColumn("id", F.lit(1))
    got = sorted((r["entry_id"], r["fault"]) for r in spikes.faults(df.unionByName(df)).collect())
    assert got == [(50, "impossible"), (51, "impossible"), (52, "impossible"), (53, "impossible"), (100, "spike"), (101, "spike"), *[(i, "stuck") for i in range(200, 206)], (450, "spike")]
    assert spikes.faults(df.where("false")).count() == 0


def test_implausible_rate_of_change(spark):
    """A reading of a level that was left is a spike if it comes and goes in one step and the level is no habit; the change isn't one."""
    rnd = random.Random(4)
    t0 = dt.datetime(2023, 1, 1, tzinfo=UTC)
    rows = [(i, t0 + dt.timedelta(seconds=30 * i), ("stdin", None, None), (10.0 if i < 6 or i == 60 else 200.0) * 2 ** rnd.gauss(0, 0.1)) for i in range(110)]
    kind = "entry_id long, received_at timestamp, source struct<kind:string,addr:string,path:string>, latency_ms double"
    assert [tuple(r) for r in spikes.faults(spark.createDataFrame(rows, kind)).collect()] == [(60, "spike")]
    habit = [(i, t, s, v if i % 5 else 10.0 * 2 ** rnd.gauss(0, 0.1)) for i, t, s, v in rows]
    assert spikes.faults(spark.createDataFrame(habit, kind)).count() == 0


def test_expanded_fences():
    counts = np.zeros(100, int)
    counts[40:61] = 10
    lo, hi = spikes.quartile_fences(counts)
    assert (lo, hi) == (45 - 30, 55 + 30)
    two = counts.copy()
    two[90:92] = 30
    (a, b, n), (c, d, m) = spikes.levels_of(two)
    assert (a, b, n) == (15, 85, 210) and (c, d, m) == (81, 100, 60)
    assert spikes.levels_of(np.zeros(5, int)) == []


def test_neighbours_over_the_ends_of_hours(spark):
    rnd = random.Random(5)
    rows = sorted({(rnd.choice("ab"), rnd.randint(0, 40) ** 2 // 40, rnd.randint(0, 9), i) for i in range(300)})
    rows = [(e, h, h * 10 + a, i, rnd.randint(0, 50)) for e, h, a, i in rows]
    got = {r["id"]: (r["before"], r["after"]) for r in spikes.stepped(spark.createDataFrame(rows, "entity string, hour long, at long, id long, cell int")).collect()}
    for e in "ab":
        mine = sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[3]))
        for k, r in enumerate(mine):
            assert got[r[3]] == (mine[k - 1][4] if k else None, mine[k + 1][4] if k + 1 < len(mine) else None)
