"""The training-data operators on small inputs: brute force, round trips, and the rows that break things."""

import datetime as dt
import math
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("logloom.llm")
from logloom.llm import packing, percentiles, pii, quality, runs, tokenize  # noqa: E402

UTC = dt.UTC
T0 = dt.datetime(2023, 1, 1, tzinfo=UTC)
ENTRIES = "entry_id long, received_at timestamp, source struct<kind:string,addr:string,path:string>, content string"


@pytest.fixture(scope="module")
def encoder():
    return tokenize.encoder_of(open(tokenize.vocabulary_path(), "rb").read())


def test_backtracking_equals_merging(encoder):
    rnd = random.Random(0)
    letters = "aeinrst \n'dlé日ж0123ab.,_"
    for _ in range(3000):
        raw = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 24))).encode()
        assert encoder.backtrack(raw) == encoder.merges(raw)
    raw = b"a" * 3000 + bytes(range(256))
    assert encoder.backtrack(raw[:600]) == encoder.merges(raw[:600])
    assert b"".join(encoder.token[i] for i in encoder.backtrack(raw)) == raw


def test_ids_equal_the_public_tokenizer(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenize.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rnd = random.Random(1)
    letters = "aAbétT'sn 0123½²　\xa0\n\r\t .,-\x1c\x1f日本´ßжЖ😀_́:>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["<|endoftext|>", "1\r\n00:00:01,500 --> 00:00:02,000\r\nHi  there\n\n\n2\n", "﻿x\n\n", "00:01 --> 5,123 ", "it's\n\n\n ok", "x" * 5000, " \n" * 50]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == want.ids, repr(text)


def test_corpus_encoding(spark, encoder):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "hello world"), (4, "hello world"), (5, "a b" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = tokenize.encode_corpus(df).collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in got) == sorted((i, len(encoder.encode(t))) for i, t in rows)
    assert next(r["ids"] for r in got if r["doc_id"] == 3) == []
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenize.count_tokens(df).collect()}
    assert counts[5] == len(encoder.encode(rows[-1][1])) and counts[3] == 0
    assert tokenize.encode_corpus(df.where("false")).count() == 0


def test_packing(spark):
    rnd = random.Random(4)
    items = [(i, int(rnd.paretovariate(0.7) * 3)) for i in range(3000)] + [(9000, 0), (9001, None), (9002, 1000), (9003, 1001), (9004, 64), (9005, 5000)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long").withColumn("bin_id", F.lit("clash"))
    for shard in (10**6, 100):
        rows = packing.pack(df.unionByName(df), "doc_id", "n_tokens", 1000, shard).collect()
        total, bins = {}, {}
        for r in rows:
            total.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
            bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
        assert max(bins.values()) <= 1000
        for i, n in items:
            pieces = sorted(total[i])
            assert sum(x for _, x in pieces) == (n or 0) and [p for p, _ in pieces] == list(range(len(pieces)))
            assert len(pieces) == max(1, math.ceil((n or 0) / 1000)) and all(x == 1000 for _, x in pieces[:-1])
    packed = packing.pack(df, "doc_id", "n_tokens", 1000)
    assert packing.fill_report(packed, 1000).agg(F.max("fullest")).first()[0] <= 1000
    assert packing.pack(df.where("false"), "doc_id", "n_tokens").count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "n_tokens", 0)


def test_containers_are_harmonic_and_full():
    rnd = random.Random(9)
    for capacity, sizes in ((1000, [min(1000, int(rnd.paretovariate(0.9) * 20)) for _ in range(4000)]), (10, [rnd.randint(0, 10) for _ in range(500)]), (8, [0, 0]), (8, []), (7, [7]), (9, [5, 5, 5, 4, 4, 4])):
        into, begun = packing.containers(sizes, capacity)
        held: dict = {}
        for i, k in enumerate(into):
            held.setdefault(k, []).append(sizes[i])
        assert sorted(held) == list(range(len(begun))) and all(sum(x) <= capacity for x in held.values())
        for k, j in enumerate(begun[:-1]):
            own = [s for s in held[k] if s and capacity // s == j]
            assert 1 <= len(own) and (len(own) >= j or not any(s and capacity // s == j for later in range(k + 1, len(begun)) for s in held[later]))
        if capacity == 1000:  # many small items; with few sizes, as for 10, gaps can't always be filled
            assert sum(sizes) > 0.97 * capacity * (len(begun) - 1)
    assert packing.containers([5, 5, 5, 4, 4, 4], 9)[1] == [1, 1, 1]


def bits(v):
    b = struct.unpack("<q", struct.pack("<d", v + 0.0))[0]
    return b if b >= 0 else b ^ 0x7FFFFFFFFFFFFFFF


def test_percentiles(spark):
    rnd = random.Random(5)
    values = [(rnd.choice(["a", "a", "b", None]), rnd.choice([rnd.gauss(0, 1) * 10 ** rnd.randint(-9, 9), float(rnd.randint(-3, 3)), -0.0])) for _ in range(4000)]
    bad = [("a", None), ("a", float("nan")), ("b", float("inf")), ("b", float("-inf")), ("only", float("nan")), ("one", 5.0)]
    df = spark.createDataFrame(values + bad, "g string, v double").withColumn("k", F.lit("clash")).withColumn("n", F.lit(1))
    got = {(r["g"], r["permille"]): (r["n"], r["value"]) for r in percentiles.select_ranks(df, ["g"], "v", (1, 500, 990, 1000)).collect()}
    want = {}
    for g in ("a", "b", None, "one"):
        mine = sorted(v for x, v in [*values, ("one", 5.0)] if x == g)
        want |= {(g, p): (len(mine), mine[max(1, -(-p * len(mine) // 1000)) - 1]) for p in (1, 500, 990, 1000)}
    assert got == want
    days = df.withColumn("day", (F.rand(1) * 3).cast("int"))
    parts = percentiles.digit_histogram(days, ["g", "day"], "v")
    for r in percentiles.bounds_from(percentiles.combine(parts, ["g"]), ["g"], (1, 500, 990, 1000)).collect():
        n, v = want[r["g"], r["permille"]]
        assert r["n"] == n and r["lo"] <= v <= r["hi"] and r["hi"] - r["lo"] <= abs(v) / 2**7 + 1e-300
    assert percentiles.select_ranks(df.where("false"), ["g"], "v").count() == 0
    for v in (1.0, -1.0, 0.0, -0.0, 1e308, -1e-308):
        row = spark.createDataFrame([(v,)], "v double").select(percentiles.ordered_bits("v").alias("k")).withColumn("v", percentiles.value_of_bits("k")).first()
        assert (row["k"], row["v"]) == (bits(v), v)


WORDS = ["link 5 is up", "link 77 is up", "link 5 is down", "2023-01-01 00:00:01 got 1f2e3d4c from 10.0.0.1", "2023-01-01 00:00:09 got aabbccdd1 from 10.0.0.2", "", None]


def entries_of(spark, n, seed):
    rnd = random.Random(seed)
    rows = [(i, T0 + dt.timedelta(seconds=rnd.randint(0, 10**6), microseconds=i), rnd.choice([("stdin", None, None), ("stdin", None, None), ("tcp", "a:1", None), None]), rnd.choice(WORDS)) for i in range(n)]
    return rows, spark.createDataFrame(rows, ENTRIES).withColumn("template", F.lit("clash")).withColumn("at", F.lit(3))


def test_repeated_events_against_brute_force(spark):
    rows, df = entries_of(spark, 3000, 6)
    kind = {WORDS[0]: 1, WORDS[1]: 1, WORDS[2]: 2, WORDS[3]: 3, WORDS[4]: 3, "": 4, None: 4}
    want = set()
    for s in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (r[1], r[0]))
        i = 0
        while i < len(mine):
            j = i
            while j + 1 < len(mine) and kind[mine[j + 1][3]] == kind[mine[i][3]]:
                j += 1
            if j > i:
                want.add((mine[i][0], mine[j][0], j - i + 1, (mine[j][1] - mine[i][1]) // dt.timedelta(microseconds=1)))
            i = j + 1
    got = [tuple(r) for r in runs.repeated(df.unionByName(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r["n_events"] for r in runs.runs(df).collect()) == 3000
    same = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), ("stdin", None, None), f"tick {i}") for i in range(900)], ENTRIES)
    assert [tuple(r) for r in runs.repeated(same).collect()] == [(0, 899, 900, 899_000_000)]
    assert runs.repeated(df.where("false")).count() == 0


def test_agglomeration_order_and_limits():
    a, b, c = "w x y z", "w x y q", "w x p q"
    near = runs.agglomerate([(0, 1, a), (1, 2, b), (2, 3, c), (3, 4, c)], 0.7, None)
    assert [(r[1], r[3], r[4]) for r in near] == [(1, 2, 2), (3, 4, 2)]  # the equal pair, then the earlier of two ties, after which a and c are too far apart
    assert [r[4] for r in runs.agglomerate([(0, 1, a), (100, 2, a), (101, 3, a)], 1.0, 50)] == [1, 2]
    assert runs.agglomerate([], 1.0, None) == [] and len(runs.agglomerate([(0, 1, a)], 0.5, 1)) == 1


def test_near_runs_do_not_depend_on_partitions(spark):
    rnd = random.Random(8)
    words = "ash beech cedar elm fir".split()
    rows, at = [], {}
    for i in range(4000):
        source = rnd.choice([("stdin", None, None)] * 3 + [("tcp", "a:1", None)])
        at[source] = at.get(source, 0) + rnd.choice([1, 5, 30, 200, 300, 301])
        text = " ".join(rnd.choice(words) if rnd.random() < 0.12 else w for w in words)
        rows.append((i, T0 + dt.timedelta(seconds=at[source]), source, f"{text} {i}"))
    want = set()
    for s in at:
        mine = sorted((int((t - T0).total_seconds()) * 1_000_000, i, c.rsplit(" ", 1)[0] + " #") for i, t, x, c in rows if x == s)
        want |= {(r[1], r[3], r[4]) for r in runs.agglomerate(mine, 0.65, 300_000_000)}
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, ENTRIES)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [(r["first_entry_id"], r["last_entry_id"], r["n_events"]) for r in runs.runs(df.unionByName(df), 0.65, 300_000_000).collect()]
            assert len(got) == len(want) < 3000 and set(got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs.runs(df.where("false"), 0.8, 1).count() == 0
    with pytest.raises(ValueError):
        runs.runs(df, 0.8)


TEXTS = [
    ("my name is Ada B. Lovelace and my number changed to +44 20 7946 0433", [("name", "Ada B. Lovelace"), ("phone", "+44 20 7946 0433")]),
    ("Frau O'NEIL, Maria-Lou, 12a Old Ferry Ave, meldet", [("name", "O'NEIL, Maria-Lou"), ("address", "12a Old Ferry Ave")]),
    ("Mr J. Doe of Mühlgasse 4b, Town; lives at 147, avenue du Moulin", [("name", "J. Doe"), ("address", "Mühlgasse 4b"), ("address", "147, avenue du Moulin")]),
    ("mail ada.l+x@mx.host.example, bob(at)site(dot)test, eve [at] a.example or u=joe%40b.test", [("email", "ada.l+x@mx.host.example"), ("email", "bob(at)site(dot)test"), ("email", "eve [at] a.example"), ("email", "joe%40b.test")]),
    ("id 984-16-7023, QQ 39 25 40 A, X1739628W, 850801-6639, 46100992046", [("identity", x) for x in ("984-16-7023", "QQ 39 25 40 A", "X1739628W", "850801-6639", "46100992046")]),
    ("(555) 555-0180 or 0049-30-23125647 or 030/23125-683 or 555-555-0130", [("phone", x) for x in ("(555) 555-0180", "0049-30-23125647", "030/23125-683", "555-555-0130")]),
    ("build 555-2072 of Blue Ledger, parcel batch 40402-77-0166 at North Gate lane 19, root@host:/data via Road Runner 7, 10.20.30.40, 6425329811 bytes since 3205053174144", []),
    ("[02/Jan/2023:01:09:00 +0000] acct335 svc_orders", []), ("", []), (None, []),
]


def test_mentions_and_placeholders(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "entry_id long, content string").withColumn("mentions", F.lit("clash"))
    got = {}
    for r in pii.found_rows(df.unionByName(df), "k").collect():
        got.setdefault(r["entry_id"], []).append((r["pii_type"], r["pii_text"]))
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(w) for i, (_, w) in enumerate(TEXTS) if w}
    red = {r["entry_id"]: r["content"] for r in pii.redact(df, "k").collect()}
    assert len(red) == len(TEXTS) and red[6] == TEXTS[6][0] and red[8] == "" and red[9] is None
    assert all(x not in red[i] for i, (_, w) in enumerate(TEXTS) for _, x in w) and red[0].startswith("my name is [NAME ") and "[PHONE +" in red[0]
    long = spark.createDataFrame([(1, "x " * 200_000 + "Mr Al Bo.")], "entry_id long, content string")
    assert [(r["pii_type"], r["pii_text"]) for r in pii.found_rows(long, "k").collect()] == [("name", "Al Bo")]
    assert pii.found_rows(df.where("false"), "k").count() == pii.redact(df.where("false"), "k").count() == 0
    for bad in ("", None):
        with pytest.raises(ValueError):
            pii.redact(df, bad)


def test_only_mentions_are_replaced(spark):
    """What looks like a mention inside of something else stays, though the same text is a mention elsewhere in the line."""
    texts = ["id 984-16-7023 in parcel 1984-16-70231 and 984-16-7023", "[x] Mr Al Bo met Al Bo, not Al Boson or Al-Bo; call +44 20 7946 0433.", "a|b $1 \\\\1 Mr Al Bo [NAME x]", "name: Al Bo"]
    df = spark.createDataFrame(list(enumerate(texts)), "entry_id long, content string")
    p = pii.Pseudonyms("k")
    name, ssn = f"[NAME {p.tag('Al Bo')}]", f"[IDENTITY {p.identity('984-16-7023')}]"
    assert [r["content"] for r in pii.redact(df, "k").orderBy("entry_id").collect()] == [
        f"id {ssn} in parcel 1984-16-70231 and {ssn}", f"[x] Mr {name} met {name}, not Al Boson or Al-Bo; call [PHONE {p.phone('+44 20 7946 0433')}].", f"a|b $1 \\\\1 Mr {name} [NAME x]", f"name: {name}",
    ]
    other = {r["content"] for r in pii.redact(df, "other").collect()}
    assert f"name: {name}" not in other


def test_names_without_cues(spark):
    """Given names seen before, with surnames seen before: not other capitalised words, nor parts of addresses and the like."""
    texts = ["Mr Kim Ray", "customer Kim Orm", "signed by Kim Sorv", "dear Zoe Quill", "Ray, Kim of Blue Ledger", "Yesterday Kim Quill left", "Quill, Kim", "Kim Unknown", "Blue Ray", "Zoe Ray", "path/Kim Ray", "Kim A. Orm paid"]
    df = spark.createDataFrame(list(enumerate(texts)), "entry_id long, content string")
    got = {(r["entry_id"], r["pii_text"]) for r in pii.found_rows(df, "k").collect()}
    assert got == {(0, "Kim Ray"), (1, "Kim Orm"), (2, "Kim Sorv"), (3, "Zoe Quill"), (4, "Ray, Kim"), (5, "Kim Quill"), (6, "Quill, Kim"), (11, "Kim A. Orm")}
    red = {r["entry_id"]: r["content"] for r in pii.redact(df, "k").collect()}
    assert red[5].startswith("Yesterday [NAME ") and red[5].endswith("] left") and red[10] == texts[10] and red[8] == texts[8]


def test_pseudonyms_stay_in_their_format():
    p, rnd = pii.Pseudonyms("k"), random.Random(7)
    forms = ["+44 20 7946 0433", "+1 (555) 555-0123", "(555) 555-0180", "0049-30-23125647", "030/23125-683", "555-555-0130", "984-16-7023", "078-05-1120", "123 45 6789", "QQ 39 25 40 A", "X1739628W", "850801-6639", "46100992046"]
    seen: dict = {}
    for form in forms:
        kind = "phone" if form[0] in "+(" or form[:2] in ("00", "03") or form == "555-555-0130" else "identity"
        for _ in range(800):
            text = "".join(str(rnd.randint(0, 9)) if c.isdigit() else c for c in form)
            made = p.of(kind, text)
            assert p.of(kind, made, True) == text and len(made) == len(text) and pii.is_valid(made) == pii.is_valid(text)
            assert all(x.isdigit() == y.isdigit() and (x.isdigit() or x == y or form[0] == "X") for x, y in zip(text, made, strict=True))
            assert seen.setdefault((form, made), text) == text
    for text, check, size in (("850801-663", pii.luhn, 10), ("4610099204", pii.pesel, 10)):
        right = text + str(check(pii.only_digits(text)))
        made = p.identity(right)
        assert pii.is_valid(right) and pii.is_valid(made) and made != right and p.identity(made, True) == right
        assert 1 <= int(made[2:4]) % 20 <= 12 and 1 <= int(made[4:6]) <= 31
    ok = "X1234567" + pii.nie("X1234567")
    assert pii.is_valid(ok) and pii.is_valid(p.identity(ok)) and p.identity(p.identity(ok), True) == ok
    assert p.identity("000-12-3456").startswith("000-") and p.identity("310231-1234").startswith("310231-")
    assert p.phone("+44 20 7946 0433").startswith("+44 ") and p.phone("+44 20 7946 0433") != pii.Pseudonyms("other").phone("+44 20 7946 0433")
    assert len({p.digits(f"{i:04d}") for i in range(10_000)}) == 10_000
    for n in (0, 1, 2, 17, 18, 19, 40, 100):
        s = "".join(rnd.choice("0123456789") for _ in range(n))
        assert p.digits(p.digits(s), True) == s and len(p.digits(s)) == n
    assert p.in_format("no digits") == "no digits" and p.in_format("") == ""


def srt(lines):
    return "".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{x}\n\n" for i, x in enumerate(lines, 1))


def test_kinds_of_text(spark):
    said = ["The doctor found the keys.", "Who is there?", "♪ We lost the map and went home. ♪", "No, it was not for you!", "(laughs)", "MAN 2: I know what he said..."]
    docs = [(i, srt([said[(i + k) % 6] for k in range(8)]), "en") for i in range(40)]
    docs += [
        (100, srt(["Chapter 1: The Boat", "Chapter 2: The Map", "Chapter 3: A Letter"] * 3), "eng"), (101, srt(["Editor\nAda Lovelace", "Sound\nB. Lin"] * 4), "EN"), (102, srt(["- keys\n- map\n- boat"] * 5), None),
        (103, "cue,cps,reel\n" + "".join(f"{i},1{i}.5,R1\n" for i in range(9)), "en"), (104, "+---+---+\n" + "| a | 1 |\n" * 5 + "+---+---+", "xx"),
        (105, srt(["}{@#]|\\~^", "<§=\\|*~{", "¤_\\/={"] * 3), "en"), (106, srt([":5smb 3s:3bp 16ccsn", "kfqc pz 35w| md", "qd j! l6 gz;0df4"] * 3), "en"), (107, srt(["Get more at subs.test for FREE!!!", "== synced & corrected by X ==", "visit www.subs.example"] * 3), "en"),
        (110, srt([x.encode().decode("latin-1") for x in ["Où est la clé ?", "♪ C'est la fête. ♪", "Déjà vu !"]] * 3), "en"), (111, "", "en"), (112, None, None), (113, " \n\t ", "en"), (114, srt([]), "en"), (115, srt(said * 3000), "en"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("body", F.lit("clash")).withColumn("word_count", F.lit(1))
    got = {r["doc_id"]: r["doc_kind"] for r in quality.found(df.unionByName(df)).collect()}
    assert got == {100: "list", 101: "list", 102: "list", 103: "table", 104: "table", 105: "junk", 106: "junk", 107: "junk"}
    s = {r["doc_id"]: r for r in quality.statistics(df).collect()}
    assert s[0]["end_share"] == 1.0 and 0.3 < s[0]["common_share"] < 0.9 and s[111]["mean_word_length"] is None and s[112]["word_count"] == 0
    assert quality.found(df.where("false")).count() == 0


def test_many_unspoken_texts_do_not_hide_each_other(spark):
    said = ["The doctor found the keys.", "Who is there?", "We lost the map and went home.", "No, it was not for you!"]
    kinds = {"list": srt(["Chapter 1: The Boat", "Chapter 2: The Map"] * 4), "table": "cue,cps,reel\n" + "".join(f"{i},1{i}.5,R1\n" for i in range(9)), "junk": srt(["Get more at subs.test for FREE!!!", "visit www.subs.example"] * 3)}
    for kind, text in kinds.items():
        docs = [(i, srt([said[(i + k) % 4] for k in range(8)]), "en") for i in range(60)] + [(100 + i, text, "en") for i in range(30)]
        got = {r["doc_id"]: r["doc_kind"] for r in quality.found(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
        assert got == {100 + i: kind for i in range(30)}


def test_sketches_merge(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), (F.col("id") % 50 + 1).cast("int")), F.lit("end.")).alias("text"), F.lit("en").alias("lang"))
    stats = quality.statistics(docs)
    whole, parts = quality.sketches(stats), quality.sketches(stats.where("doc_id < 1000")).unionByName(quality.sketches(stats.where("doc_id >= 1000")))
    merged = parts.groupBy("language").agg(F.kll_merge_agg_double("common_share").alias("common_share"))
    at = lambda df: {r["language"]: r["q"] for r in df.select("language", F.kll_sketch_get_quantile_double("common_share", F.lit(0.5)).alias("q")).collect()}
    assert at(merged).keys() == at(whole).keys() and all(abs(at(merged)[k] - at(whole)[k]) <= 0.05 for k in at(whole))


def test_vocabulary_path_is_a_parameter(tmp_path, monkeypatch):
    assert tokenize.vocabulary_path("x.tiktoken", str(tmp_path)) == os.path.join(str(tmp_path), "x.tiktoken")
    monkeypatch.setenv("LOGLOOM_TOKENIZERS", "/somewhere")
    assert tokenize.vocabulary_path("x") == "/somewhere/x"
