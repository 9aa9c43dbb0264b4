"""Stamps of any notation and zone as exact UTC instants (problem 1).

Each notation has one pattern. A stamp is rewritten once into its fields; epochs and stamps with an offset name an instant by
themselves. The others are local times: they are joined to the intervals of constant offset of their zone, exploded by local
month, of any year from 1 to 9999, so that the join is an equi-join on zone and month with a range check. Two matching intervals mean that the local time is
ambiguous, none that it doesn't exist, one gives the offset directly. A stamp without year is tried with the year of
received_at and its neighbours.

What is still ambiguous is settled within the row: received_at follows content by at most FOLLOW_US, give or take the
precision written. If exactly one pair of candidates fits, both stamps are taken from it.

Defined cases: null, blank and placeholder stamps, dates that don't exist and local times that a clock change skips name no
instant and give no row; a stamp that stays ambiguous gives no row; an unknown zone abbreviation gives no row; repeated rows
give one; an unknown sender counts as UTC with day before month; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise

FOLLOW_US = 90_000_000
SECOND = 1_000_000

# Month names and the offsets, in seconds, of zone abbreviations that a sender's own zone doesn't explain.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 3600, "BST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800, "MSK": 10800,
    "IST": 19800, "SGT": 28800, "HKT": 28800, "AWST": 28800, "JST": 32400, "KST": 32400, "ACST": 34200, "AEST": 36000, "ACDT": 37800, "AEDT": 39600,
    "NZST": 43200, "NZDT": 46800, "AST": -14400, "ADT": -10800, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600,
    "PST": -28800, "PDT": -25200, "AKST": -32400, "AKDT": -28800, "HST": -36000,
}

_DAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +)?"
_MON = r"([A-Z][a-z]{2})[a-z]*\.?"
_CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
_ABBR = r"(?!CRIT\b)(?:UTC|UT|MSK|[A-Z]{1,3}T)\b"
_ZONE = rf"(?: ?(Z|[+-]\d{{2}}(?::?\d{{2}})?|{_ABBR})(?:\[([A-Za-z_]+(?:/[A-Za-z_+-]+)*)\])?)?"

#: (pattern, replacement): the fields are kind|year|month|day|hour|minute|second|fraction|half day|zone|named zone.
#: Kind is `a` for year-month-day, `o` for year and day of year, `x` for two numbers whose order the locale gives, `y` for no year.
FORMS = (
    (rf"(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T ]{_CLOCK}{_ZONE}", "a|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}(?::?\d{2})?)?", "a|$1|$2|$3|$4|$5|$6|$7||$8|"),
    (rf"(\d{{4}})-(\d{{3}})T{_CLOCK}{_ZONE}", "o|$1||$2|$3|$4|$5|$6||$7|$8"),
    (rf"(\d{{1,2}})-{_MON}-(\d{{4}}) {_CLOCK}{_ZONE}", "a|$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    (rf"(\d{{1,2}})/{_MON}/(\d{{4}}):{_CLOCK}{_ZONE}", "a|$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    (rf"{_DAY}(\d{{1,2}}) {_MON} (\d{{4}}) {_CLOCK}{_ZONE}", "a|$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    (rf"{_DAY}{_MON} +(\d{{1,2}}),? +(\d{{4}}),? +{_CLOCK}(?: ?([AP])\.?M\.?)?(?: ({_ABBR}|[+-]\d{{2}}:?\d{{2}}))?", "a|$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_CLOCK}(?: ?([AP])\.?M\.?)?(?: ({_ABBR}|[+-]\d{{2}}:?\d{{2}}))?", "x|$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_CLOCK}{_ZONE}", "a|$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    (rf"{_DAY}{_MON} +(\d{{1,2}}) {_CLOCK}{_ZONE}", "y||$1|$2|$3|$4|$5|$6||$7|$8"),
)
EPOCH = r"(?:\d{10}(?:\.\d+)?|\d{13}|\d{16}|\d{19})"


def stamp_of(content: Column) -> Column:
    """The stamp of a line: under `ts` or `time` of a JSON object or of key=value pairs, in the brackets of an access line,
    or what the line begins with, in brackets or not; else null."""
    c = F.trim(F.regexp_replace(content, r"^\s+|\s+$", ""))
    head = re.sub(r"(?<!\\)\((?!\?)", "(?:", "|".join(f for f, _ in FORMS))  # without its groups
    access = F.regexp_extract(c, r"^\S+ \S+ \S+ \[([^\]]+)\]", 1)
    pair = F.regexp_extract(c, r'^(?:\w[\w.-]*=(?:"[^"]*"|\S*) +)*?(?:ts|time)=(?:"([^"]*)"|(\S+))', 0)
    value = F.regexp_replace(F.regexp_extract(pair, r'(?:ts|time)=("[^"]*"|\S+)$', 1), '"', "")
    begin = F.regexp_extract(c, rf"^\[?({head}|{EPOCH})(?=[\]\s]|$)", 1)
    return F.nullif(
        F.when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.ts"), F.get_json_object(c, "$.time")))
        .when(c.rlike(r"^\w[\w.-]*="), value)
        .when(begin != "", begin)
        .otherwise(access),
        F.lit(""),
    )


def fields_of(stamp: Column) -> Column:
    """The fields of a stamp, as an array of eleven strings; null if no notation fits."""
    s = F.regexp_replace(stamp, r"^[\s\[]+|[\s]+$", "")
    s = F.when(s.endswith("]") & ~s.contains("["), F.regexp_replace(s, r"\]$", "")).otherwise(s)
    out = F.when(s.rlike(f"^{EPOCH}$"), F.concat(F.lit("e|"), s))
    for form, fields in FORMS:
        out = out.when(s.rlike(f"^{form}$"), F.regexp_replace(s, f"^{form}$", fields))
    return F.split(out, r"\|")


def near_year(stamp: Column) -> Column:
    """The year a stamp shows, without reading the rest of it; null where it shows none."""
    s = F.regexp_replace(stamp, r"^\s+", "")
    shown = F.regexp_extract(s, r"(?:^|[-/. \[])((?:19|20)\d{2})(?=[-/. :]|\d{4}T|$)", 1)
    return F.when(s.rlike(rf"^{EPOCH}\s*$"), F.year(F.timestamp_seconds(_int(F.substring(s, 1, 10)))).cast("bigint")).otherwise(_int(F.nullif(shown, F.lit(""))))


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date that exists, else null."""
    date = F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.unix_date(date))


def zone_intervals(months: DataFrame) -> DataFrame:
    """Of rows (zone, month), a local month as yyyymm of any year from 1 to 9999: the intervals of constant offset that reach into it,
    from_us and to_us (local) and offset_us, and in a row of its own the abbreviations of the zone in that year with their offsets.
    The zone rules are public and hold for any year. Only the months that occur are worked out, each a few rows."""

    def run(batches):
        from datetime import UTC, datetime, timedelta
        from functools import lru_cache
        from zoneinfo import ZoneInfo

        import pandas as pd

        epoch = datetime(1970, 1, 1, tzinfo=UTC)
        first, last = (int((d - epoch).total_seconds()) for d in (datetime(1, 1, 3, tzinfo=UTC), datetime(9999, 12, 29, tzinfo=UTC)))

        @lru_cache(None)
        def at(name, s):
            t = (epoch + timedelta(seconds=min(max(s, first), last))).astimezone(ZoneInfo(name))
            return int(t.utcoffset().total_seconds()), t.tzname()

        for pdf in batches:
            rows = []
            for name, month in zip(pdf["zone"], pdf["month"], strict=True):
                year, m = divmod(int(month), 100)
                try:
                    ZoneInfo(name)
                    begin = int((datetime(year, m, 1, tzinfo=UTC) - epoch).total_seconds())
                except Exception:  # not a zone or a year: its local times name no instant
                    continue
                s, end = begin - 2 * 86400, begin + 34 * 86400
                cuts, start, now = [], s, at(name, s)[0]
                while s < end:
                    t = s + 86400
                    if (then := at(name, t)[0]) != now:
                        lo, hi = s, t
                        while hi - lo > 1:
                            mid = (lo + hi) // 2
                            lo, hi = (mid, hi) if at(name, mid)[0] == now else (lo, mid)
                        cuts.append((start, hi, now))
                        start, now = hi, then
                    s = t
                cuts.append((start, end, now))
                rows += [(name, month, (a + off) * SECOND, (b + off) * SECOND, off * SECOND, None) for a, b, off in cuts]
                new_year = int((datetime(year, 1, 1, tzinfo=UTC) - epoch).total_seconds())
                names = {n: off for off, n in (at(name, new_year + k * 10 * 86400) for k in range(37)) if n}
                rows.append((name, month, None, None, None, names))
            yield pd.DataFrame(rows, columns=["zone", "month", "from_us", "to_us", "offset_us", "names"]).astype({"from_us": "Int64", "to_us": "Int64", "offset_us": "Int64"})

    return months.mapInPandas(run, "zone string, month bigint, from_us bigint, to_us bigint, offset_us bigint, names map<string,int>")


def normalise(rows: DataFrame, senders: DataFrame) -> DataFrame:
    """Of rows (id, received_at string, content, source_uri) and senders (uri, tz_name, locale): id, field, utc_us."""
    who = senders.select(F.col("uri").alias("source_uri"), "tz_name", "locale").dropDuplicates(["source_uri"])
    said = (
        rows.select("id", "received_at", "content", "source_uri")
        .join(broadcast_if_small(who), "source_uri", "left")
        .select(
            "id",
            F.coalesce("tz_name", F.lit("UTC")).alias("tz"),
            F.coalesce("locale", F.lit("")).alias("locale"),
            near_year(F.col("received_at")).alias("near"),
            F.explode(F.array(F.struct(F.lit("received_at").alias("field"), F.col("received_at").alias("stamp")), F.struct(F.lit("content").alias("field"), stamp_of(F.col("content")).alias("stamp")))).alias("s"),
        )
        .select("id", "tz", "locale", "near", "s.field", fields_of(F.col("s.stamp")).alias("f"))
    )
    f = F.col("f")
    part = lambda i: F.try_element_at(f, F.lit(i + 1))
    kind = part(0)
    month = F.coalesce(_int(part(2)), F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(2), 1, 3))))
    month_first = (kind == "x") & ((F.col("locale") == "en_US") | part(8).isin("A", "P"))
    m, d = F.when((kind == "x") & ~month_first, _int(part(3))).otherwise(month), F.when((kind == "x") & ~month_first, month).otherwise(_int(part(3)))
    m = F.when(m > 0, m)
    hour = F.when(part(8) == "P", F.pmod(_int(part(4)), F.lit(12)) + 12).when(part(8) == "A", F.pmod(_int(part(4)), F.lit(12))).otherwise(_int(part(4)))
    frac = _int(F.rpad(F.substring(F.coalesce(part(7), F.lit("")), 1, 6), 6, "0"))
    clock = F.when((hour < 24) & (_int(part(5)) < 60) & (_int(part(6)) < 61), ((hour * 60 + _int(part(5))) * 60 + _int(part(6))) * SECOND + frac)
    written = F.least(F.length(F.coalesce(part(7), F.lit(""))), F.lit(6))
    raw = part(1)
    whole, rest = F.regexp_extract(raw, r"^(\d+)", 1), F.regexp_extract(raw, r"\.(\d+)$", 1)
    epoch = F.when(F.length(whole) == 10, _int(whole) * SECOND + _int(F.rpad(F.substring(rest, 1, 6), 6, "0"))).when(F.length(whole) == 13, _int(whole) * 1000).when(F.length(whole) == 16, _int(whole)).when(F.length(whole) == 19, _int(F.substring(whole, 1, 16)))
    digits = F.when(kind == "e", F.when(F.length(whole) == 10, F.least(F.length(rest), F.lit(6))).when(F.length(whole) == 13, 3).otherwise(6)).otherwise(written)
    zone, named = F.nullif(part(9), F.lit("")), F.nullif(part(10), F.lit(""))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone.rlike(r"^[+-]"), sign * (_int(F.substring(zone, 2, 2)) * 3600 + F.coalesce(_int(F.regexp_extract(zone, r"^.\d{2}:?(\d{2})$", 1)), F.lit(0)) * 60)).when(zone.isin("Z", "UTC", "GMT", "UT"), 0)
    years = F.when(kind == "y", F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.col("near") + k)).otherwise(F.array(_int(part(1))))
    parsed = said.select(
        "id", "field", F.coalesce(named, F.col("tz")).alias("zone"), zone.alias("abbr"), offset.cast("bigint").alias("offset"), F.when(kind == "e", epoch).alias("instant"),
        F.pow(F.lit(10), 6 - digits).cast("bigint").alias("grain"), kind.alias("kind"), F.explode(years).alias("year"), m.alias("m"), d.alias("d"), clock.alias("clock"),
    )
    days = F.when(F.col("kind") == "o", F.when(F.col("d").between(1, 366), _days(F.col("year"), F.lit(1), F.lit(1)) + F.col("d") - 1)).otherwise(_days(F.col("year"), F.col("m"), F.col("d")))
    timed = parsed.withColumn("local", days.cast("bigint") * 86400 * SECOND + F.col("clock")).drop("kind", "year", "m", "d", "clock")
    timed = materialise(timed.where("instant is not null or local is not null"))  # parsed once for the four uses below

    timed = timed.withColumn("month", F.when(F.col("instant").isNull() & F.col("offset").isNull(), F.date_format(F.timestamp_micros("local"), "yyyyMM").cast("bigint")))
    table = zone_intervals(timed.where("month is not null").select("zone", "month").distinct())
    names = table.where("names is not null").select("zone", "month", "names")
    spans = table.where("names is null").drop("names")
    fixed = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    abbreviated = timed.where("month is not null and abbr is not null").join(names, ["zone", "month"], "left").withColumn("offset", F.coalesce(F.try_element_at("names", F.col("abbr")).cast("bigint"), F.try_element_at(fixed, F.col("abbr")).cast("bigint")))
    direct = timed.where("instant is not null or offset is not null").select("id", "field", "grain", F.coalesce("instant", F.col("local") - F.col("offset") * SECOND).alias("us"))
    direct = direct.unionByName(abbreviated.where("offset is not null").select("id", "field", "grain", (F.col("local") - F.col("offset") * SECOND).alias("us")))
    local = timed.where("month is not null and abbr is null")
    inside = (F.col("local") >= F.col("from_us")) & (F.col("local") < F.col("to_us"))
    joined = local.join(spans, ["zone", "month"]).where(inside).select("id", "field", "grain", (F.col("local") - F.col("offset_us")).alias("us"))
    return _settle(direct.unionByName(joined))


def _settle(candidates: DataFrame) -> DataFrame:
    """Of all candidates (id, field, grain, us): the one instant of each field, where the row itself decides."""
    by_id = candidates.groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("field") == "received_at", F.struct("us", "grain")))).alias("r"),
        F.array_sort(F.collect_set(F.when(F.col("field") == "content", F.struct("us", "grain")))).alias("c"),
    )
    pairs = F.flatten(F.transform("r", lambda r: F.transform("c", lambda c: F.struct(r["us"].alias("r"), c["us"].alias("c"), r["grain"].alias("rg"), c["grain"].alias("cg")))))
    fits = F.filter(pairs, lambda p: (p["r"] - p["c"] > -p["rg"]) & (p["r"] - p["c"] < FOLLOW_US + p["cg"]))
    judged = by_id.withColumn("fits", fits)
    one = lambda field, mine: F.when(F.size(field) == 1, F.col(field)[0]["us"]).when(F.size(F.array_distinct(F.transform("fits", lambda p: p[mine]))) == 1, F.col("fits")[0][mine])
    both = F.array(F.struct(F.lit("received_at").alias("field"), one("r", "r").alias("utc_us")), F.struct(F.lit("content").alias("field"), one("c", "c").alias("utc_us")))
    return judged.select("id", F.explode(both).alias("x")).select("id", "x.field", "x.utc_us").where("utc_us is not null")


def export_stamps(exports: DataFrame, senders: DataFrame) -> DataFrame:
    return normalise(exports.withColumnRenamed("export_id", "id"), senders).withColumnRenamed("id", "export_id")
