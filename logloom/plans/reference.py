"""Queries of the line operators over the raw lines of log_entries, each with its SQL. Rows delivered twice count once.

What a query needs is worked out before duplicates are dropped, so that lines themselves aren't shuffled where something short stands
for them. The SQL has patterns of its own, written out, and looks for literals one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, FileOutput, Loki, NamedPattern
from ..functions.entries import source_uri
from ..operators import latency, metrics, parser, pattern, security, windows
from ..session import read, spread
from ..sinks import files, formats, push
from ..sources import lines as sources
from .pipeline import Pipeline, passthrough, row_module, without_errors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ALL_ON = Config()
for _m in ("performance_metrics", "security", "structural_parser"):
    getattr(ALL_ON.modules, _m).enabled = True

# SQL pieces shared by the statements below.
URI = "case source.kind when 'stdin' then 'stdin' when 'file' then 'file://' || source.path else source.kind || '://' || source.addr end"
E = f"(select distinct entry_id, epoch_us(received_at) as us, {URI} as uri, source.kind as kind, content from log_entries)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


P_LEVEL = lit(r"(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL|SEVERE)\b")
LEVEL = f"case upper(regexp_extract(content, {P_LEVEL}, 1)) when '' then null when 'WARNING' then 'WARN' when 'CRITICAL' then 'FATAL' when 'SEVERE' then 'ERROR' else upper(regexp_extract(content, {P_LEVEL}, 1)) end"
P_CODE = lit(r"(?i)(?:error[_-]?code|err(?:or)?|code|status)[=:\s]*([A-Z]*\d+[A-Z0-9_-]*)|\b([A-Z]{1,3}[-_]?\d{3,5})\b")
CODE = f"coalesce(nullif(regexp_extract(content, {P_CODE}, 1), ''), nullif(regexp_extract(content, {P_CODE}, 2), ''))"
TOOK, WAITED = r"took (\d+)(ms|s|us)", r"latency[=:]\s*(\d+\.?\d*)(ms|s)?"


def latency_sql(patterns: tuple[str, ...] = (TOOK, WAITED)) -> str:
    out = "case "
    for p in patterns:
        v, u = f"try_cast(regexp_extract(content, {lit(p)}, 1) as double)", f"lower(regexp_extract(content, {lit(p)}, 2))"
        out += f"when regexp_matches(content, {lit(p)}) then case when {u} in ('us', 'µs', 'micros', 'microseconds') then {v} / 1000 when {u} in ('s', 'sec', 'secs', 'seconds') then {v} * 1000 when {u} in ('m', 'min', 'mins', 'minutes') then {v} * 60000 else {v} end "
    return out + "end"


LATENCY = latency_sql()
#: As histograms keep it: whole microseconds up to a minute.
KEPT = "case when ms * 1000 < 60000001 then floor(greatest(ms * 1000, 0)) / 1000 end"


def any_literal(literals) -> str:
    return "(" + " or ".join(f"contains(lower(content), {'chr(0)' if x == chr(0) else lit(x.lower())})" for x in literals) + ")"


P_AUTH = lit(r"(?i)(?:auth|authentication|login)\s+fail|invalid\s+(?:password|credential|token|api.?key|user)|unauthorized|(?:access|permission)\s+denied|forbidden|unknown\s+user|(?:bad|wrong|incorrect)\s+password|password\s+incorrect|failed\s+login|login\s+attempt|brute\s*force|too\s+many\s+attempts|account\s+locked|(?:session|token|jwt)\s+expired")
P_PII = (
    r"\b(?:\d{4}[-\s]?){3}\d{1,4}\b", r"\b\d{3}-\d{2}-\d{4}\b", r"(?i)(?:password|passwd|pwd)\s*[=:]\s*['\"]?[^\s'\"]+",
    r"(?i)(?:api[_-]?key|api[_-]?secret|access[_-]?token|auth[_-]?token|bearer|private[_-]?key|secret[_-]?key)\s*[=:]\s*['\"]?[a-zA-Z0-9_-]{20}",
)
FLAG_SQL = {
    "sql_injection": any_literal(security.SQL_INJECTION), "xss": any_literal(security.XSS), "path_traversal": any_literal(security.PATH_TRAVERSAL),
    "auth_failure": f"regexp_matches(content, {P_AUTH})", "pii": "(" + " or ".join(f"regexp_matches(content, {lit(p)})" for p in P_PII) + ")",
}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines as delivered, some of them twice."""
    return spread(read(spark, sf_dir, "log_entries"))


def once(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns asked for, each entry once. The key decides, since equal keys mean equal rows."""
    return (df.select("entry_id", *columns) if columns else df).dropDuplicates(["entry_id"])


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline.from_config(ALL_ON.modules).run(lines(spark, sf_dir))


def counted(df: DataFrame, *by: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def content() -> Column:
    return F.col("content")


@query(f"select entry_id, {LEVEL} as level from {E}")
def level_detect(spark, d):
    return once(pattern.with_level(lines(spark, d)), "level")


@query(f"select level, count(*) as n from (select {LEVEL} as level from {E}) where level is not null group by level")
def level_counts(spark, d):
    return counted(level_detect(spark, d).where("level is not null"), "level")


@query("select entry_id, cast(null as varchar) as level from " + E)
def level_disabled(spark, d):
    return once(pattern.with_level(lines(spark, d), enabled=False), "level")


@query(f"select entry_id, {CODE} as error_code from {E}")
def error_code_extract(spark, d):
    return once(pattern.with_error_code(lines(spark, d)), "error_code")


@query(f"select error_code, count(*) as n from (select {CODE} as error_code from {E}) where error_code is not null group by error_code order by n desc, error_code limit 20")
def error_code_top(spark, d):
    return counted(error_code_extract(spark, d).where("error_code is not null"), "error_code").orderBy(F.desc("n"), "error_code").limit(20)


@query(f"select entry_id, nullif(regexp_extract(content, 'request (\\d+) on (\\w+)', 1), '') as request_id, nullif(regexp_extract(content, 'request (\\d+) on (\\w+)', 2), '') as request_topic from {E}")
def custom_tag_named(spark, d):
    tags = pattern.tags_of(content(), [NamedPattern("request", r"request (?P<id>\d+) on (?P<topic>\w+)")])
    return once(lines(spark, d), F.try_element_at(tags, F.lit("request_id")).alias("request_id"), F.try_element_at(tags, F.lit("request_topic")).alias("request_topic"))


@query(f"select entry_id, nullif(regexp_extract(content, 'batch (\\d+)', 1), '') as batch, nullif(regexp_extract(content, 'shard \\d+', 0), '') as shard from {E}")
def custom_tag_unnamed(spark, d):
    tags = pattern.tags_of(content(), [NamedPattern("batch", r"batch (\d+)"), NamedPattern("shard", r"shard \d+"), NamedPattern("broken", r"(unclosed")])
    return once(lines(spark, d), F.try_element_at(tags, F.lit("batch")).alias("batch"), F.try_element_at(tags, F.lit("shard")).alias("shard"))


TRIM = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
P_PAIR = r"""(\w+)=(?:"([^"]*)"|'([^']*)'|(\S+))"""
P_ACCESS = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s*([^"]*)"\s+(\d+)\s+(\S+)'
P_SYSLOG = r"^(?:<(\d+)>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s*(.*)$"
JSON = f"(({TRIM} like '{{%}}' or {TRIM} like '[%]') and json_valid({TRIM}))"
PAIRS = f"len(regexp_extract_all({TRIM}, {lit(P_PAIR)}))"
IS_ACCESS, IS_SYSLOG = f"regexp_matches({TRIM}, {lit(P_ACCESS)})", f"regexp_matches({TRIM}, {lit(P_SYSLOG)})"
FORMAT = f"case when content is null then null when {JSON} then 'json' when {IS_ACCESS} then 'apache' when {IS_SYSLOG} then 'syslog' when {PAIRS} >= 2 then 'kv' else 'unknown' end"


@query(f"select entry_id, {FORMAT} as format from {E}")
def format_detect(spark, d):
    return once(lines(spark, d), parser.format_of(content()).alias("format"))


@query(f"select format, count(*) as n from (select {FORMAT} as format from {E}) where format is not null group by format")
def format_counts(spark, d):
    return counted(format_detect(spark, d).where("format is not null"), "format")


@query(f"select entry_id, json_extract_string({TRIM}, '$.app') as app, json_extract_string({TRIM}, '$.level') as level, cast(json_extract_string({TRIM}, '$.pid') as bigint) as pid from {E} where {JSON}")
def json_field_extract(spark, d):
    v = parser.json_of(content())
    return once(lines(spark, d).where(parser.is_json(content())), *[F.try_variant_get(v, f"$.{k}", t).alias(k) for k, t in (("app", "string"), ("level", "string"), ("pid", "bigint"))])


def _pairs_sql(columns: str = "entry_id") -> str:
    """A row a pair: k, v (without quotes) and pos."""
    group = lambda i: f"regexp_extract_all(content, {lit(P_PAIR)}, {i})"
    return f"select {columns}, k, coalesce(a, '') || coalesce(b, '') || coalesce(c, '') as v, pos from (select {columns}, unnest({group(1)}) as k, unnest({group(2)}) as a, unnest({group(3)}) as b, unnest({group(4)}) as c, generate_subscripts({group(1)}, 1) as pos from {E})"


@query(f"select entry_id, arg_max(v, pos) filter (k = 'app') as app, arg_max(v, pos) filter (k = 'level') as level, count(*) as n from ({_pairs_sql()}) group by entry_id")
def kv_extract(spark, d):
    """Of every line that holds a pair, wherever it stands: the last of equal keys, as written, without quotes, and the number of pairs."""
    value = lambda k: F.try_element_at(F.filter("pairs", lambda p: p["key"] == k), F.lit(-1))["value"].alias(k)
    paired = lines(spark, d).select("entry_id", parser.pairs_of(content()).alias("pairs")).where(F.size("pairs") > 0)
    return once(paired, value("app"), value("level"), F.size("pairs").cast("bigint").alias("n"))


NUMBER = r"(?i)^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$"
SPECIAL = "(?i)^[+-]?(?:nan|inf|infinity)$"
KIND = f"case when regexp_matches(v, '^[+-]?\\d+$') and try_cast(v as bigint) is not null then 'integer' when regexp_matches(v, '{NUMBER}') or regexp_matches(v, '{SPECIAL}') then 'float' when v in ('true', 'false') then 'boolean' else 'string' end"


@query(f"select {KIND} as kind, count(*) as n from ({_pairs_sql()}) group by 1")
def kv_typed(spark, d):
    kinds = F.transform(parser.pairs_of(content()), lambda p: parser.value_kind(p["value"]))
    return counted(once(lines(spark, d), kinds.alias("kinds")).select(F.explode("kinds").alias("kind")), "kind")


@query(f"select n, count(*) as lines from (select len(regexp_extract_all(content, {lit(P_PAIR)})) as n from {E}) where n is not null group by n")
def kv_pair_count(spark, d):
    return counted(once(lines(spark, d), parser.pair_count(content()).cast("bigint").alias("n")).where("n is not null"), "n", name="lines")


ACC = lambda i: f"regexp_extract({TRIM}, {lit(P_ACCESS)}, {i})"
#: DuckDB numbers groups up to nine, so the last two come from a pattern whose first groups don't count.
AGENT = r'^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"\S+\s+\S+\s*[^"]*"\s+\d+\s+\S+\s+"([^"]*)"\s+"([^"]*)"'
HAS_AGENT = f"regexp_matches({TRIM}, {lit(AGENT)})"
STATUS = f"case when try_cast({ACC(8)} as integer) between 0 and 65535 then try_cast({ACC(8)} as integer) end"
BYTES = f"try_cast({ACC(9)} as bigint)"


@query(
    f"""select entry_id, {ACC(1)} as client_ip, nullif({ACC(2)}, '-') as ident, nullif({ACC(3)}, '-') as "user", {ACC(4)} as "timestamp", {ACC(5)} as method, {ACC(6)} as path, nullif({ACC(7)}, '') as protocol,
    {STATUS} as status, {BYTES} as bytes, case when {HAS_AGENT} then nullif(regexp_extract({TRIM}, {lit(AGENT)}, 1), '-') end as referrer,
    case when {HAS_AGENT} then regexp_extract({TRIM}, {lit(AGENT)}, 2) end as user_agent from {E} where {IS_ACCESS}"""
)
def apache_parse(spark, d):
    fields = lines(spark, d).select("entry_id", parser.access_fields(content()).alias("f")).where("f is not null").select("entry_id", "f.*")
    return once(fields.drop("_format").withColumn("bytes", F.col("bytes").cast("bigint")))


@query(f"select {STATUS} as status, count(*) as n from {E} where {IS_ACCESS} group by 1")
def apache_status_counts(spark, d):
    return counted(apache_parse(spark, d), "status")


@query(f"select {ACC(5)} as method, cast(sum({BYTES}) as bigint) as bytes from {E} where {IS_ACCESS} group by 1")
def apache_bytes_sum(spark, d):
    return apache_parse(spark, d).groupBy("method").agg(F.sum("bytes").alias("bytes"))


SYS = lambda i: f"regexp_extract({TRIM}, {lit(P_SYSLOG)}, {i})"
PRI = f"case when try_cast({SYS(1)} as integer) between 0 and 255 then try_cast({SYS(1)} as integer) end"


@query(
    f"""select entry_id, {PRI} as priority, {PRI} // 8 as facility, {PRI} % 8 as severity, {SYS(2)} as "timestamp", {SYS(3)} as hostname, trim({SYS(4)}) as process, try_cast({SYS(5)} as bigint) as pid, {SYS(6)} as message
    from {E} where {IS_SYSLOG}"""
)
def syslog_parse(spark, d):
    return once(lines(spark, d).select("entry_id", parser.syslog_fields(content()).alias("f")).where("f is not null").select("entry_id", "f.*").drop("_format"))


@query(f"select {PRI} // 8 as facility, {PRI} % 8 as severity, count(*) as n from {E} where {IS_SYSLOG} group by 1, 2")
def syslog_facility_counts(spark, d):
    return counted(syslog_parse(spark, d), "facility", "severity")


_field = lambda kind, key, value: f"select entry_id, '{kind}' as format, '{key}' as key, {value} as v from f where format = '{kind}' and {value} is not null"


@query(
    f"""with f as (select *, {FORMAT} as format from {E}), p as ({_pairs_sql()}),
    j as (select entry_id, e.key as key, e.type as type, e.value as value from f, json_each({TRIM}) e where format = 'json')
    select entry_id, 'json' as format, key, case type when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then 'null' else json_extract_string(value, '$') end as v from j
    union all select entry_id, 'kv', k, case when arg_max({KIND}, pos) = 'integer' then arg_max(try_cast(v as bigint)::varchar, pos) when arg_max({KIND}, pos) = 'float' then 'float' else arg_max(v, pos) end
        from p where entry_id in (select entry_id from f where format = 'kv') group by entry_id, k
    union all """
    + " union all ".join(
        [_field("apache", k, v) for k, v in (("client_ip", ACC(1)), ("ident", f"nullif({ACC(2)}, '-')"), ("user", f"nullif({ACC(3)}, '-')"), ("timestamp", ACC(4)), ("method", ACC(5)), ("path", ACC(6)), ("protocol", f"nullif({ACC(7)}, '')"), ("status", f"({STATUS})::varchar"), ("bytes", f"{BYTES}::varchar"), ("referrer", f"case when {HAS_AGENT} then nullif(regexp_extract({TRIM}, {lit(AGENT)}, 1), '-') end"), ("user_agent", f"case when {HAS_AGENT} then regexp_extract({TRIM}, {lit(AGENT)}, 2) end"), ("_format", "'apache_combined'"))]
        + [_field("syslog", k, v) for k, v in (("priority", f"({PRI})::varchar"), ("facility", f"({PRI} // 8)::varchar"), ("severity", f"({PRI} % 8)::varchar"), ("timestamp", SYS(2)), ("hostname", SYS(3)), ("process", f"trim({SYS(4)})"), ("pid", f"try_cast({SYS(5)} as bigint)::varchar"), ("message", SYS(6)), ("_format", "'syslog'"))]
    )
)
def structured_fields(spark, d):
    """The whole structured object of every line, a row a field: values as text, arrays and objects and fractions by their kind."""
    df = once(enriched(spark, d), parser.format_of(content()).alias("format"), "structured").where("structured is not null")
    rows = df.select("entry_id", "format", "structured").lateralJoin(spark.tvf.variant_explode(F.col("structured").outer())).where("key is not null")
    kind = F.schema_of_variant("value")
    text = F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "null").when((F.col("format") == "kv") & ((kind == "DOUBLE") | kind.startswith("DECIMAL")), "float").otherwise(F.try_variant_get("value", "$", "string"))
    return rows.select("entry_id", "format", "key", text.alias("v"))


@query(f"select entry_id, case when {IS_ACCESS} then {ACC(5)} end as method, {IS_SYSLOG} as is_syslog from {E} where content is not null")
def explicit_format(spark, d):
    """A configured format is taken as given: the line is read as that or not at all."""
    access, syslog = parser.structured_of(content(), False, "nginx"), parser.structured_of(content(), False, "syslog")
    return once(lines(spark, d).where("content is not null"), F.try_variant_get(access, "$.method", "string").alias("method"), syslog.isNotNull().alias("is_syslog"))


@query(f"select entry_id, {LATENCY} as latency_ms from {E}")
def latency_extract(spark, d):
    return once(latency.with_latency(lines(spark, d)), "latency_ms")


@query(
    f"""select entry_id, {latency_sql((r'latency=(\d+)(ms)', r'took (\d+)(us)'))} as ms from (select entry_id, replace(content, 'latency=', 'took ') as content from {E})
    union all select entry_id, {latency_sql((r'took (\d+\.?\d*)(us|ms|s|min)?',))} from (select entry_id, replace(replace(content, 'latency=', 'took '), 'ms', 'min') as content from {E})"""
)
def latency_units(spark, d):
    base = lines(spark, d).select("entry_id", F.regexp_replace("content", "latency=", "took ").alias("content"))
    one = latency.with_latency(base, (r"latency=(?P<duration>\d+)(?P<unit>ms)", r"took (?P<duration>\d+)(?P<unit>us)"))
    two = latency.with_latency(base.withColumn("content", F.regexp_replace("content", "ms", "min")), (r"took (\d+\.?\d*)(us|ms|s|min)?",))
    return once(one, F.col("latency_ms").alias("ms")).unionByName(once(two, F.col("latency_ms").alias("ms")))


@query(f"select entry_id, {latency_sql((r'(\w+) latency=(ms)?', WAITED))} as ms from {E}")
def latency_first_pattern_wins(spark, d):
    """The first pattern matches words, so its lines have no latency although the second would find one."""
    return once(latency.with_latency(lines(spark, d), (r"(?P<duration>\w+) latency=(?P<unit>ms)?", latency.DEFAULT_PATTERNS[1])), F.col("latency_ms").alias("ms"))


def _timed(spark, d):
    """Entries with their source and latency, and nothing of their text."""
    return once(latency.with_latency(lines(spark, d)), "received_at", source_uri("source").alias("source"), "latency_ms")


@query(f"select uri as source, count(ms) as n, min(ms) as min_ms, max(ms) as max_ms, round(avg(ms), 6) as mean_ms from (select uri, {LATENCY} as ms from {E}) group by uri")
def latency_stats(spark, d):
    return _timed(spark, d).groupBy("source").agg(F.count("latency_ms").alias("n"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))


@query(f"select uri as source, quantile_disc(ms, 0.5) as p50, quantile_disc(ms, 0.9) as p90, quantile_disc(ms, 0.99) as p99 from (select uri, {LATENCY} as ms from {E}) where ms is not null group by uri")
def latency_percentiles(spark, d):
    return _timed(spark, d).where("latency_ms is not null").groupBy("source").agg(*[F.expr(f"percentile_disc({p / 100}) within group (order by latency_ms)").alias(f"p{p}") for p in (50, 90, 99)])


@query(f"select uri as source, count(v) as \"count\", min(v) as min_ms, max(v) as max_ms, quantile_disc(v, 0.5) as p50, quantile_disc(v, 0.99) as p99 from (select uri, {KEPT} as v from (select uri, {LATENCY} as ms from {E})) where v is not null group by uri")
def window_report(spark, d):
    """The record of a window a source, as the report prints it, read back."""
    s = windows.window_stats(_timed(spark, d).where("latency_ms is not null"), "latency_ms", (50, 99), ["source"])
    return s.select("source", "count", "min_ms", "max_ms", *[F.col("percentiles")[i]["value_ms"].alias(f"p{p}") for i, p in enumerate((50, 99))])


@query(
    "with l as (select " + LATENCY + f" as ms from {E}) "
    + " union all ".join(f"select '{b}' as le, count(*) filter (ms <= {b}) as n from l" for b in (1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000))
    + " union all select '+Inf', count(ms) from l"
)
def latency_histogram(spark, d):
    rows = metrics.latency_histogram(_timed(spark, d)).where("metric = 'latency_ms_bucket'")
    return rows.select(F.col("label_value").alias("le"), F.col("value").cast("bigint").alias("n"))


def _rolling(spark, d, name, *stats):
    return windows.rolling_stats(_timed(spark, d).where("latency_ms is not null"), "received_at", "latency_ms", [name], (90,), ["source"]).select("entry_id", *stats)


def _rolling_sql(us: int, stats: str) -> str:
    w = f"over (partition by uri order by us range between {us - 1} preceding and current row)"
    return f"select entry_id, {stats.replace('OVER', w)} from (select *, {KEPT} as v from (select *, {LATENCY} as ms from {E})) where ms is not null"


@query(_rolling_sql(60_000_000, 'count(v) OVER as "count"'))
def rolling_count_1m(spark, d):
    return _rolling(spark, d, "1m", "count")


@query(_rolling_sql(300_000_000, 'count(v) OVER as "count"'))
def rolling_count_5m(spark, d):
    return _rolling(spark, d, "5m", "count")


@query(_rolling_sql(900_000_000, 'count(v) OVER as "count"'))
def rolling_count_15m(spark, d):
    return _rolling(spark, d, "15m", "count")


@query(" union all ".join(f"select entry_id, '{n}' as \"window\", \"count\", max_ms from ({_rolling_sql(us, 'count(v) OVER as ' + chr(34) + 'count' + chr(34) + ', max(v) OVER as max_ms')})" for n, us in (("1m", 60_000_000), ("5m", 300_000_000), ("15m", 900_000_000))))
def rolling_all_windows(spark, d):
    """Every configured window of each reading, from one shuffle and sort."""
    m = ALL_ON.modules.performance_metrics
    return windows.rolling_stats(_timed(spark, d).where("latency_ms is not null"), "received_at", "latency_ms", m.windows, (), ["source"]).select("entry_id", "window", "count", "max_ms")


@query(_rolling_sql(900_000_000, "min(v) OVER as min_ms, max(v) OVER as max_ms"))
def rolling_minmax(spark, d):
    return _rolling(spark, d, "15m", "min_ms", "max_ms")


@query(_rolling_sql(900_000_000, "round(avg(v) OVER, 6) as mean_ms"))
def rolling_mean(spark, d):
    return _rolling(spark, d, "15m", F.round("mean_ms", 6).alias("mean_ms"))


@query(_rolling_sql(3_600_000_000, "quantile_disc(v, 0.9) OVER as p90_ms"))
def rolling_percentiles(spark, d):
    return _rolling(spark, d, "1h", "p90_ms")


@query(
    f"""with b as (select us // 1000000 as bucket, count(*) as n, min(v) as lo, max(v) as hi from (select us, {KEPT} as v from (select us, {LATENCY} as ms from {E})) where v is not null group by 1)
    select bucket, cast(sum(n) over w as bigint) as "count", min(lo) over w as min_ms, max(hi) over w as max_ms from b window w as (order by bucket range between 59 preceding and current row)"""
)
def rolling_global_buckets(spark, d):
    """The trailing minute over all sources, at the end of each second."""
    return windows.bucketed_rolling(_timed(spark, d), "received_at", "latency_ms", 60_000_000).select("bucket", "count", "min_ms", "max_ms")


def _flag(spark, d, column):
    return once(lines(spark, d).where("content is not null"), column.alias("hit"))


def _flag_sql(name):
    return f"select entry_id, {FLAG_SQL[name]} as hit from {E} where content is not null"


@query(_flag_sql("sql_injection"))
def sqli_detect(spark, d):
    return _flag(spark, d, content().rlike(security.SQL_INJECTION_RE))


@query(_flag_sql("xss"))
def xss_detect(spark, d):
    return _flag(spark, d, content().rlike(security.XSS_RE))


@query(_flag_sql("path_traversal"))
def path_detect(spark, d):
    return _flag(spark, d, content().rlike(security.PATH_RE))


@query(_flag_sql("auth_failure"))
def auth_detect(spark, d):
    return _flag(spark, d, content().rlike(security.AUTH_FAILURE))


@query(_flag_sql("pii"))
def pii_detect(spark, d):
    return _flag(spark, d, security.has_pii(content()))


@query(f"select doc_id, {FLAG_SQL['pii'].replace('content', 'text')} as hit from documents where text is not null")
def pii_detect_documents(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", security.has_pii(F.col("text")).alias("hit"))


CUSTOM = (NamedPattern("peer", r"peer \d+\.\d+\.\d+\.\d+"), NamedPattern("revision", r"rev [0-9a-f]{7}"))


@query(f"select entry_id, case when {FLAG_SQL['pii']} then 'pii' end as a, case when regexp_matches(content, {lit(CUSTOM[0].pattern)}) then 'peer' end as b, case when regexp_matches(content, {lit(CUSTOM[1].pattern)}) then 'revision' end as c from {E} where content is not null")
def sensitive_custom(spark, d):
    names = security.sensitive_names(content(), CUSTOM)
    has = lambda n: F.when(F.array_contains(names, n), n)
    return once(lines(spark, d).where("content is not null"), has("pii").alias("a"), has("peer").alias("b"), has("revision").alias("c"))


FLAG_LABELS = (("sql_injection", "SqlInjection"), ("xss", "Xss"), ("path_traversal", "PathTraversal"), ("auth_failure", "AuthFailure"), ("pii", 'SensitiveData { pattern_name: "pii" }'))


@query(" union all ".join(f"select '{label}' as flag, count(*) as n from {E} where content is not null and {FLAG_SQL[k]} having count(*) > 0" for k, label in FLAG_LABELS))
def flag_counts(spark, d):
    flags = once(security.with_security_flags(lines(spark, d)), F.transform("security_flags", security.debug_name).alias("flags"))
    return counted(flags.select(F.explode("flags").alias("flag")), "flag")


@query(f"select n, count(*) as lines from (select {' + '.join(f'cast({v} as bigint)' for v in FLAG_SQL.values())} as n from {E} where content is not null) group by n")
def flag_multi(spark, d):
    df = security.with_security_flags(lines(spark, d).where("content is not null"))
    return counted(once(df, F.size("security_flags").cast("bigint").alias("n")), "n", name="lines")


@query(f"select entry_id, uri from {E}")
def source_uris(spark, d):
    return once(lines(spark, d), source_uri("source").alias("uri"))


@query(f"select coalesce(kind, 'unknown') as source, count(*) as n from {E} group by 1")
def source_counts(spark, d):
    return counted(once(lines(spark, d), metrics.source_kind(F.coalesce(source_uri("source"), F.lit(""))).alias("source")), "source")


@query(f"select kind, count(*) as n from (select kind from {E} union all select source.kind from (select distinct line_id, source from file_lines) union all select 'stdin' from (values (1), (2))) group by kind")
def union_sources(spark, d):
    """Union all of three sources; each keeps its own rows."""
    tailed = read(spark, d, "file_lines").dropDuplicates(["line_id"])
    typed = sources.stdin_lines(spark, ["one\n", "\n", "two\n"])
    both = sources.union([once(lines(spark, d), "received_at", "source", "content", "metadata").drop("entry_id"), tailed.select("received_at", "source", "content", "metadata"), typed])
    return counted(both, F.col("source.kind").alias("kind"))


@query(r"select line_id, regexp_replace(content, '\s+$', '') as content from (select distinct line_id, content from file_lines) where regexp_matches(content, '\S')")
def blank_line_filter(spark, d):
    """What a file source keeps: trailing blanks dropped, blank lines skipped."""
    return sources.file_lines(read(spark, d, "file_lines").dropDuplicates(["line_id"]), "content").select("line_id", "content")


@query(r"select doc_id, pos, line from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as pos from (select doc_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\r?\n') as l from documents where text is not null)) where line <> ''")
def udp_packet_explode(spark, d):
    """Texts as packets: trimmed, cut at line ends, empty lines skipped."""
    return sources.packet_lines(read(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text").select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("content").alias("line"))


PRETTY_HEAD = "'[' || strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%g') || ']' || coalesce(' [' || uri || ']', '') || coalesce(' [' || level || ']', '')"
WITH_ALL = f"(select *, {LEVEL} as level, {CODE} as error_code, {LATENCY} as ms from {E})"
FLAG_TEXT = "concat_ws(',', " + ", ".join(f"case when {FLAG_SQL[k]} then '{label}' end" for k, label in FLAG_LABELS) + ")"


def _pretty_sql(code: bool) -> str:
    coded = "|| coalesce(' [code:' || error_code || ']', '')" if code else ""
    return f"select entry_id, {PRETTY_HEAD} {coded} || coalesce(' [' || format('{{:.2f}}', ms) || 'ms]', '') || coalesce(' [SECURITY:' || nullif({FLAG_TEXT}, '') || ']', '') || ' ' || content as line from {WITH_ALL} where content is not null"


@query(_pretty_sql(True))
def pretty_line(spark, d):
    return once(enriched(spark, d).where("content is not null"), formats.text_line().alias("line"))


@query(_pretty_sql(False))
def file_text_line(spark, d):
    return once(enriched(spark, d).where("content is not null"), formats.text_line(with_code=False).alias("line"))


@query(f"select content as line, count(*) as n from {E} where content is not null group by content")
def raw_line(spark, d):
    return counted(formats.render(once(enriched(spark, d)), "raw").where("value is not null"), F.col("value").alias("line"))


def _json_columns(j):
    """The fields of a JSON line that SQL can name."""
    of = lambda k: F.get_json_object(j, f"$.{k}")
    return [of("content").alias("content"), of("level").alias("level"), of("error_code").alias("error_code"), of("latency_ms").cast("double").alias("latency_ms"), F.coalesce(F.json_array_length(of("security_flags")), F.lit(0)).cast("bigint").alias("n_flags")]


N_FLAGS = " + ".join(f"cast({v} as bigint)" for v in FLAG_SQL.values())
RICH = f"({FORMAT} <> 'unknown' or {' or '.join(FLAG_SQL.values())} or {LATENCY} is not null)"


@query(f"select entry_id, content, {LEVEL} as level, {CODE} as error_code, {LATENCY} as latency_ms, {N_FLAGS} as n_flags from {E} where content is not null")
def json_line(spark, d):
    """The JSON line, read back field by field."""
    df = enriched(spark, d).where("content is not null")
    return once(df, formats.json_line(df).alias("j")).select("entry_id", *_json_columns(F.col("j")))


@query(f"select strftime(make_timestamp(us), '%Y-%m-%d') as date, count(*) as n from {E} where us is not null group by 1")
def date_partition(spark, d):
    return counted(files.with_rotation(once(lines(spark, d), "received_at"), "daily")[0].where("date is not null"), "date")


@query(f"select strftime(make_timestamp(us) + interval 9 hour, '%Y-%m-%d') as date, strftime(make_timestamp(us) + interval 9 hour, '%H') as hour, count(*) as n from {E} where us is not null group by 1, 2")
def hour_partition(spark, d):
    """By the wall clock of a zone, nine hours ahead of UTC all year."""
    return counted(files.with_rotation(once(lines(spark, d), "received_at"), "hourly", "Asia/Tokyo")[0].where("date is not null"), "date", "hour")


@query("select feed, file_id, path from (select *, row_number() over (partition by feed order by written_at desc, file_id desc) as r from (select distinct file_id, feed, path, written_at from output_files)) where r > 7")
def retention_topn(spark, d):
    """The files beyond the seven newest of each feed, which retention removes."""
    return files.beyond_newest(read(spark, d, "output_files"), FileOutput().max_files, "written_at", "file_id", ["feed"]).select("feed", "file_id", "path")


LABELS = Loki(labels={"env": "test"}, job="lines")
LABEL_KEY = "'env=test,job=lines' || coalesce(',level=' || level, '') || ',source=' || coalesce(uri, '')"


@query(f"select entry_id, {LABEL_KEY} as key from {WITH_ALL}")
def loki_label_key(spark, d):
    return once(pattern.with_level(lines(spark, d)), push.key_of(push.labels_of(LABELS)).alias("key"))


@query(f"select key, count(*) as n, min(us) * 1000 as first_ns, max(us) * 1000 as last_ns, true as in_order, true as small from (select *, {LABEL_KEY} as key from {WITH_ALL}) group by key")
def loki_stream_groups(spark, d):
    """What is pushed by labels: lines, first and last time, whether each batch holds its lines in order and is small enough."""
    v = push.streams(once(enriched(spark, d), "received_at", "source", "content", "metadata", "level", "error_code", "latency_ms", "security_flags", "structured", "tags"), LABELS, arrival="entry_id")
    ns = F.transform("values", lambda x: x["ts_ns"].cast("bigint"))
    each = v.select(push.key_of(F.col("stream")).alias("key"), F.size("values").alias("n"), F.array_min(ns).alias("lo"), F.array_max(ns).alias("hi"), (ns == F.array_sort(ns)).alias("ordered"))
    return each.groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("first_ns"), F.max("hi").alias("last_ns"), F.every("ordered").alias("in_order"), (F.max("n") <= LABELS.batch_size).alias("small"))


@query(f"select key, ns, count(*) as n, min(line) as line from (select {LABEL_KEY} as key, us * 1000 as ns, case when {RICH} then 'json ' || content else content end as line from {WITH_ALL} where content is not null) group by key, ns")
def loki_pushed_lines(spark, d):
    """Every pushed line under its labels and time; of JSON, the content it carries."""
    v = push.streams(once(enriched(spark, d).where("content is not null"), "received_at", "source", "content", "metadata", "level", "error_code", "latency_ms", "security_flags", "structured", "tags"), LABELS, arrival="entry_id")
    line = F.col("v.line")
    json = F.get_json_object(line, "$.received_at").isNotNull() & line.startswith('{"received_at"')
    rows = v.select(push.key_of(F.col("stream")).alias("key"), F.explode("values").alias("v")).select("key", F.col("v.ts_ns").cast("bigint").alias("ns"), F.when(json, F.concat(F.lit("json "), F.get_json_object(line, "$.content"))).otherwise(line).alias("line"))
    return rows.groupBy("key", "ns").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))


@query(f"select entry_id, {RICH} as rich, content, case when {RICH} then {LEVEL} end as level, case when {RICH} then {CODE} end as error_code, case when {RICH} then {LATENCY} end as latency_ms, case when {RICH} then {N_FLAGS} else 0 end as n_flags from {E} where content is not null")
def loki_line(spark, d):
    """The pushed line: JSON, read back, where there are fields, flags or a latency, else the content."""
    df = enriched(spark, d).where("content is not null")
    rows = once(df, "content", push.push_line(df).alias("line"))
    rich = F.col("line").startswith('{"received_at":') & (F.col("line") != F.col("content"))
    fields = _json_columns(F.when(rich, F.col("line")))
    return rows.select("entry_id", rich.alias("rich"), F.when(rich, fields[0]).otherwise(F.col("line")).alias("content"), *fields[1:])


@query(
    f"""with e as (select *, {LEVEL} as level, {LATENCY} as ms from {E})
    select 'logs_received_total' as metric, '' as label, '' as label_value, cast(count(*) as double) as value from e
    union all select 'logs_processed_total', '', '', cast(count(*) as double) from e
    union all select 'processing_errors_total', '', '', cast(0 as double)
    union all select 'latency_extracted_total', '', '', cast(count(ms) as double) from e
    union all select 'latency_ms_count', '', '', cast(count(ms) as double) from e
    union all select 'latency_ms_sum', '', '', round(coalesce(sum(ms), 0)) from e
    union all select 'logs_by_level_total', 'level', level, cast(count(*) as double) from e where level is not null group by level
    union all select 'logs_by_source_total', 'source', coalesce(kind, 'unknown'), cast(count(*) as double) from e group by coalesce(kind, 'unknown')
    union all select 'latency_ms_bucket', 'le', '+Inf', cast(count(ms) as double) from e """
    + " ".join(f"union all select 'latency_ms_bucket', 'le', '{b}', cast(count(*) filter (ms <= {b}) as double) from e" for b in (1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000))
    + f" union all select 'security_flags_total', 'flag', flag, cast(n as double) from ({SQL['flag_counts']})"
)
def metrics_long(spark, d):
    """Every sample of a batch, the sum rounded to whole milliseconds, since its last digits depend on the order of adding. No line of the tables has an error, so their counter is zero."""
    value = F.when(F.col("metric") == "latency_ms_sum", F.round("value")).otherwise(F.col("value"))
    return metrics.metrics(once(enriched(spark, d), "source", "level", "latency_ms", "security_flags")).select("metric", "label", "label_value", value.alias("value"))


@query(f"select 'processing_errors_total' as metric, cast(count(*) filter (content not like '%=%') as double) as value from {E} union all select 'logs_processed_total', cast(count(*) filter (content like '%=%') as double) from {E} union all select 'lines_out', cast(count(*) filter (content like '%=%') as double) from {E}")
def row_errors(spark, d):
    """A module of one's own that can't read every line: those lines are counted and left out, the others go on."""

    def first_key(line):
        return {"first_key": line["content"][: line["content"].index("=")]}

    df = Pipeline.from_config(ALL_ON.modules).add("first_key", row_module(first_key, ["content"], "first_key string")).run(lines(spark, d).where("content is not null"))
    kept = once(df, "source", "level", "latency_ms", "security_flags", "error")
    samples = metrics.metrics(kept).where(F.col("metric").isin("processing_errors_total", "logs_processed_total")).select("metric", "value")
    return samples.unionByName(without_errors(kept).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("lines_out").alias("metric"), "value"))


@query(f"select 'output_bytes_total' as metric, cast(sum(strlen(content) + 1) as double) as value from {E}")
def output_bytes(spark, d):
    return metrics.output_bytes(once(lines(spark, d), F.octet_length("content").alias("size")).select(F.col("size")), "size", "raw").select("metric", "value")


@query(f"select entry_id, content, uri from {E}")
def passthrough_lines(spark, d):
    out = Pipeline().add("passthrough", passthrough).run(lines(spark, d))
    return once(out, "content", source_uri("source").alias("uri"))


@query(f"select entry_id, {LEVEL} as level, {CODE} as error_code, {LATENCY} as latency_ms, {FORMAT} as format, {FLAG_TEXT} as flags from {E} where content is not null")
def pipeline_full(spark, d):
    """The flagship: every enrichment of every line, in one projection."""
    df = enriched(spark, d).where("content is not null")
    return once(df, "level", "error_code", "latency_ms", parser.format_of(content()).alias("format"), F.array_join(F.transform("security_flags", security.debug_name), ",").alias("flags"))


@query(f"select entry_id, strftime(make_timestamp(us), '%Y-%m-%d') as date, content from {E} where content is not null")
def file_sink_paths(spark, d):
    """The partition of each line below a sink's path, and the content of the JSON line that goes there, without writing it."""
    dated, by = files.with_rotation(enriched(spark, d).where("content is not null"), FileOutput().rotation)
    return once(dated, *by, F.get_json_object(files.file_line(dated, "jsonl"), "$.content").alias("content"))
