"""Counters and histograms over enriched lines, in long form: metric, label, label_value, value. And their text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import source_uri
from .security import debug_name

# Upper bounds of the latency buckets in milliseconds.
LATENCY_BUCKETS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000)

# Upper bounds of the buckets of processing times in seconds.
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

#: Families by name: type and help.
FAMILIES = {
    "logs_received_total": ("counter", "Lines received"),
    "logs_processed_total": ("counter", "Lines processed"),
    "logs_by_level_total": ("counter", "Lines by level"),
    "logs_by_source_total": ("counter", "Lines by kind of source"),
    "processing_duration_seconds": ("histogram", "Time to process a line, as its share of its batch"),
    "processing_errors_total": ("counter", "Errors of modules"),
    "security_flags_total": ("counter", "Security flags by flag"),
    "latency_extracted_total": ("counter", "Lines with a latency"),
    "latency_ms": ("histogram", "Extracted latencies"),
    "output_bytes_total": ("counter", "Bytes written by output"),
    "output_errors_total": ("counter", "Errors by output"),
    "buffer_size": ("gauge", "Lines in the buffer"),
    "push_buffer_size": ("gauge", "Lines waiting to be pushed"),
}


def source_kind(uri: Column) -> Column:
    """tcp, udp, file, stdin or unknown, from a source's URI."""
    return F.when(uri.startswith("tcp"), "tcp").when(uri.startswith("udp"), "udp").when(uri.startswith("file"), "file").when(uri == "stdin", "stdin").otherwise("unknown")


def _plain(df: DataFrame, metric: str, value: Column) -> DataFrame:
    return df.agg(value.cast("double").alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("label"), F.lit("").alias("label_value"), "value")


def latency_histogram(enriched: DataFrame, value: str = "latency_ms") -> DataFrame:
    """Cumulative counts by upper bound, the sum and the count, from one pass."""
    v = F.col(value)
    sums = enriched.agg(*[F.count_if(v <= b).cast("double").alias(f"b{i}") for i, b in enumerate(LATENCY_BUCKETS)], F.count(v).cast("double").alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"))
    rows = [F.struct(F.lit("latency_ms_bucket").alias("metric"), F.lit("le").alias("label"), F.lit(str(b)).alias("label_value"), F.col(f"b{i}").alias("value")) for i, b in enumerate(LATENCY_BUCKETS)]
    rows.append(F.struct(F.lit("latency_ms_bucket").alias("metric"), F.lit("le").alias("label"), F.lit("+Inf").alias("label_value"), F.col("n").alias("value")))
    rows += [F.struct(F.lit(f"latency_ms_{k}").alias("metric"), F.lit("").alias("label"), F.lit("").alias("label_value"), F.col(c).alias("value")) for k, c in (("sum", "s"), ("count", "n"))]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _sample(metric: str, label: str, value: Column | str, n: Column | float = 1.0) -> Column:
    return F.struct(F.lit(metric).alias("metric"), F.lit(label).alias("label"), (F.lit(value) if isinstance(value, str) else value).alias("label_value"), (n if isinstance(n, Column) else F.lit(float(n))).alias("value"))


def metrics(enriched: DataFrame) -> DataFrame:
    """Everything that a batch of enriched lines says, in long form, from one pass: each line gives a handful of samples, which
    are summed on the map side. A line with an `error` counts as received and as an error only. Counters without a line are zero."""
    ok = F.col("error").isNull() if "error" in enriched.columns else F.lit(True)
    ms = F.col("latency_ms")
    bucket = F.lit("+Inf")
    for b in reversed(LATENCY_BUCKETS):
        bucket = F.when(ms <= b, str(b)).otherwise(bucket)
    kind = source_kind(F.coalesce(source_uri("source"), F.lit("")))
    timed = ok & ms.isNotNull()
    plain = F.array(
        _sample("logs_received_total", "", ""),
        _sample("logs_processed_total", "", "", ok.cast("double")),
        _sample("processing_errors_total", "", "", (~ok).cast("double")),
        F.when(ok & F.col("level").isNotNull(), _sample("logs_by_level_total", "level", F.col("level"))),
        F.when(ok, _sample("logs_by_source_total", "source", kind)),
        F.when(timed, _sample("latency_extracted_total", "", "")),
        F.when(timed, _sample("latency_ms_bucket", "le", bucket)),
        F.when(timed, _sample("latency_ms_sum", "", "", ms)),
        F.when(timed, _sample("latency_ms_count", "", "")),
    )
    none_of = F.array().cast("array<struct<flag:string,pattern_name:string>>")
    flags = F.transform(F.when(ok, F.coalesce("security_flags", none_of)).otherwise(none_of), lambda f: _sample("security_flags_total", "flag", debug_name(f)))
    samples = enriched.select(F.explode(F.concat(F.array_compact(plain), flags)).alias("x")).select("x.*")
    zero = [(m, "", "", 0.0) for m in ("logs_received_total", "logs_processed_total", "processing_errors_total", "latency_extracted_total", "latency_ms_sum", "latency_ms_count")]
    zero += [("latency_ms_bucket", "le", str(b), 0.0) for b in (*LATENCY_BUCKETS, "+Inf")]
    none = enriched.sparkSession.createDataFrame(zero, "metric string, label string, label_value string, value double")
    summed = samples.unionByName(none).groupBy("metric", "label", "label_value").agg(F.sum("value").alias("value"))
    rest = summed.where("metric <> 'latency_ms_bucket'")
    order = F.when(F.col("label_value") == "+Inf", float("inf")).otherwise(F.col("label_value").try_cast("double"))
    upto = F.sum("value").over(Window.partitionBy("metric").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))  # eleven rows
    return rest.unionByName(summed.where("metric = 'latency_ms_bucket'").withColumn("value", upto))


def output_bytes(lines: DataFrame, line: str, output: str) -> DataFrame:
    """Bytes of the lines with their line ends; `line` may also be a column of sizes."""
    size = F.octet_length(line) if dict(lines.dtypes)[line] == "string" else F.col(line)
    return _plain(lines, "output_bytes_total", F.coalesce(F.sum(size + 1), F.lit(0))).withColumns({"label": F.lit("output"), "label_value": F.lit(output)})


def exposition(samples: DataFrame, prefix: str = "logloom") -> DataFrame:
    """One text line a sample; `render` adds the heads of the families."""
    label = F.when(F.col("label") != "", F.concat(F.lit("{"), F.col("label"), F.lit('="'), F.regexp_replace(F.regexp_replace("label_value", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"}'))).otherwise("")
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    return samples.select("metric", F.concat(F.lit(f"{prefix}_"), "metric", label, F.lit(" "), value).alias("line"))


def render(samples: DataFrame, prefix: str = "logloom") -> str:
    """The text of all samples, which are a few hundred rows whatever the number of lines."""
    rows = [(r["metric"], r["line"]) for r in exposition(samples, prefix).collect()]
    out = []
    for name, (kind, text) in FAMILIES.items():
        mine = [line for m, line in rows if m == name or kind == "histogram" and m in (f"{name}_bucket", f"{name}_sum", f"{name}_count")]
        if mine:
            out += [f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} {kind}", *mine]
    return "\n".join(out) + "\n"
