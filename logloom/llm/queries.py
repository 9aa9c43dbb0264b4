"""The queries of this subpackage over the driver's tables; every one runs over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read, spread
from . import packing, percentiles, pii, quality, runs, tokenize


#: The key of pseudonyms over the driver's synthetic tables. Real data need a secret one.
TABLES_KEY = "synthetic tables only"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.repeated(read(spark, sf_dir, "log_entries"))


def p2_near_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed events: neighbours of which four words in five agree, no further apart than ten minutes."""
    return runs.runs(read(spark, sf_dir, "log_entries"), least=0.8, gap_us=600_000_000)


def p2_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: the events in all near runs, which must be all entries."""
    ran = runs.runs(read(spark, sf_dir, "log_entries"), least=0.8, gap_us=600_000_000)
    return ran.groupBy("entity").agg(F.sum("n_events").alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_rows(spread(read(spark, sf_dir, "log_entries").select("entry_id", "content")), TABLES_KEY).select("entry_id", "pii_type", "pii_text")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry once, with placeholders for what identifies a person."""
    return pii.redact(read(spark, sf_dir, "log_entries").select("entry_id", "content").dropDuplicates(["entry_id"]), TABLES_KEY)


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.by_source_and_day(read(spark, sf_dir, "enriched_entries")).withColumn("day", F.col("day").cast("string"))


def p7_daily_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combinable form: counts by source, day and first twenty bits of the reading."""
    return percentiles.digit_histogram(percentiles.latency_readings(read(spark, sf_dir, "enriched_entries")), ["source", "day"], "latency_ms")


def p7_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by source with both bounds, from the sum of the daily histograms."""
    return percentiles.bounds_from(percentiles.combine(p7_daily_histograms(spark, sf_dir), ["source"]), ["source"])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p9_assign(spark, sf_dir))


def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all is packed: documents, containers over their capacity, documents in pieces that needn't be, pieces that are missing."""
    packed = p9_assign(spark, sf_dir)
    bins = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("n_overfull"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("n"), F.max("piece").alias("last"))
    torn = F.greatest(F.ceil(F.col("n") / packing.CAPACITY), F.lit(1)) != F.col("k")
    sums = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(torn).alias("n_torn"), F.count_if(F.col("last") + 1 != F.col("k")).alias("n_incomplete"))
    return sums.withColumn("one", F.lit(1)).join(bins.withColumn("one", F.lit(1)), "one").drop("one")  # a row each


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, their robust z-scores within the language, and its kind."""
    return quality.measured(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def p10_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and their mean length, of every document with a text; the text without timings, numbers of cues and markup."""
    stats = quality.statistics(read(spark, sf_dir, "documents").where("text is not null"))
    return stats.select("doc_id", "word_count", F.round("mean_word_length", 6).alias("mean_word_length")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_near_runs, p2_covered, p5_found, p5_redacted, p7_percentiles, p7_daily_histograms, p7_combined, p8_ids, p9_assign, p9_fill, p9_whole, p10_found, p10_statistics, p10_word_counts)}


def oracle_sql() -> dict[str, str]:
    return {"p9_whole": "select count(distinct doc_id) as n_docs, 0::bigint as n_torn, 0::bigint as n_incomplete, 0::bigint as n_overfull from documents", "p10_word_counts": P10_SQL, "p2_covered": f"select {URI} as entity, count(distinct entry_id) as n from log_entries group by 1", "p7_percentiles": P7_SQL}


URI = "case source.kind when 'stdin' then 'stdin' when 'file' then 'file://' || source.path else source.kind || '://' || source.addr end"


#: Distinct readings, ranked by DuckDB's own discrete quantile.
P7_SQL = """
with r as (select distinct entry_id, case source.kind when 'stdin' then 'stdin' when 'file' then 'file://' || source.path else source.kind || '://' || source.addr end as source,
                  cast(cast(received_at at time zone 'UTC' as date) as varchar) as day, latency_ms
           from enriched_entries where latency_ms is not null and isfinite(latency_ms)),
     g as (select source, day, count(*) as n, quantile_disc(latency_ms, [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]) as q
           from r group by grouping sets ((source, day), (source)))
select source, day, n, unnest([10, 50, 250, 500, 750, 900, 950, 990, 999]) as permille, unnest(q) as value from g
"""


#: The body of a text by patterns of its own, and its words.
P10_SQL = r"""
with d as (select distinct doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as t from documents where text is not null),
     c as (select doc_id, case when regexp_matches(t, '^\x{feff}?\s*\{\d+\}\{\d+\}') then replace(regexp_replace(t, '(?m)^\x{feff}?\{\d+\}\{\d+\}', '', 'g'), '|', chr(10)) else t end as t from d),
     b as (select doc_id, regexp_replace(t, '(?m)^[\x{feff} \t]*(?:WEBVTT.*|NOTE\b.*|\d+|.*-->.*|-?[ \t]*[\[(][^\n\])]*[\])]|[♪♫🎵#][^.!?…。！？\n]*[♪♫🎵#])[ \t]*$|</?[a-zA-Z][^>\n]*>|\{\\[^}\n]*\}', '', 'g') as t from c),
     n as (select doc_id, len(regexp_extract_all(t, '[\p{L}\p{N}][\p{L}\p{N}\p{M}''’]*')) as w, length(regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g')) as k from b)
select doc_id, cast(w as bigint) as word_count, case when w > 0 then round(k / w, 6) end as mean_word_length from n
"""
