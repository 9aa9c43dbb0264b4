"""Queries of the core's data-preparation operators over the driver's tables, whole tables always."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, spikes, templates, timestamps
from ..session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.export_stamps(read(spark, sf_dir, "entry_exports"), read(spark, sf_dir, "log_sources"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.records(read(spark, sf_dir, "file_lines"))


def p3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mined templates: the common subsequence of their lines, their common beginning and the number of lines."""
    return templates.mine(read(spark, sf_dir, "file_lines")).select(F.array_join("body", "").alias("body"), F.array_join("begin", "").alias("begin"), "n")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(read(spark, sf_dir, "output_records"), read(spark, sf_dir, "output_files"))


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one table, with the names their fields had first and one type a column; the columns as JSON."""
    return drift.unified(read(spark, sf_dir, "output_records"), read(spark, sf_dir, "output_files")).withColumn("columns", F.to_json("columns"))


def p4_values_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By file: the records, and the values they have after unification, which must be all that they had before."""
    kept = p4_unified(spark, sf_dir).select("file_id", F.coalesce(F.json_array_length(F.to_json(F.json_object_keys("columns"))), F.lit(0)).alias("n"))
    return kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").cast("bigint").alias("n_values"))


def p4_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes are told from: the fields of each file and the number of their values by type."""
    leaves = drift.fields(read(spark, sf_dir, "output_records").dropDuplicates(["record_id"]))
    return leaves.groupBy("file_id", "root", "name", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_distinct"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.faults(read(spark, sf_dir, "enriched_entries"))


def p6_impossible_and_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults that don't depend on what a source normally shows."""
    return p6_found(spark, sf_dir).where("fault <> 'spike'")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_templates, p4_found, p4_unified, p4_values_kept, p4_profiles, p6_found, p6_impossible_and_stuck)}


#: Leaves of the JSON objects and of the metadata, each record once.
LEAVES = """with r as (select distinct record_id, file_id, structured, metadata from output_records),
    t as (select record_id, file_id, 'structured' as root, replace(replace(e.fullkey, '$.', ''), '"', '') as name,
                 case e.type when 'BOOLEAN' then 'boolean' when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'HUGEINT' then 'integer' when 'DOUBLE' then 'fraction' when 'VARCHAR' then 'text' when 'ARRAY' then 'array' end as type,
                 json_extract_string(e.value, '$') as value
          from (select * from r where json_valid(structured) and structured like '{%'), json_tree(structured) e where e.type not in ('OBJECT', 'NULL') and not contains(e.fullkey, '[')),
    l as (select * from t union all select record_id, file_id, 'metadata', unnest(map_keys(metadata)), 'text', unnest(map_values(metadata)) from r)"""


def oracle_sql() -> dict[str, str]:
    uri = "coalesce(case source.kind when 'stdin' then 'stdin' when 'file' then 'file://' || source.path else source.kind || '://' || source.addr end, '')"
    return {
        "p6_impossible_and_stuck": f"""with r as (select distinct entry_id, epoch_us(received_at) as us, {uri} as uri, latency_ms as v from enriched_entries where latency_ms is not null),
            o as (select *, case when v = lag(v) over w then 0 else 1 end as new from r window w as (partition by uri order by us, entry_id)),
            g as (select *, sum(new) over (partition by uri order by us, entry_id) as run from o), n as (select *, count(*) over (partition by uri, run) as size from g)
            select entry_id, case when isnan(v) or v < 0 or v > 3600000 then 'impossible' else 'stuck' end as fault from n where isnan(v) or v < 0 or v > 3600000 or size >= 6""",
        "p4_values_kept": f"{LEAVES} select file_id, count(*) as n_records, cast(sum(coalesce(n, 0)) as bigint) as n_values from r left join (select record_id, count(*) as n from l where value is not null group by record_id) using (record_id) group by file_id",
        "p4_profiles": f"{LEAVES} select file_id, root, name, type, count(*) as n, count(distinct value) as n_distinct from l where value is not null group by all",
    }
