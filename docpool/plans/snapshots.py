"""Queries over the snapshots that sync jobs deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpool.operators.snapshots import clean_hash, clean_path, snapshot_changes
from docpool.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, path, change): what each done job added, removed or changed since the done job before it."""
    jobs = table(spark, folder, "sync_jobs").where(F.col("status") == "done")
    sent = table(spark, folder, "upsert_documents").select("job_id", clean_path("path").alias("path"), clean_hash("hash").alias("hash"), "received_at")
    changes = snapshot_changes(jobs, sent, group=["key", "series"], snapshot="job_id", order="started_at", key="path", fields=["hash"], version="received_at")
    return changes.select(F.col("snapshot").alias("job_id"), F.col("key").alias("path"), "change")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, change, paths): how many paths each done job added, removed or changed."""
    return p4_found(spark, folder).groupBy("job_id", "change").agg(F.count(F.lit(1)).alias("paths"))


_CHANGES = """
with jobs as (select distinct job_id, key, series, started_at from sync_jobs where status = 'done'),
pairs as (select lag(job_id) over (partition by key, series order by started_at, job_id) as before, job_id from jobs),
sent as (select job_id, regexp_replace(path, '^\\s+|\\s+$', '', 'g') as p, received_at,
                nullif(regexp_replace(lower(trim(hash)), '^sha256:', ''), '') as h from upsert_documents where path is not null),
named as (select job_id, case when starts_with(p, '/') then '/' else '' end ||
                 array_to_string(list_filter(string_split(p, '/'), lambda s: s not in ('', '.')), '/') as path, received_at, h from sent),
held as (select job_id, path, h from (select *, row_number() over (partition by job_id, path order by received_at desc nulls last, h desc nulls last) as n
         from named where path <> '') where n = 1),
a as (select p.job_id, h.path, h.h from pairs p join held h on h.job_id = p.before),
b as (select p.job_id, h.path, h.h from pairs p join held h on h.job_id = p.job_id where p.before is not null),
diff as (select coalesce(a.job_id, b.job_id) as job_id, coalesce(a.path, b.path) as path,
         case when a.job_id is null then 'added' when b.job_id is null then 'removed' when a.h <> b.h then 'changed' end as change
         from a full join b on a.job_id = b.job_id and a.path = b.path)
"""

QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
ORACLE = {
    "p4_found": _CHANGES + "select job_id, path, change from diff where change is not null",
    "p4_counts": _CHANGES + "select job_id, change, count(*) as paths from diff where change is not null group by 1, 2",
}
