"""File registry, located paths and the audit log as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.operators.annotations import counts_per_file

REGISTRY_SCHEMA = (
    "file_key string, file_path string, file_hash string, options struct<jpath:string,"
    "no_header_row:boolean,ingest_tz:string,plugin_id:string,is_directory:boolean,"
    "file_pattern:string,include_source:boolean>, description string")
LOCATION_SCHEMA = ("instance_id string, file_hash string, workspace_id string, file_path string, "
                   "created_at timestamp, updated_at timestamp")
AUDIT_SCHEMA = ("audit_id string, workspace_id string, email string, description string, "
                "created_at timestamp, ttl bigint")
# Fixed value.
AUDIT_DAYS = 90


def register(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Upsert file records by key."""
    return registry.join(files.select("file_key"), "file_key", "left_anti").unionByName(files)


def remove(registry: DataFrame, annotations: DataFrame,
           keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop file records and their annotations; ``keys`` has a ``file_key`` column."""
    gone = keys.select("file_key")
    return (registry.join(gone, "file_key", "left_anti"),
            annotations.join(gone, "file_key", "left_anti"))


def describe(registry: DataFrame, file_key: str, description: str) -> DataFrame:
    return registry.withColumn("description", F.when(
        F.col("file_key") == file_key, F.lit(description)).otherwise(F.col("description")))


def list_files(registry: DataFrame, annotations: DataFrame) -> DataFrame:
    """Files with their annotation count: located ones first, then path, hash, key."""
    counted = registry.join(counts_per_file(annotations), "file_key", "left")
    path = F.coalesce("file_path", F.lit(""))
    return (counted.withColumn("annotations", F.coalesce("annotations", F.lit(0)))
            .orderBy((path == "").asc(), path.asc(), F.col("file_hash"), F.col("file_key")))


def resolve_paths(registry: DataFrame, locations: DataFrame, instance_id: str,
                  workspace_id: str | None = None) -> DataFrame:
    """The registry with the path each file has on this instance."""
    here = locations.filter(F.col("instance_id") == instance_id)
    if workspace_id is not None:
        here = here.filter(F.col("workspace_id") == workspace_id)
    newest = here.groupBy("file_hash").agg(F.max_by("file_path", "updated_at").alias("_path"))
    return (registry.join(newest, "file_hash", "left")
            .withColumn("file_path", F.coalesce("_path", "file_path")).drop("_path")
            .select(*registry.columns))


def locate(registry: DataFrame, scanned: DataFrame) -> DataFrame:
    """Registry rows whose content was found again; ``scanned`` has file_hash, path.
    Several copies of a file give the smallest path."""
    found = scanned.groupBy("file_hash").agg(F.min("path").alias("located_path"))
    return registry.join(found, "file_hash")


def locate_directories(registry: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows of registered directories that were found again: same hash under the same
    pattern; ``scanned`` has path, file_pattern, file_hash. Of several the smallest path."""
    found = scanned.groupBy("file_hash", "file_pattern").agg(F.min("path").alias("located_path"))
    wanted = registry.filter("options.is_directory").withColumn("file_pattern", F.col("options.file_pattern"))
    return wanted.join(found, ["file_hash", "file_pattern"]).select(*registry.columns, "located_path")


def reconcile_files(store: DataFrame, local: DataFrame) -> DataFrame:
    """File records of the shared store, with the paths this side already knows."""
    known = local.select("file_key", F.col("file_path").alias("_path"))
    return (store.drop("file_path").join(known, "file_key", "left")
            .withColumn("file_path", F.coalesce("_path", F.lit(""))).drop("_path"))


def audit_entries(events: DataFrame, at: Column | None = None) -> DataFrame:
    """New audit records from ``audit_id, workspace_id, email, description`` rows."""
    now = F.current_timestamp() if at is None else at
    return events.select(
        "audit_id", "workspace_id", "email", "description", now.alias("created_at"),
        F.unix_seconds(now + F.make_dt_interval(F.lit(AUDIT_DAYS))).alias("ttl"))


def latest_audit(audit: DataFrame, workspace_id: str, n: int = 0,
                 now: Column | None = None) -> DataFrame:
    """Records of a workspace that have not expired, newest first."""
    moment = F.unix_seconds(F.current_timestamp() if now is None else now)
    rows = (audit.filter((F.col("workspace_id") == workspace_id) & (F.col("ttl") > moment))
            .orderBy(F.col("created_at").desc(), F.col("audit_id")))
    return rows.limit(n) if n > 0 else rows
