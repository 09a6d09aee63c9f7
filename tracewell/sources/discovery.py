"""Service discovery: container descriptions, the mapping of namespaces, and its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.spans import service_id_of
from tracewell.schema import INSPECT_DDL, MAPPING_DDL
from tracewell.sources import versions


def inspected(raw: DataFrame, column: str = "inspect", labels: str = "observe") -> DataFrame:
    """Mapping columns from container descriptions (a JSON array whose first element counts).

    Containers that don't run, have no process, no labels or a blank service label are left
    out. labels: prefix of the label names.
    """
    x = F.element_at(F.from_json(column, INSPECT_DDL), 1)
    label = lambda name: F.try_element_at(x["Config"]["Labels"], F.lit(f"{labels}.{name}"))
    named = raw.withColumns({"_x": x, "_service": label("service"), "_project": label("project"), "_env": label("environment")})
    good = F.col("_x.State.Running") & (F.col("_x.State.Pid") > 0) & (F.coalesce(F.col("_service"), F.lit("")) != "")
    return named.where(good).select(
        *raw.columns,
        F.left(F.col("_x.Id"), F.lit(12)).alias("container_id"),
        F.ltrim(F.col("_x.Name"), F.lit("/")).alias("container_name"),
        F.col("_x.State.Pid").alias("pid"),
        F.coalesce("_project", F.lit("default")).alias("project_id"),
        service_id_of(F.col("_service")).alias("service_id"),
        F.col("_service").alias("service_name"),
        F.coalesce("_env", F.lit("development")).alias("environment_id"),
    )


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that write_mapping made at path, or else files there: JSON objects of namespace to service, one a file or one a line; a broken one is an error."""
    made = versions.version(spark, path)
    whole = spark.read.text(versions.paths(path, made) if made.number else path, wholetext=True)
    text = whole.select(F.explode(F.split("value", r"(?<=\})\n(?=\{)")).alias("value")).where(F.trim("value") != "")
    kind = "map<string,struct<project_id:string,service_id:string,service_name:string,environment_id:string,container_id:string>>"
    rows = text.select(F.explode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("netns", "x"))
    return rows.select(F.col("netns").cast("bigint").alias("netns"), "x.*")


def write_mapping(mapping: DataFrame, path: str, former: versions.Version | None = None) -> versions.Version:
    """The mapping as JSON objects of namespace to service, one a line, as the next version at path.

    A reader sees the former version or this one, whole. former: the version that mapping was made
    from; versions.Conflict if another writer has replaced it since.
    """
    fields = ["project_id", "service_id", "service_name", "environment_id", "container_id"]
    line = F.to_json(F.create_map(F.col("netns").cast("string"), F.struct(*fields)))
    return versions.replace(mapping.select(line.alias("value")), path, former, lambda rows, to: rows.write.text(to))


def upsert(changes: DataFrame, order: str = "seq") -> DataFrame:
    """The last change of each namespace."""
    columns = [c for c in changes.columns if c not in ("netns", order)]
    latest = changes.groupBy("netns").agg(F.max_by(F.struct(*columns), order).alias("x"))
    return latest.select("netns", "x.*")


def remove(mapping: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The mapping without the namespaces or containers of gone."""
    return mapping.join(gone.select(key).distinct(), key, "left_anti")


def enriched(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """events with their service by namespace; unknown ones are told apart by namespace."""
    known = F.broadcast(mapping.select("netns", "project_id", "service_id", "environment_id", "container_id")) if _small(mapping) else mapping.select("netns", "project_id", "service_id", "environment_id", "container_id")
    out = events.join(known, "netns", "left")
    blank = {c: F.coalesce(c, F.lit("unknown")) for c in ("project_id", "service_id", "environment_id")}
    return out.withColumns(blank | {"container_id": F.coalesce("container_id", F.concat(F.lit("netns-"), F.col("netns").cast("string")))})


def _small(df: DataFrame, most_bytes: int = 64_000_000) -> bool:
    """Whether the planner's size estimate allows a broadcast."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= most_bytes


__all__ = ["MAPPING_DDL", "enriched", "inspected", "read_mapping", "remove", "upsert", "write_mapping"]
