"""Alert rules as a table: validation, changes and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ["threshold", "anomaly", "rate_of_change"]
SEVERITIES = ["info", "warning", "critical"]


class RuleError(ValueError):
    """A rule that can't be stored."""


def violations(rules: DataFrame, create: bool = True) -> DataFrame:
    """rules with problem: what is wrong with each, or null. Lengths are bytes; updates skip the ids' lengths."""
    checks: list[tuple[Column, str]] = [(~F.octet_length("name").between(1, 256), "name must be 1 to 256 bytes")]
    if create:
        checks += [(F.octet_length("project_id") > 128, "project_id is over 128 bytes"), (F.octet_length("service_id") > 128, "service_id is over 128 bytes")]
    checks += [(~F.col("rule_type").isin(TYPES), "unknown rule_type"), (~F.col("severity").isin(SEVERITIES), "unknown severity")]
    problem = F.lit(None).cast("string")
    for bad, text in reversed(checks):
        problem = F.when(bad, text).otherwise(problem)
    return rules.withColumn("problem", problem)


def validate(rule: dict, create: bool = True) -> None:
    """The same checks for one rule."""
    if not 1 <= len(rule["name"].encode()) <= 256:
        raise RuleError("name must be 1 to 256 bytes")
    if create and any(len(rule[k].encode()) > 128 for k in ("project_id", "service_id")):
        raise RuleError("an id is over 128 bytes")
    if rule["rule_type"] not in TYPES or rule["severity"] not in SEVERITIES:
        raise RuleError("unknown rule_type or severity")


def decode_config(rules: DataFrame, column: str = "config") -> DataFrame:
    """Rule columns from a JSON config with a type tag."""
    v = F.parse_json(column)
    field = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind).alias(name)
    numbers = ["window_secs", "min_requests", "baseline_window_secs", "evaluation_window_secs"]
    return rules.select(*[c for c in rules.columns if c != column], F.try_variant_get(v, "$.type", "string").alias("rule_type"), field("metric", "string"), field("operator", "string"), field("value", "double"), *[field(n, "bigint") for n in numbers], field("z_score_threshold", "double"), field("change_threshold_pct", "double"))


DEFAULT_COOLDOWN = 300


def number_of(id_column: str) -> Column:
    """N of an id like rule_N or evt_N, for order and for the next id; null for other ids."""
    return F.regexp_extract(id_column, "^[a-z]+_([0-9]{1,18})$", 1).try_cast("bigint")


def create(rules: DataFrame, fresh: DataFrame) -> DataFrame:
    """rules with new ones, which must be free of violations: on, numbered after the highest rule_N by project and name, with the default cooldown where none is given.

    fresh needs no id, enabled or cooldown_secs. Rules are few, so one task numbers the new ones.
    """
    last = rules.agg(F.coalesce(F.max(number_of("id")), F.lit(0)).alias("_last"))
    place = F.row_number().over(Window.orderBy("project_id", "name"))
    cooldown = F.coalesce(F.col("cooldown_secs"), F.lit(DEFAULT_COOLDOWN)) if "cooldown_secs" in fresh.columns else F.lit(DEFAULT_COOLDOWN)
    rows = fresh.withColumn("_place", place).join(last, F.lit(True)).withColumns({"id": F.concat(F.lit("rule_"), (F.col("_last") + F.col("_place")).cast("string")), "enabled": F.lit(True), "cooldown_secs": cooldown.cast("bigint")})
    return rules.unionByName(rows.drop("_last", "_place"))


def get(rules: DataFrame, rule_id: str) -> DataFrame:
    """The rule of an id; no row: there is none."""
    return rules.where(F.col("id") == rule_id)


def update(rules: DataFrame, changed: DataFrame) -> DataFrame:
    """changed replaces rules of the same id; updated rules are on again."""
    return rules.join(changed.select("id"), "id", "left_anti").unionByName(changed.withColumn("enabled", F.lit(True)))


def delete(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids, "id", "left_anti")


def cascade(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events of rules that still exist."""
    return events.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_semi")


def of_project(rules: DataFrame, project: str) -> DataFrame:
    return rules.where(F.col("project_id") == project)


def duplicates(rules: DataFrame) -> DataFrame:
    """(project_id, name) that stand more than once."""
    return rules.groupBy("project_id", "name").count().where("count > 1")
