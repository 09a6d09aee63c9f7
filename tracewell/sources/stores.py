"""Stores that last for rules and alert events, as versioned tables (versions.py).

Rules are few: every change is a new version made of the newest, and of two that meet the later one is made
anew. Events are many: they are added as folders, so that writers don't hinder each other;
deleting rules and their events are two versions of two tables, rules first, so that no event of a
missing rule is shown (events() leaves those out in between).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import alerting, rules as rule_ops
from tracewell.schema import ALERT_DDL, RULE_DDL
from tracewell.sources import versions


class AlertStore:
    """Rules and events in two tables below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.rules_path, self.events_path = f"{path.rstrip('/')}/rules", f"{path.rstrip('/')}/events"

    def rules(self, number: int | None = None) -> DataFrame:
        return versions.read(self.spark, self.rules_path, RULE_DDL, number)

    def events(self) -> DataFrame:
        """Events of rules that exist."""
        return rule_ops.cascade(versions.read(self.spark, self.events_path, ALERT_DDL), self.rules())

    def _change(self, change) -> versions.Version:
        columns = [x.split()[0] for x in RULE_DDL.split(", ")]
        return versions.changed(self.spark, self.rules_path, RULE_DDL, lambda rows: change(rows).select(columns).coalesce(1))

    def create(self, fresh: DataFrame) -> versions.Version:
        """Store new rules under the next numbers; those with a violation are an error, and none is stored then."""
        problem = rule_ops.violations(fresh).where("problem IS NOT NULL").select("name", "problem").first()
        if problem is not None:
            raise rule_ops.RuleError(f"rule {problem['name']}: {problem['problem']}")
        return self._change(lambda rows: rule_ops.create(rows, _filled(fresh)))

    def update(self, changed: DataFrame) -> versions.Version:
        return self._change(lambda rows: rule_ops.update(rows, _filled(changed.join(rows.select("id"), "id", "left_semi"))))

    def delete(self, ids: DataFrame) -> versions.Version:
        """Delete rules, then their events."""
        made = self._change(lambda rows: rule_ops.delete(rows, ids.select("id")))
        versions.changed(self.spark, self.events_path, ALERT_DDL, lambda rows: rule_ops.cascade(rows, self.rules()).select(rows.columns))
        return made

    def add_events(self, events: DataFrame) -> versions.Version:
        columns = [x.split()[0] for x in ALERT_DDL.split(", ")]
        return versions.added(events.select(columns), self.events_path)

    def list_events(self, project: str, status: str | None = None, severity: str | None = None, limit: int = 50) -> DataFrame:
        return alerting.list_events(self.events(), project, status, severity, limit)


def _filled(rules: DataFrame) -> DataFrame:
    """rules with every column of the table, null where not given."""
    missing = [x.split() for x in RULE_DDL.split(", ") if x.split()[0] not in rules.columns]
    return rules.withColumns({name: F.lit(None).cast(kind) for name, kind in missing}) if missing else rules
