"""Status tables: backlog, freshness, warnings, audit history, saved metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def backlog(statuses: DataFrame) -> DataFrame:
    """Fail and warn tables, fail first, then most issues first. statuses: table_name, status, issues."""
    rows = statuses.where("status in ('fail', 'warn')").withColumn("n_issues", F.size("issues"))
    return rows.orderBy(F.when(F.col("status") == "fail", 0).otherwise(1), F.desc("n_issues"), "table_name")


def freshness(statuses: DataFrame, current: DataFrame) -> DataFrame:
    """table_name, state: changed, source_missing, unchanged or no_baseline, in that order. Both have table_name and checksum."""
    joined = statuses.select("table_name", F.col("checksum").alias("stored")).join(current.select("table_name", F.col("checksum").alias("now")), "table_name", "left")
    state = F.when(F.col("now").isNull(), "source_missing").when(F.col("stored").isNull(), "no_baseline").when(F.col("stored") != F.col("now"), "changed").otherwise("unchanged")
    rank = F.when(F.col("state") == "changed", 0).when(F.col("state") == "source_missing", 1).otherwise(2)
    return joined.select("table_name", state.alias("state")).orderBy(rank, "table_name")


def warnings(tables: DataFrame, statuses: DataFrame, fresh: DataFrame) -> DataFrame:
    """table_name, warning: never checked, unresolved fail issues, or a changed source; warn level is silent."""
    joined = tables.join(statuses, "table_name", "left").join(fresh, "table_name", "left")
    notes = F.array_compact(F.array(F.when(F.col("status").isNull(), "never checked"), F.when(F.col("status") == "fail", "unresolved fail issues"), F.when(F.col("state") == "changed", "source changed")))
    return joined.select("table_name", F.explode(notes).alias("warning"))


def audit_history(cleaning: DataFrame, decisions: DataFrame, table: str) -> DataFrame:
    """Cleaning events and decisions of one table, oldest first. cleaning: ts, files array<struct<table_name,status>>; decisions: ts, table_name, response."""
    events = cleaning.select("ts", F.explode("files").alias("f")).select("ts", F.col("f.table_name").alias("table_name"), F.lit("cleaning").alias("event"), F.col("f.status").alias("what"))
    made = decisions.select("ts", "table_name", F.lit("decision").alias("event"), F.col("response").alias("what"))
    return events.unionByName(made).where(F.lower("table_name") == table.lower()).orderBy("ts", "event")


METRIC = re.compile(r"(?is)^\s*define\s+metric\s+(\w+)\s*(?:=|as)\s*(.+?)(?:\s*--\s*(.*))?\s*$")


def parse_metric(command: str) -> tuple[str, str, str] | None:
    """(name, fragment, description) of "define metric <name> as <fragment> -- <description>"."""
    m = METRIC.match(command)
    return (m[1].lower(), m[2].strip(), (m[3] or "").strip()) if m else None


def apply_metric(df: DataFrame, by: list[str], name: str, fragment: str) -> DataFrame:
    return df.groupBy(*by).agg(F.expr(fragment).alias(name))
