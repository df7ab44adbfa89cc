"""Audit, repair, enrich, profile and relate tables, and compare groups, as Spark DataFrame operators."""
