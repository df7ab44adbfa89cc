"""Treatment plans that are kept, found again for a fresh load of the same table, checked, and dropped where they fail."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrust.functions.text import to_long
from tabletrust.operators import rubric, treat
from tabletrust.sources import store
from tabletrust.sources.publish import stored

KEYS = ["table", "signature_hash"]
PLANS = "table string, signature_hash string, category string, columns array<string>"
#: Buckets of the plan store.
BUCKETS = 16


class Replayed(NamedTuple):
    """The treated table, and the plans that were used and dropped, by signature hash."""

    table: DataFrame
    used: list[str]
    dropped: list[str]


def plans_of(df: DataFrame, issues: DataFrame, table: str) -> DataFrame:
    """One plan for each signature that has a treatment: the category and its columns. Columns with signs, units or another
    locale are read by those treatments, not as plain text numbers."""
    issues = stored(issues, "issues")  # a few rows a column
    apart = issues.where(F.col("category").isin("currency_units", "locale_mix")).select(F.col("column").alias("_c")).distinct()
    issues = issues.join(apart, (F.col("category") == "numeric_as_text") & (F.col("column") == F.col("_c")), "left_anti")
    made = treat.signatures(issues, rubric.value_types(to_long(df, table)))
    return made.select("table", "signature_hash", F.col("signature.kind").alias("category"), "columns").where(F.col("category").isin(*treat.COLUMN_TREATMENTS))


def remember(spark: SparkSession, root: str, plans: DataFrame) -> None:
    """Keeps plans; one with the table and signature of an older one takes its place."""
    if store.exists(spark, root):
        store.change(spark, root, upserts=plans)
    else:
        store.publish(plans, root, KEYS, BUCKETS)


def forget(spark: SparkSession, root: str, table: str) -> None:
    """Drops all plans of a table, as when its source is loaded anew with other columns."""
    store.change(spark, root, deletes=store.read(spark, root).where(F.col("table") == table))


def replay(spark: SparkSession, root: str, df: DataFrame, table: str, as_of_year: int = 2026) -> Replayed:
    """Applies the kept plans of a table to a fresh load. The columns of the plans alone are audited again; a plan whose issue
    is still there, or whose columns the load lacks, is dropped from the store and not applied. Without plans the table is
    returned as it is; plans of other tables are never used."""
    if not store.exists(spark, root):
        return Replayed(df, [], [])
    rows = store.read(spark, root).where(F.col("table") == table).orderBy("signature_hash").collect()  # a few rows a column
    fits = [r for r in rows if set(r.columns) <= set(df.columns)]
    steps = lambda plans: [(r.category, c) for r in plans for c in r.columns]
    failed: set[tuple[str, str]] = set()
    if fits:
        made = stored(treat.apply_plan(df, steps(fits)), "replayed")
        columns = sorted({c for _, c in steps(fits)})
        failed = {(r.category, r["column"]) for r in rubric.issues(made.select(*columns), table, as_of_year).collect()}
    good = [r for r in fits if not failed & {(r.category, c) for c in r.columns}]
    bad = [r for r in rows if r not in good]
    if bad:
        store.change(spark, root, deletes=spark.createDataFrame([(r.table, r.signature_hash) for r in bad], "table string, signature_hash string"))
    if fits and good != fits:
        made = stored(treat.apply_plan(df, steps(good)), "replayed")
    return Replayed(made if good else df, [r.signature_hash for r in good], [r.signature_hash for r in bad])
