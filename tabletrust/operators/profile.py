"""Profiles, key roles, fan-out and joins between tables, from melted cells."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions.text import to_long
from tabletrust.sources import store
from tabletrust.sources.publish import stored

ID = r"(^|_)id$"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rows, nulls, null_rate, distinct, min, max, avg, stddev of every numeric column, in one melted job."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns or numeric_columns(df)))
    long = df.select(F.explode(cells).alias("c")).select("c.*")
    stats = long.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.avg("v"), 4).alias("avg"), F.round(F.stddev_samp("v"), 4).alias("stddev"))
    distinct = long.where("v is not null").groupBy("column", "v").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    return stats.join(distinct, "column", "left").withColumns({"distinct": F.coalesce("distinct", F.lit(0)), "null_rate": F.round(F.col("nulls") / F.col("rows"), 6)})


def categorical_profile(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """column, rank, value, count, distinct, rows, nulls, high_cardinality: the most frequent values, equal counts by value."""
    counts = to_long(df, "t", columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    sizes = counts.groupBy("column").agg(F.count("value").alias("distinct"), F.sum("count").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("nulls"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    best = counts.where("value is not null").withColumn("rank", rank).where(F.col("rank") <= top)
    high = (F.col("distinct") >= 15) & (F.col("distinct") / F.col("rows")).between(0.03, 0.9)
    return best.join(sizes, "column").withColumn("high_cardinality", high)


def profile_table(df: DataFrame) -> DataFrame:
    """One row a column in table order: pos, column, kind, rows, nulls, null_rate, distinct, and min, max, avg, stddev of numeric
    ones or top_values (five) and high_cardinality of all others."""
    numbers = numeric_columns(df)
    texts = [c for c in df.columns if c not in numbers]
    parts = []
    if numbers:
        made = numeric_profile(df, numbers)
        parts.append(made.select("column", F.lit("numeric").alias("kind"), "rows", "nulls", "null_rate", "distinct", "min", "max", "avg", "stddev", F.lit(None).cast("array<struct<value:string,count:bigint>>").alias("top_values"), F.lit(None).cast("boolean").alias("high_cardinality")))
    if texts:
        made = categorical_profile(df, texts).groupBy("column").agg(F.first("rows").alias("rows"), F.first("nulls").alias("nulls"), F.first("distinct").alias("distinct"), F.first("high_cardinality").alias("high_cardinality"), F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("r"))
        none = [F.lit(None).cast("double").alias(c) for c in ("min", "max", "avg", "stddev")]
        parts.append(made.select("column", F.lit("categorical").alias("kind"), "rows", "nulls", F.round(F.col("nulls") / F.col("rows"), 6).alias("null_rate"), "distinct", *none, F.transform("r", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("top_values"), "high_cardinality"))
    places = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(df.columns) for x in (c, i))), F.col("column"))
    return reduce(DataFrame.unionByName, parts).select(places.alias("pos"), *parts[0].columns).orderBy("pos")


def table_metadata(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, columns of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows", F.array(*map(F.lit, df.columns)).alias("columns")) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def catalog(spark, hidden: str = r"^_|_previous$") -> DataFrame:
    """table, column, type, pos of the catalogue's user tables."""
    rows = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables() if not re.search(hidden, t.name) for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table string, column string, type string, pos int")


def bare(name: str, strip_prefix: bool) -> str:
    return re.sub(r"^[a-z]+_", "", name) if strip_prefix else name


KEY = ["table", "column", "value"]


def key_counts(tables: dict[str, DataFrame], pattern: str = ID) -> DataFrame:
    """table, column, value, c: how often each value of each id-like column occurs; nulls are left out."""
    parts = [to_long(df, t, cs) for t, df in tables.items() if (cs := [c for c in df.columns if re.search(pattern, c.lower())])]
    return reduce(DataFrame.unionByName, parts).where("value is not null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"))


def add_counts(root: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
    """Brings key counts kept by store.publish (keys KEY) up to date with those of rows that came or went; buckets written.

    Only counts of keys in the change are read and written, so a day's rows don't cost a pass over the table. A count may fall to 0.
    """
    parts = [x for x in (added, removed.withColumn("c", -F.col("c")) if removed is not None else None) if x is not None]
    change = stored(reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.sum("c").alias("c")), "change")
    spark = change.sparkSession
    known = store.read(spark, root).join(change.select(*KEY), KEY, "left_semi")
    return store.change(spark, root, stored(known.unionByName(change).groupBy(*KEY).agg(F.sum("c").alias("c")), "counts"))


def fanout_of(counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """fanout's rows from key counts; names: of a column without its table's prefix."""
    stats = counts.where("c > 0").groupBy("table", "column").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct"))
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("column")), F.col("column")) if names else F.col("column")
    unique = F.col("total") == F.col("distinct")
    return stats.select("table", "column", named.alias("name"), "total", "distinct", F.when(unique, "likely_pk").otherwise("likely_fk").alias("role"), (~unique).alias("has_fanout"))


def fanout(tables: dict[str, DataFrame], pattern: str = ID, strip_prefix: bool = False) -> DataFrame:
    """table, column, name, total, distinct, role (likely_pk or likely_fk), has_fanout of every id-like column."""
    return fanout_of(key_counts(tables, pattern), {c: bare(c, strip_prefix) for df in tables.values() for c in df.columns})


def fanout_kept(root: str, tables: dict[str, DataFrame], pattern: str = ID, strip_prefix: bool = False) -> DataFrame:
    """fanout's rows and source: stored for tables with kept counts, live for all others, which alone are read."""
    spark = next(iter(tables.values())).sparkSession
    kept = store.read(spark, root).where(F.col("table").isin(*tables))
    covered = {r["table"] for r in kept.select("table").distinct().collect()}  # names of tables
    parts = [kept]
    rest = {t: df for t, df in tables.items() if t not in covered and any(re.search(pattern, c.lower()) for c in df.columns)}
    if rest:
        parts.append(key_counts(rest, pattern))
    names = {c: bare(c, strip_prefix) for df in tables.values() for c in df.columns}
    live = F.when(F.col("table").isin(*rest), "live").otherwise("stored") if rest else F.lit("stored")
    return fanout_of(reduce(DataFrame.unionByName, parts), names).withColumn("source", live)


def with_declared(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared keys (table, column, declared_role) go before likely ones."""
    return found.join(declared, ["table", "column"], "left").withColumn("role", F.coalesce("declared_role", "role")).drop("declared_role")


def _pairs(found: DataFrame) -> DataFrame:
    """a and b: every two columns of different tables with one name (a few in all), from one pass over found."""
    rows = F.collect_list(F.struct("table", "column", "role", "has_fanout", "total", "distinct"))
    named = found.groupBy("name").agg(rows.alias("rows"))
    return named.select(F.explode("rows").alias("a"), "rows").select("a", F.explode("rows").alias("b")).where("a.table <> b.table")


def fanout_warnings(found: DataFrame) -> DataFrame:
    """Columns that multiply rows when joined: repeated ones whose name is a key elsewhere."""
    met = _pairs(found).where("a.has_fanout and b.role like '%pk'")
    return met.select("a.table", "a.column", F.col("b.table").alias("key_table"), F.round(F.col("a.total") / F.col("a.distinct"), 4).alias("rows_per_key"))


def uncovered(tables: list[str], stored: DataFrame, spark) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tables], "table string").join(stored.select("table").distinct(), "table", "left_anti")


def inferred_joins(found: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """fk_table, fk_column, pk_table, pk_column: one name is a key in one table and repeats in another; declared triples are left out."""
    met = _pairs(found).where("a.role like '%fk' and b.role like '%pk'")
    joins = met.select(F.col("a.table").alias("fk_table"), F.col("a.column").alias("fk_column"), "a.has_fanout", F.col("b.table").alias("pk_table"), F.col("b.column").alias("pk_column"))
    return joins if declared is None else joins.join(declared, ["fk_table", "fk_column", "pk_table"], "left_anti")


def join_advisory(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared joins with their fan-out (null if unchecked), then inferred ones."""
    known = declared.join(found.select(F.col("table").alias("fk_table"), F.col("column").alias("fk_column"), "has_fanout"), ["fk_table", "fk_column"], "left")
    columns = ["fk_table", "fk_column", "pk_table", "pk_column", "has_fanout"]
    return known.select(*columns, F.lit("declared").alias("certainty")).unionByName(inferred_joins(found, declared).select(*columns, F.lit("inferred").alias("certainty")))


def data_dictionary(tables: dict[str, DataFrame], found: DataFrame, derived: DataFrame) -> DataFrame:
    """table, column, type, pos, role, has_fanout, derived. derived: table, column."""
    spark = found.sparkSession
    rows = [(t, f.name, f.dataType.simpleString(), i) for t, df in tables.items() for i, f in enumerate(df.schema)]
    base = spark.createDataFrame(rows, "table string, column string, type string, pos int")
    marked = base.join(found.select("table", "column", "role", "has_fanout"), ["table", "column"], "left")
    return marked.join(derived.select("table", "column", F.lit(True).alias("derived")), ["table", "column"], "left").withColumn("derived", F.coalesce("derived", F.lit(False)))


def column_diff(before: list[str], after: list[str]) -> tuple[list[str], list[str]]:
    """Columns removed and added between two generations."""
    return [c for c in before if c not in after], [c for c in after if c not in before]
