"""The tables behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.plans.ranks import quantiles


def line(df: DataFrame, ts: str, unit: str, measure: str) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.round(F.sum(measure), 2).alias("value"), F.count(F.lit(1)).alias("n")).orderBy("bucket")


def bar(df: DataFrame, category: str, measure: str, top: int) -> DataFrame:
    return df.groupBy(category).agg(F.round(F.sum(measure), 2).alias("value")).orderBy(F.desc("value"), category).limit(top)


def scatter(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return df.groupBy(group).agg(F.round(F.avg(x), 6).alias("x"), F.round(F.avg(y), 6).alias("y"), F.count(F.lit(1)).alias("n"))


def pie(df: DataFrame, category: str, measure: str, slices: int = 5) -> DataFrame:
    """At most `slices` slices: the largest ones, and Other. Null measures are left out, values are absolute."""
    sums = df.where(F.col(measure).isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg(F.abs(F.sum(measure)).alias("value"))
    counted = sums.crossJoin(sums.agg(F.count(F.lit(1)).alias("k")))  # the second side is one row
    rank = F.row_number().over(Window.orderBy(F.desc("value"), "category"))  # over one row a category
    name = F.when((F.col("k") <= slices) | (F.col("rank") < slices), F.col("category")).otherwise("Other")
    return counted.withColumn("rank", rank).groupBy(name.alias("category")).agg(F.round(F.sum("value"), 2).alias("value"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bin, low, n: min(20, max(5, n // 5)) bins of equal width from the smallest to the largest value."""
    s = df.where(F.col(column).isNotNull()).agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"), F.count(column).alias("n"))
    s = s.withColumn("bins", F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("n") / 5)))).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("bins"))
    v = F.col(column).cast("double")
    at = F.when(F.col("w") > 0, F.least(F.floor((v - F.col("lo")) / F.col("w")), F.col("bins") - 1)).otherwise(0)
    binned = df.where(F.col(column).isNotNull()).select(column).crossJoin(F.broadcast(s.drop("n"))).select(at.cast("long").alias("bin"), "lo", "w")  # one row of statistics
    return binned.groupBy("bin").agg(F.round(F.first(F.col("lo") + F.col("bin") * F.col("w")), 4).alias("low"), F.count(F.lit(1)).alias("n")).orderBy("bin")


def box(df: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles of each group, and whiskers: the last values within 1.5 interquartile ranges. Null measures don't count;
    rows without a group are a group. The quartiles (a row a group) meet the rows where they are read, if they are small."""
    q = quantiles(df, [group], column, [0.25, 0.5, 0.75]).select(F.col(group).alias("_g"), *(F.col("q")[i].alias(f"_{n}") for i, n in enumerate(("q1", "median", "q3"))))
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    inside = df.join(q, F.col(group).eqNullSafe(F.col("_g"))).where(F.col(column).between(F.col("_q1") - reach, F.col("_q3") + reach))
    return inside.groupBy(group).agg(F.min(column).alias("low"), *(F.round(F.first(f"_{n}"), 4).alias(n) for n in ("q1", "median", "q3")), F.max(column).alias("high"))


def stacked(df: DataFrame, category: str, sub: str, measure: str) -> DataFrame:
    """All cells of the grid; is_missing: no rows, is_null: rows but only null measures."""
    cells = df.groupBy(category, sub).agg(F.round(F.sum(measure), 2).alias("value"), F.lit(False).alias("is_missing"))
    grid = df.select(category).distinct().crossJoin(df.select(sub).distinct())  # of category names, not rows
    out = grid.join(cells, [category, sub], "left").withColumn("is_missing", F.coalesce("is_missing", F.lit(True)))
    return out.withColumn("is_null", ~F.col("is_missing") & F.col("value").isNull())


def treemap(df: DataFrame, outer: str, inner: str, measure: str) -> DataFrame:
    sums = df.groupBy(outer, inner).agg(F.sum(measure).alias("value"))
    return sums.crossJoin(sums.agg(F.sum("value").alias("t"))).select(outer, inner, F.round("value", 2).alias("value"), F.round(F.col("value") / F.col("t"), 6).alias("share"))


def quadrant(df: DataFrame, x: str, y: str) -> DataFrame:
    """Flags rows below the median of x and above the median of y."""
    mx, my = (quantiles(df, [], c, [0.5]).agg(F.max(F.col("q")[0]).alias(n)) for c, n in ((x, "_mx"), (y, "_my")))  # one row each
    return df.crossJoin(F.broadcast(mx)).crossJoin(F.broadcast(my)).withColumn("opportunity", (F.col(x) < F.col("_mx")) & (F.col(y) > F.col("_my"))).drop("_mx", "_my")


def fallback_columns(df: DataFrame) -> tuple[str, str | None]:
    """The first column that isn't numeric, and the first other that is."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    category = next((c for c in df.columns if c not in numeric), df.columns[0])
    return category, next((c for c in numeric if c != category), None)


def validate_shape(df: DataFrame, kind: str) -> tuple[str, str | None]:
    """The chart kind to use and why another one than asked for. df: a result, already aggregated."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    measures = [c for c in numeric if not (c.lower() == "n" or c.lower().endswith(("_id", "count")) or c.lower() == "id")]
    category, _ = fallback_columns(df)
    if kind == "pie" and df.select(category).distinct().count() > 5:
        return "bar", "more than five categories"
    if kind == "line":
        first = df.schema[0]
        if not isinstance(first.dataType, (T.DateType, T.TimestampType)):
            by = Window.orderBy(F.monotonically_increasing_id())  # over a capped result
            steps = df.select(F.col(first.name).alias("v")).withColumn("d", F.col("v") < F.lag("v").over(by))
            if not steps.where("d").isEmpty():
                return "bar", "no time and no ordered key"
    if kind == "scatter" and len(measures) < 2:
        return "bar", "fewer than two measures"
    if kind in ("stacked", "treemap") and len(df.columns) < 3:
        return "bar", "fewer than three columns"
    if kind in ("histogram", "box") and df.limit(10).count() < 10:
        return "bar", "fewer than ten rows"
    return kind, None
