"""Query shapes with fixed conventions: minimum samples, one place for null filters, safe fan-out, stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_groups(df: DataFrame, by: list[str], metrics: dict[str, str], min_n: int = 5, all_groups: bool = False) -> DataFrame:
    """Per group: n, mean, sample deviation of every metric; ranked by all of them. metrics: name -> column.

    Rows with a null metric go before grouping, so that all figures are of the same rows; groups under min_n go after,
    unless all_groups.
    """
    base = df.dropna(subset=list(metrics.values()))
    aggs = [a for name, c in metrics.items() for a in (F.round(F.avg(c), 4).alias(f"avg_{name}"), F.round(F.stddev_samp(c), 4).alias(f"stddev_{name}"))]
    out = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    kept = out if all_groups else out.where(F.col("n") >= min_n)
    return kept.orderBy(*(F.desc(f"avg_{name}") for name in metrics), *by)


def disclosure(df: DataFrame, by: list[str], metrics: dict[str, str], min_n: int = 5, frame: str | None = None) -> DataFrame:
    """One row on what rank_groups did: minimum, keys, rows left out for nulls, groups left out, time frame."""
    nulls = df.select(*(F.col(c).isNull().alias(f"_{n}") for n, c in metrics.items()), *by)
    any_null = F.greatest(*(F.col(f"_{n}").cast("int") for n in metrics)) if len(metrics) > 1 else F.col(f"_{next(iter(metrics))}").cast("int")
    groups = nulls.groupBy(*by).agg(F.sum(1 - any_null).alias("n"), F.sum(any_null).alias("dropped"))
    return groups.agg(F.lit(min_n).alias("min_n"), F.lit(", ".join(metrics)).alias("ranked_by"), F.sum("dropped").alias("null_rows"), F.count_if(F.col("n") < min_n).alias("small_groups"), F.lit(frame).cast("string").alias("time_frame"))


def preaggregate_join(left: DataFrame, right: DataFrame, key: str, aggs: list[Column], how: str = "left") -> DataFrame:
    """The many side becomes one row a key before the join, so that the left side's rows aren't multiplied."""
    return left.join(right.groupBy(key).agg(*aggs), key, how)


def two_stage_topk(df: DataFrame, first: str, k: int, second: str, tie: str) -> DataFrame:
    """The k rows largest in one metric, ordered by another."""
    return df.orderBy(F.desc(first), tie).limit(k).orderBy(F.desc(second), tie)


def bin_case(df: DataFrame, column: str, limits: list[float]) -> DataFrame:
    """bucket, n, low: counts between limits, ordered by the smallest value."""
    name = F.lit(f">= {limits[-1]:g}")
    for low, high in reversed(list(zip([None, *limits], limits, strict=False))):
        name = F.when(F.col(column) < high, f"< {high:g}" if low is None else f"{low:g} - {high:g}").otherwise(name)
    return df.groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low")).orderBy("low")


def pivot_sum(df: DataFrame, by: str, across: str, values: list[str], measure: str) -> DataFrame:
    return df.groupBy(by).pivot(across, values).agg(F.round(F.sum(measure), 2))


def unpivot_metrics(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "metric", "value")


def per_unit(df: DataFrame, by: str, measure: str, unit: str) -> DataFrame:
    """Measure per distinct unit, not raw totals."""
    return df.groupBy(by).agg(F.round(F.sum(measure) / F.count_distinct(unit), 4).alias("per_unit"), F.count_distinct(unit).alias("units"))


def distinct_disclosed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows and how many rows each stood for."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def rate(df: DataFrame, by: str, condition: Column, min_n: int = 5) -> DataFrame:
    return df.groupBy(by).agg(F.round(F.count_if(condition) / F.count(F.lit(1)), 6).alias("rate"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
