"""Exact quantiles of many groups at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.sources.publish import stored


def _place(n: Column, share: float) -> Column:
    """Where a quantile stands among n ordered values, from 0; between two values where it isn't whole."""
    return (n - 1) * F.lit(share)


def quantiles(df: DataFrame, groups: list[str], column: str, shares: list[float]) -> DataFrame:
    """groups, q (array<double>: a value for each share, between neighbours in proportion) and n, for each group with values.

    Equal values of a group are counted before anything is ordered. The counts are dealt once to ranges of (groups, value);
    each range knows how many values of a group stand before it from the counts of the ranges, so a group of any size is
    spread over as many tasks as it needs and all groups and shares are found in the same pass. No task holds more than a
    range. Groups are compared null-safe; null values don't count; a group without values has no row; an empty table gives
    no rows.
    """
    v, c, part, upto = "_v", "_c", "_part", "_upto"
    keys = [F.col(f"`{g}`") for g in groups]
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(*keys, F.col(f"`{column}`").cast("double").alias(v)).agg(F.count(F.lit(1)).alias(c))
    dealt = stored(counts.repartitionByRange(*keys, F.col(v)).withColumn(part, F.spark_partition_id()), "ranks")  # read twice
    own = dealt.groupBy(*keys, part).agg(F.sum(c).alias("_n"))
    of_group = Window.partitionBy(*keys) if groups else Window.partitionBy(F.lit(0))
    before = own.withColumn("_before", F.coalesce(F.sum("_n").over(of_group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(of_group))
    places = [_place(F.col("_all"), s) for s in shares]
    wanted = F.array_distinct(F.array(*(f(p).cast("long") for p in places for f in (F.floor, F.ceil))))
    # Only ranges that hold a wanted rank are read again.
    holds = F.exists(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    needed = before.where(holds).select(*keys, part, "_before", "_all")
    same = reduce(lambda a, b: a & b, [dealt[g].eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.lit(True))
    named = needed.select(*(F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)), F.col(part).alias("_p"), "_before", "_all")
    met = dealt.join(named, (dealt[part] == F.col("_p")) & same)
    order = Window.partitionBy(part, *keys).orderBy(v)  # within a range
    ranked = met.withColumn(upto, F.col("_before") + F.sum(c).over(order))
    first = F.col(upto) - F.col(c)
    hit = F.filter(wanted, lambda r: (r >= first) & (r < F.col(upto)))
    found = ranked.select(*keys, v, "_all", F.explode(hit).alias("_rank"))
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", v))).alias("_at"), F.first("_all").alias("n"))

    def value(share: float) -> Column:
        place = _place(F.col("n"), share)
        low, high = F.try_element_at("_at", F.floor(place).cast("long")), F.try_element_at("_at", F.ceil(place).cast("long"))
        return low + (high - low) * (place - F.floor(place))

    return by_rank.select(*keys, F.array(*map(value, shares)).alias("q"), "n")
