"""Checks on grouped results: outliers, group sizes, one-way analysis of variance, wording."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of count columns, causal wording and what it becomes, wording that asks for the note, the note.
COUNT_NAME = re.compile(r"(?i)^(?:n|count|num\w*|sample_size|total_count|\w+_count)$")
MEAN_NAME = re.compile(r"(?i)^(avg|mean|average)_?|_(avg|mean|average)$")
CAUSAL = [
    (r"(?i)\bleads?\s+to\b", "is associated with"),
    (r"(?i)\bcauses?\b", "is associated with"),
    (r"(?i)\bcaused\s+by\b", "associated with"),
    (r"(?i)\bresults?\s+in\b", "is associated with"),
    (r"(?i)\bresponsible\s+for\b", "associated with"),
    (r"(?i)\bdriven\s+by\b", "associated with"),
    (r"(?i)\bexplains?\s+why\b", "is associated with"),
    (r"(?i)\bbecause\s+of\b", "alongside"),
    (r"(?i)\bdue\s+to\b", "alongside"),
]
CAUSAL_LEFT = r"(?i)\b(?:causes?|caused by|leads? to|results? in|explains? why|responsible for|drives?|driven by|because of|due to|impact(?:s|ed)? (?:the|on)|affect(?:s|ed)?)\b"
DISCLAIMER = "Note: this result shows a statistical association only — the data cannot establish that one variable caused another."


def outlier_sensitivity(groups: DataFrame, metric: str) -> DataFrame:
    """max, median, groups, flagged: whether the largest group exceeds three medians, of at least three groups."""
    s = groups.agg(F.max(metric).alias("max"), F.median(metric).alias("median"), F.count(metric).alias("groups"))
    return s.withColumn("flagged", (F.col("groups") >= 3) & (F.col("median") > 0) & (F.col("max") > 3 * F.col("median")))


def size_imbalance(groups: DataFrame, count: str) -> DataFrame:
    s = groups.agg(F.max(count).alias("largest"), F.min(count).alias("smallest"))
    return s.withColumn("flagged", (F.col("smallest") != 0) & (F.col("largest") / F.nullif(F.col("smallest"), F.lit(0)) >= 10))


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or tiny)
        c = 1 + n / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def p_value(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f), as a column."""

    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([f_tail(*x) for x in zip(f, d1, d2, strict=True)], dtype=float)

    return F.pandas_udf(tail, "double")(f.cast("double"), d1.cast("double"), d2.cast("double"))


def anova(groups: DataFrame, mean: str, sd: str, n: str) -> DataFrame:
    """One row: k, f, df_between, df_within, p, from each group's mean, sample deviation and size. Groups without a deviation
    are left out; no row for fewer than two groups, no deviation at all or no degree of freedom. Means are compared with the
    mean of all before they are squared, so large means lose nothing."""
    g = groups.where(F.col(sd).isNotNull() & F.col(mean).isNotNull())
    all_of = g.agg((F.sum(F.col(n) * F.col(mean)) / F.sum(n)).alias("_mean"))  # one row
    apart = F.col(mean) - F.col("_mean")
    s = g.crossJoin(F.broadcast(all_of)).agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(F.col(n) * apart * apart).alias("ssb"), F.sum((F.col(n) - 1) * F.col(sd) * F.col(sd)).alias("ssw"))
    ok = s.where((F.col("k") >= 2) & (F.col("ssw") > 0) & (F.col("n") > F.col("k")))
    rows = ok.select("k", ((F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))
    return rows.withColumn("p", p_value(F.col("f"), F.col("df_between"), F.col("df_within")))


def anova_p(groups: DataFrame, mean: str, sd: str, n: str) -> tuple[float, float] | None:
    """F and p of the analysis of variance; None where there is none."""
    r = anova(groups, mean, sd, n).first()
    return (r.f, r.p) if r else None


def count_columns(names: list[str]) -> list[str]:
    return [c for c in names if COUNT_NAME.match(c)]


def mean_columns(names: list[str]) -> list[str]:
    return [c for c in names if MEAN_NAME.search(c)]


def causal_rewrite(c: Column) -> Column:
    """Causal wording becomes associative; a text in which causal wording is left, as its verbs mean other things too, gets a note."""
    out = c
    for pattern, plain in CAUSAL:
        out = F.regexp_replace(out, pattern, plain)
    return F.when(out.rlike(CAUSAL_LEFT) & ~out.contains(DISCLAIMER), F.concat(out, F.lit("\n\n" + DISCLAIMER))).otherwise(out)


def relevant_notes(notes: DataFrame, touched: DataFrame) -> DataFrame:
    """Warnings of the tables that queries touched. touched: query_id, table_name."""
    return touched.join(notes, "table_name").select("query_id", "table_name", "warning")


def first_seen(df: DataFrame, value: str, pos: str, n: int = 12) -> DataFrame:
    """Distinct values in the order they are first seen."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(pos).alias("first")).orderBy("first", value).limit(n)
