"""Discovery: samples to look at, and hypotheses verified on whole columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.functions import hints


def inspect_values(df: DataFrame, column: str, n: int = 40, seed: int = 0) -> DataFrame:
    """Half the rarest values, half drawn by a seeded hash."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).count()
    rare = values.orderBy("count", "value").limit(n // 2).select("value", F.lit("rare").alias("how"))
    drawn = values.orderBy(F.xxhash64("value", F.lit(seed)), "value").limit(n - n // 2).select("value", F.lit("drawn").alias("how"))
    return rare.unionByName(drawn)


def verify_patterns(long: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Share of non-null values that each pattern is found in. hypotheses: column, pattern, threshold (a small table)."""
    joined = long.where("value is not null").join(F.broadcast(hypotheses), "column")
    stats = joined.groupBy("table", "column", "pattern", "threshold").agg(F.count_if(F.regexp_like("value", "pattern")).alias("matched"), F.count(F.lit(1)).alias("n"))
    share = F.col("matched") / F.col("n")
    return stats.select("table", "column", "pattern", "matched", "n", F.round(share, 6).alias("fraction"), ((F.col("n") >= hints.HYPOTHESIS_ROWS) & (share >= F.col("threshold"))).alias("verified"))


def eligible_columns(columns: list[str], flagged: list[str], prose: list[str], sequential: list[str]) -> list[str]:
    return [c for c in columns if c not in {*flagged, *prose, *sequential}]


def name_similarity(columns: list[str]) -> dict[tuple[str, str], float]:
    """Jaccard similarity of the words of two column names."""
    words = {c: set(re.findall("[a-z]+", c.lower())) for c in columns}
    return {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) if words[a] | words[b] else 0.0 for i, a in enumerate(columns) for b in columns[i + 1 :]}


def _hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    """column (its place in the list) and h (a 64-bit hash of the text) of every non-null cell."""
    cells = F.array(*(F.struct(F.lit(i).alias("column"), F.xxhash64(F.col(f"`{c}`").cast("string")).alias("h"), F.col(f"`{c}`").isNotNull().alias("known")) for i, c in enumerate(columns)))
    return df.select(F.explode(cells).alias("_c")).where("_c.known").select("_c.column", "_c.h")


def signatures(df: DataFrame, columns: list[str], sample: int) -> tuple[DataFrame, dict[int, int], set[int]]:
    """Each column's lowest hashes, about `sample` of them (column, h), the distinct values of each, roughly, and the columns
    whose every hash is in."""
    cells = _hashed(df, columns)
    sizes = {r["column"]: r["d"] for r in cells.groupBy("column").agg(F.approx_count_distinct("h", 0.02).alias("d")).collect()}  # one number a column
    whole = {c for c, d in sizes.items() if d <= sample}
    limits = {c: (1 << 63) - 1 if c in whole else -(1 << 63) + int((1 << 64) * sample / d) for c, d in sizes.items()}
    if not limits:
        return cells, sizes, whole
    limit = F.element_at(F.create_map(*(F.lit(x) for c, top in limits.items() for x in (c, F.lit(top).cast("long")))), F.col("column"))
    return cells.where(F.col("h") <= limit).distinct(), sizes, whole


def _contained(df: DataFrame, columns: list[str], sample: int) -> dict[tuple[int, int], tuple[float, bool]]:
    """Share of the smaller column's distinct values that the larger one holds, as its signature tells, and whether that is exact."""
    low, sizes, whole = signatures(df, columns, sample)
    if not sizes:
        return {}
    small = low.toDF("a", "h")
    # At most a signature a column: a table of bounded size, unless there are very many columns.
    small = F.broadcast(small) if len(sizes) * sample <= 1 << 20 else small
    met = _hashed(df, columns).join(small, "h").select("a", F.col("column").alias("b"), "h").distinct()
    hits = {(r["a"], r["b"]): r["n"] for r in met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a pair of columns
    out = {}
    for a in sizes:
        for b in (b for b in sizes if a < b):
            true = {c: hits[c, c] if c in whole else sizes[c] for c in (a, b)}
            x, y = (a, b) if true[a] <= true[b] else (b, a)
            out[a, b] = (hits.get((x, y), 0) / hits[x, x] if (x, x) in hits else 0.0, x in whole and (y in whole or true[y] > 1.2 * true[x]))
    return out


def _exact(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The same share by all distinct values of the columns of these pairs."""
    used = sorted({c for p in pairs for c in p})
    places = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(used) for x in (i, c))), F.col("column"))
    values = _hashed(df, [columns[c] for c in used]).distinct().groupBy("h").agg(F.sort_array(F.collect_set(places)).alias("cs"))  # at most the table's columns
    wanted = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in [*pairs, *((c, c) for c in used)]))
    met = values.select(F.explode(F.filter(wanted, lambda p: F.array_contains("cs", p[0]) & F.array_contains("cs", p[1]))).alias("p"))
    n = {tuple(r["p"]): r["n"] for r in met.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {(a, b): n.get((a, b), 0) / least if (least := min(n.get((a, a), 0), n.get((b, b), 0))) else 0.0 for a, b in pairs}


def column_pairs(df: DataFrame, top: int = hints.PAIRS, sample: int = 4096) -> DataFrame:
    """a, b, names (similarity), values (overlap: shared distinct values over the smaller column's), score: the likeliest pairs of one content.

    Every column gives a signature, its lowest hashes, and one pass counts which columns hold them; that tells how much of the
    smaller column the larger one holds, whatever their sizes, and no value is shuffled. Only pairs that may be among the best
    (within five standard errors) are counted on all their distinct values, by 64-bit hashes; the result is exact. Null cells are
    left out; columns without values overlap with nothing; equal scores go by name.
    """
    columns = df.columns
    named = name_similarity(columns)
    told = _contained(df, columns, sample)
    rows = {(i, j): [named[columns[i], columns[j]], *told.get((i, j), (0.0, True))] for i in range(len(columns)) for j in range(i + 1, len(columns))}
    margin = 2.5 / sample**0.5
    best = sorted((n + v - (0 if exact else margin) for n, v, exact in rows.values()), reverse=True)
    least = best[min(top, len(best)) - 1] if best else 0.0
    open_pairs = [p for p, (n, v, exact) in rows.items() if not exact and n + v + margin >= least]
    for p, v in (_exact(df, columns, open_pairs) if open_pairs else {}).items():
        rows[p][1:] = [v, True]
    found = [(*sorted((columns[i], columns[j])), n, v, round(n + v, 6)) for (i, j), (n, v, exact) in rows.items() if exact]
    found = sorted(found, key=lambda r: (-r[4], r[0], r[1]))[:top]
    return df.sparkSession.createDataFrame(found, "a string, b string, names double, values double, score double")


def verify_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of equal values on rows where both are non-null, for all pairs in one pass; duplicate at 0.95."""
    structs = []
    for a, b in pairs:
        x, y = F.col(a).cast("string"), F.col(b).cast("string")
        structs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (x.isNotNull() & y.isNotNull()).alias("both"), (x == y).alias("same")))
    rows = df.select(F.explode(F.array(*structs)).alias("_p")).select("_p.*").where("both")
    out = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("same").cast("double")), 6).alias("fraction"))
    return out.withColumn("duplicate", F.col("fraction") >= hints.DUPLICATE_COLUMN)


