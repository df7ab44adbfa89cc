"""Strings, numbers, dates and the melt that every per-column check shares."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrust.functions import hints


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_number(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(hints.NUMBER), F.lit(False))


def number(c: Column) -> Column:
    """The number that a text is, null for any other text; letters after digits are no number."""
    return F.when(is_number(c), strip(c).try_cast("double"))


def shape(form: str) -> str:
    """A pattern that every text has which a date format reads."""
    parts = re.findall(r"y+|M+|d+|H+|m+|s+|'[^']*'|.", form)
    return "(?i)^" + "".join(r"[+-]?\d{4,}" if p[0] == "y" else r"\d\d" if p[0] in "MdHms" else re.escape(p.strip("'")) for p in parts) + "$"


def timestamp(c: Column, formats: list[str] | None = None) -> Column:
    """The first of the formats that reads the text; null for none."""
    formats = hints.DATE_FORMATS + hints.TIME_FORMATS if formats is None else formats
    # The text is stripped once, and a format is tried only on texts of its shape; a failed try costs much more than a pattern.
    read = lambda s: F.coalesce(*(F.when(s.rlike(shape(f)), F.try_to_timestamp(s, F.lit(f))) for f in formats))
    return F.get(F.transform(F.array(strip(c)), read), F.lit(0))


def date_format(c: Column) -> Column:
    """Name of the first date format that reads the text."""
    return F.coalesce(*(F.when(F.try_to_timestamp(strip(c), F.lit(f)).isNotNull(), f) for f in hints.DATE_FORMATS))


def humanize(name: str) -> str:
    """avg_price -> Avg Price."""
    return " ".join(w.capitalize() for w in name.replace("_", " ").split())


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two arrays over all of them; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def sanitize(name: str) -> str:
    """A table or column identifier: lower case, other characters as _, no leading digit, never empty."""
    made = re.sub(r"[^a-z0-9]", "_", name.strip().lower())
    return "col" if not made else f"_{made}" if made[0].isdigit() else made


def sanitized(names: list[str]) -> list[str]:
    """Identifiers without repeats: a repeated one gets a number."""
    out: list[str] = []
    for name in map(sanitize, names):
        made, n = name, 1
        while made in out:
            n += 1
            made = f"{name}_{n}"
        out.append(made)
    return out


def hinted(columns: list[str], words: list[str]) -> list[str]:
    """Columns whose lower-case name holds one of the words."""
    return [c for c in columns if any(w in c.lower() for w in words)]


def has_hint(name: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(name).contains(w) for w in words])


def to_long(df: DataFrame, table: str = "t", columns: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """(table, *keep, column, value): one row per cell. Checks aggregate it once for all columns."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in (columns or df.columns)]
    return df.select(F.lit(table).alias("table"), *keep, F.explode(F.array(*cells)).alias("_cell")).select("table", *keep, "_cell.column", "_cell.value")
