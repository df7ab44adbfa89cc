"""Reading raw files: audit reads with every column text, typed loads, JSON, JSON lines, HTML tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrust.functions import hints
from tabletrust.functions.text import is_number, sanitized

FIELD = '(?:^|,)("(?:[^"]|"")*"|[^,]*)'
CORRUPT = "_corrupt_record"
SOURCE = "_path"


def null_strings(df: DataFrame, na: list[str]) -> DataFrame:
    return df.select(*(F.when(~F.col(f"`{c}`").isin(na), F.col(f"`{c}`")).alias(c) if t == "string" and c not in (CORRUPT, SOURCE) else F.col(f"`{c}`") for c, t in df.dtypes))


def fields(line: str) -> list[str]:
    """The fields of a header line as written, without quotes."""
    return [a[1:-1].replace('""', '"') if a[:1] == '"' and a[-1:] == '"' and len(a) > 1 else a for a in re.findall(FIELD, line)]


def header(spark: SparkSession, path: str) -> list[str]:
    """The header row as written: the first line's fields."""
    first = spark.read.text(path).limit(1).select(F.regexp_extract_all(F.regexp_replace("value", "^﻿", ""), F.lit(FIELD), F.lit(1)).alias("h")).first()
    return [x.strip('"') for x in first.h] if first else []


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if all of a file's lines are, else ISO-8859-1."""
    lines = spark.read.text(path).select(F.col("value").cast("binary").cast("string").alias("v"))
    return "UTF-8" if lines.where(~F.is_valid_utf8("v")).isEmpty() else "ISO-8859-1"


def has_quoted_line_ends(spark: SparkSession, path: str) -> bool:
    """Whether a line holds an odd number of quotes, so that a quoted value may go on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 != 0).isEmpty()


def read_csv_audit(spark: SparkSession, path: str, na: list[str] | None = None, encoding: str | None = None) -> DataFrame:
    """Every column text; rows with too many fields are dropped, rows with too few padded with nulls; NA strings are null.

    Files that aren't UTF-8 are read as ISO-8859-1. A file is split among tasks unless a quoted value may hold a line end.
    """
    encoding = encoding or encoding_of(spark, path)
    made = read_csv_files(spark, path, header(spark, path), encoding, has_quoted_line_ends(spark, path), hints.NA_STRINGS if na is None else na)
    return made.drop(SOURCE)


def read_csv_files(spark: SparkSession, paths: str | list[str], names: list[str], encoding: str, quoted_ends: bool, na: list[str]) -> DataFrame:
    """The same for files of one header whose encoding and quotes are known; the file's name is in _path."""
    seen: dict[str, int] = {}
    cols = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        cols.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in [*cols, CORRUPT])
    raw = spark.read.schema(schema).option("header", True).option("multiLine", quoted_ends).option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", True).option("encoding", encoding).option("columnNameOfCorruptRecord", CORRUPT).csv(paths)
    long_row = F.size(F.regexp_extract_all(F.col(CORRUPT), F.lit(FIELD), F.lit(1))) > len(cols)
    # Spark refuses reads of the corrupt record alone, as of a count; the first column goes along and changes nothing.
    fits = F.coalesce(F.col(CORRUPT).isNull() | ~long_row, F.col(f"`{cols[0]}`").isNull()) if cols else F.lit(True)
    kept = raw.withColumn(SOURCE, F.col("_metadata.file_path")).where(fits).drop(CORRUPT)
    return null_strings(kept, na)


def infer_types(df: DataFrame) -> dict[str, str]:
    """bigint, double or string per text column, from all rows; columns without values are text."""
    checks = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        checks += [F.every(v.try_cast("bigint").isNotNull() | v.isNull()).alias(f"{c}|i"), F.every(is_number(v) | v.isNull()).alias(f"{c}|d"), F.count(v).alias(f"{c}|n")]
    r = df.agg(*checks).first()
    return {c: "string" if not r[f"{c}|n"] else "bigint" if r[f"{c}|i"] else "double" if r[f"{c}|d"] else "string" for c in df.columns}


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    names = sanitized(df.columns)
    return df.select(*(F.col(f"`{c}`").try_cast(types[c]).alias(n) for c, n in zip(df.columns, names, strict=True)))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A typed table with sanitised names; only the empty string is null."""
    raw = read_csv_audit(spark, path, na=[""])
    return typed(raw, infer_types(raw))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that can't be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self._close()
            self.cell = []

    def _close(self) -> None:
        if self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table") and self.tables:
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(pages: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, cells of every row of every table; pages: page_id, html."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                if html and "<table" in html.lower():
                    parser = _Tables()
                    parser.feed(html)
                    rows += [(page, t, r, cells) for t, table in enumerate(parser.tables) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=["page_id", "table_no", "row_no", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table_no int, row_no int, cells array<string>")


def largest_tables(pages: DataFrame) -> DataFrame:
    """The rows of each page's table with most rows times columns; the first of equals."""
    rows = html_tables(pages)
    sizes = rows.groupBy("page_id", "table_no").agg((F.count(F.lit(1)) * F.max(F.size("cells"))).alias("area"))
    best = sizes.groupBy("page_id").agg(F.max_by("table_no", F.struct("area", -F.col("table_no"))).alias("table_no"))
    return rows.join(best, ["page_id", "table_no"])


def union_tables(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
