"""Checks on the lines of raw files: encoding, structure, headers, quotes, ends.

A file is read in splits, by as many tasks as it has. Where a split begins inside a quoted value depends on all before it, so
each split is scanned once for both cases and gives two summaries: what its lines hold, the part of a record that began
before it, the part that goes on after it, and the case in which the next split begins. A file's summaries, one row a split,
are then put together in order: the cases are chained, and parts of records that cross splits are joined by their counts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabletrust.functions import hints
from tabletrust.sources.files import FIELD
from tabletrust.sources.folders import _open

#: Bytes of header rows that are sent to all tasks at once; more files than that are taken in blocks.
HEADER_BYTES = 16 << 20
#: The byte order mark of UTF-8, and how many files the driver opens at once to look for it.
MARK, OPENERS = b"\xef\xbb\xbf", 16
_CLOSING = re.compile(rb'(?:[^"]|"")*"(?!")')
_BLANK = re.compile(rb"[\s,]*")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, value): the lines of all files under a path in order within each split, whose place in its file is start."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value); lines are numbered within their file from 0: within the split by the reading task, and from the
    counts of the splits before it."""
    rows = raw_lines(spark, path).withColumn("_at", F.monotonically_increasing_id())
    splits = rows.groupBy("path", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    placed = splits.select("path", "start", "_first", before.alias("_before"))
    return rows.join(placed, ["path", "start"]).select("path", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line_no"), "value")


def fields_of(line: bytes, inside: bool) -> tuple[int, bool]:
    """The commas of a line that part fields, and whether it ends in a quoted value; inside: whether it begins in one. A quote
    opens a value only at the start of a field, and closes it only undoubled."""
    commas, at, n = 0, 0, len(line)
    while True:
        if inside or line[at : at + 1] == b'"':
            m = _CLOSING.match(line, at if inside else at + 1)
            if not m:
                return commas, True
            at, inside = m.end(), False
        at = line.find(b",", at, n)
        if at < 0:
            return commas, False
        commas, at = commas + 1, at + 1


class _Case:
    """One split, scanned as if it began inside a quoted value or not. While a value that opened here stays open, a shadow
    scans the lines after it on their own: they count so if the value never closes."""

    def __init__(self, inside: bool):
        self.inside, self.head, self.shadow = inside, None, None
        self.commas = self.quotes = self.size = 0
        self.begun = inside  # whether the open record began before the split
        self.widths: Counter = Counter()
        self.unmatched = self.records = self.trailing = 0

    def line(self, value: bytes, blank: bool) -> None:
        was = self.inside
        commas, self.inside = (value.count(b","), False) if not self.inside and b'"' not in value else fields_of(value, self.inside)
        self.commas += commas
        self.quotes += value.count(b'"')
        self.size += 1
        if self.inside:
            if not was:
                self.shadow = _Case(False)
            elif self.shadow:
                self.shadow.line(value, blank)
            return
        self.shadow = None
        if self.begun:
            self.head = [self.commas, self.quotes]
        else:
            self.add(self.commas, self.quotes, blank and self.size == 1)
        self.commas = self.quotes = self.size = 0
        self.begun = False

    def add(self, commas: int, quotes: int, blank: bool) -> None:
        self.records += 1
        self.unmatched += quotes % 2
        if not blank and quotes % 2 == 0:
            self.widths[commas + 1] += 1

    def alone(self) -> tuple[Counter, int]:
        """Widths and unmatched quotes of the lines if what is open never closes."""
        widths, unmatched = Counter(self.widths), self.unmatched + self.inside
        if self.shadow:
            more, odd = self.shadow.alone()
            widths, unmatched = widths + more, unmatched + odd
        return widths, unmatched

    def told(self) -> dict:
        after = self.shadow.alone() if self.shadow else (Counter(), 0)
        open_part = [self.commas, self.quotes] if self.inside else None
        return {"head": self.head, "open": open_part, "whole": self.begun and self.inside, "widths": dict(self.widths), "unmatched": self.unmatched, "inside": self.inside, "after": [dict(after[0]), after[1]]}


def _split_summaries(lines: DataFrame, heads: dict[str, bytes]) -> DataFrame:
    """path, start, n, encoding, repeated, trailing, all_blank and both cases (JSON) of each split of the files with a header."""
    shared = lines.sparkSession.sparkContext.broadcast(heads)  # HEADER_BYTES at most, about
    kind = "path string, start long, n long, encoding long, repeated long, trailing long, all_blank boolean, cases string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, state = shared.value, None, None

        def told() -> pa.RecordBatch:
            path, start = now
            row = {"path": path, "start": start, "n": state["n"], "encoding": state["encoding"], "repeated": state["repeated"], "trailing": state["trailing"], "all_blank": state["trailing"] == state["n"], "cases": json.dumps([c.told() for c in state["cases"]])}
            return pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("start", pa.int64()), *((c, pa.int64()) for c in ("n", "encoding", "repeated", "trailing")), ("all_blank", pa.bool_()), ("cases", pa.string())]))

        for batch in batches:
            for path, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path not in known:
                    continue
                if now != (path, start):
                    if now is not None:
                        yield told()
                    now, state = (path, start), {"n": 0, "encoding": 0, "repeated": 0, "trailing": 0, "cases": [_Case(False), _Case(True)]}
                first = start == 0 and state["n"] == 0
                state["n"] += 1
                try:
                    state["encoding"] += "\ufffd" in value.decode("utf-8")
                except UnicodeDecodeError:
                    state["encoding"] += 1
                blank = bool(_BLANK.fullmatch(value))
                state["trailing"] = state["trailing"] + 1 if blank else 0
                if first:  # the header isn't a data row; if it is quoted over several lines, its next ones are read as data
                    continue
                state["repeated"] += value == known[path]
                for case in state["cases"]:
                    case.line(value, blank)
        if now is not None:
            yield told()

    return lines.mapInArrow(run, kind)


def _put_together(header: bytes, frame: pd.DataFrame) -> dict:
    """The counts of one file from the summaries of its splits in order. A quoted value that never closes is an unmatched quote
    in its first line; what comes after it is taken up again from there."""
    splits = list(frame.sort_values("start").itertuples())
    cases = [json.loads(r.cases) for r in splits]
    widths, quotes, k, inside, carried, opened = Counter(), 0, 0, False, None, None

    def add(found: dict, odd: int) -> None:
        nonlocal quotes
        quotes += odd
        for w, c in found.items():
            widths[int(w)] += c

    while k < len(splits):
        case = cases[k][int(inside)]
        add(case["widths"], case["unmatched"])
        if case["head"] is not None:
            commas, marks = carried[0] + case["head"][0], carried[1] + case["head"][1]
            add({} if marks % 2 else {commas + 1: 1}, marks % 2)
            carried = None
        if case["open"] is not None and case["whole"]:
            carried = [carried[0] + case["open"][0], carried[1] + case["open"][1]]
        elif case["open"] is not None:
            carried, opened = case["open"], (k, case["after"])
        inside, k = case["inside"], k + 1
        if k == len(splits) and inside:
            k, after = opened[0] + 1, opened[1]
            add(after[0], after[1] + 1)
            inside, carried = False, None
    trailing = 0
    for r in reversed(splits):
        trailing += r.trailing
        if not r.all_blank:
            break
    n, width = sum(r.n for r in splits), fields_of(header, False)[0] + 1
    totals = {c: sum(getattr(r, c) for r in splits) for c in ("encoding", "repeated")}
    return {"n": n, **totals, "quotes": quotes, "ragged": sum(c for w, c in widths.items() if w != width), "trailing": min(trailing, max(n - 1, 0))}


def first_lines(lines: DataFrame) -> DataFrame:
    """(path, head): the first line of each file; each task hands on one line a file."""
    rows = lines.where("start = 0").select("path", "value", F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("path").agg(F.min_by("value", "at").alias("head"))


def _composed(spark: SparkSession, heads: dict[str, bytes]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    shared = spark.sparkContext.broadcast(heads)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["path"].iloc[0]
        return pd.DataFrame([{"path": name, "head": shared.value[name], **_put_together(shared.value[name], frame)}])

    return one


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """path, head, n and the counts of every file's flaws: encoding, quotes, repeated, ragged, trailing."""
    lines = raw_lines(spark, path)
    heads = first_lines(lines)
    size = heads.agg(F.coalesce(F.sum(F.octet_length("head") + F.octet_length("path") + 64), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // HEADER_BYTES)), None
    kind = "path string, head binary, n long, encoding long, quotes long, repeated long, ragged long, trailing long"
    for k in range(blocks):
        known = {r.path: bytes(r["head"]) for r in heads.where(F.pmod(F.xxhash64("path"), F.lit(blocks)) == k).collect()}
        made = _split_summaries(lines, known).groupBy("path").applyInPandas(_composed(spark, known), kind)  # a row a split
        out = made if out is None else out.unionByName(made)
    return out


def _issue(rows: DataFrame, category: str, affected: Column, total: Column) -> DataFrame:
    return rows.where(affected > 0).select(F.col("path").alias("table"), F.lit(category).alias("category"), F.lit(hints.SEVERITY[category]).alias("severity"), F.lit(None).cast("string").alias("column"), affected.cast("long").alias("affected"), total.cast("long").alias("total"))


def _marked(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of files of any file system of Spark's that begin with a byte order mark, once unpacked as the line reader does it."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    place, codecs = hadoop.fs.Path, hadoop.io.compress.CompressionCodecFactory(conf)

    def marked(path: str) -> bool:
        at = place(path)
        codec, stream = codecs.getCodec(at), at.getFileSystem(conf).open(at)
        try:
            stream = codec.createInputStream(stream) if codec else stream
            return bytes(stream.readNBytes(len(MARK))) == MARK
        finally:
            stream.close()

    with ThreadPoolExecutor(OPENERS) as pool:
        return [path for path, found in zip(paths, pool.map(marked, paths), strict=True) if found]


def bom(spark: SparkSession, path: str) -> DataFrame:
    """Files of any size that begin with a byte order mark. Their first three bytes tell it, and as the line reader drops them
    they are read apart: by tasks through Arrow's streams for local, S3 and GCS files; through Spark's own file systems, which
    only the driver reaches, for all others and for what Arrow doesn't unpack."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    streamed = F.col("path").rlike("^(file|s3|s3a|s3n|gs):") & ~F.col("path").rlike(r"\.(deflate|lz4|snappy)$")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch.column(0).to_pylist(), []
            for name in names:
                with _open(name) as stream:
                    found.append(int(stream.read(len(MARK)) == MARK))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.int32())], names=["path", "bom"])

    told = files.where(streamed).select("path").mapInArrow(run, "path string, bom int")
    others = [r.path for r in files.where(~streamed).select("path").collect()]  # Spark lists them on the driver as well
    if marked := _marked(spark, others):
        told = told.unionByName(spark.createDataFrame([(name, 1) for name in marked], "path string, bom int"))
    return _issue(told, "bom", F.col("bom"), F.lit(1))


def headers(first: DataFrame) -> DataFrame:
    """(path, pos, name) of the header rows as written. first: path, head."""
    names = F.regexp_extract_all(F.col("head").cast("string"), F.lit(FIELD), F.lit(1))
    return first.select("path", F.posexplode(names).alias("pos", "name")).withColumn("name", F.regexp_replace("name", '^"|"$', ""))


def style(name: Column) -> Column:
    n = F.trim(name)
    return F.when(n.rlike("^[A-Z0-9_ ]*[A-Z][A-Z0-9_ ]*$"), "upper").when(n.rlike("^[a-z0-9_ ]+$"), "snake_or_lower").when(n.rlike("^[A-Za-z0-9]+( [A-Za-z0-9]+)*$"), "title_or_camel").otherwise("other")


def line_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of every file under a path: encoding, unmatched quotes, repeated and flawed headers, field counts, trailing empty
    rows. Line ends within quoted values are part of the value; a quote that opens none or never closes is unmatched. An
    empty file has no lines and no issues; a file of any size is read by as many tasks as it has splits."""
    stats = line_counts(spark, path).persist()  # a row a file, read by each category
    named = headers(stats).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") != F.trim("name")).alias("padded"), F.count_distinct(F.lower(F.trim("name"))).alias("distinct"),
        F.size(F.collect_set(style(F.col("name")))).alias("styles"), F.count_if(F.col("name").rlike(r"(?U)[^\w \-]")).alias("special"),
    )
    flawed = F.col("padded") + (F.col("n") - F.col("distinct")) + F.when(F.col("styles") > 1, 1).otherwise(0)
    found = [_issue(stats, c, F.col(k), F.col("n")) for c, k in (("encoding", "encoding"), ("unmatched_quote", "quotes"), ("repeated_header", "repeated"), ("ragged_rows", "ragged"), ("trailing_empty", "trailing"))]
    found += [_issue(named, "header_issues", flawed, F.col("n")), _issue(named, "header_special", F.col("special"), F.col("n"))]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def trailing_empty_column(df: DataFrame) -> bool:
    """Whether the last column has no name and no values."""
    last = df.columns[-1]
    return (not last.strip() or last.lower().startswith(("unnamed", "_c"))) and df.where(F.col(f"`{last}`").isNotNull()).isEmpty()
