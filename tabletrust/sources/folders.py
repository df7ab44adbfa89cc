"""Folders of many files: a manifest made on executors, and one table for all files of one shape."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrust.functions import hints
from tabletrust.sources import files

CHUNK = 1 << 20
#: Characters at a file's start that tell what it is.
HEAD = 1 << 16
MARKUP = re.compile(r"<(!doctype|!--|\?xml|html|head|body|table|div)\b|<!--", re.I)
MANIFEST = "path string, bytes long, modified timestamp, checksum string, kind string, encoding string, quoted_ends boolean, shape string, error string"


def _open(path: str) -> Any:
    """A stream of a file of any file system that Arrow knows."""
    found = re.match(r"(\w[\w+.-]*):(?://([^/]*))?(/.*)", path)
    if not found or found[1] == "file":
        return fs.LocalFileSystem().open_input_stream(found[3] if found else path)
    scheme = "s3" if found[1] in ("s3a", "s3n") else found[1]
    system, root = fs.FileSystem.from_uri(f"{scheme}://{found[2]}/")
    return system.open_input_stream(root.rstrip("/") + found[3])


def _keys(text: str) -> str:
    """The names in the first JSON object of a text, sorted."""
    if "{" not in text:
        raise ValueError("no JSON record")
    record, _ = json.JSONDecoder().raw_decode(text, text.index("{"))
    return ",".join(sorted(record))


def shape_of(head: str) -> tuple[str, str]:
    """Kind (csv, json, jsonl or html) and shape (header line or names) of a file that starts so; ValueError for any other."""
    text = head.removeprefix("﻿").lstrip()
    if not text:
        raise ValueError("empty file")
    if "\0" in text:
        raise ValueError("no reader for binary files")
    if MARKUP.match(text):
        return "html", ""
    if text[0] in "[{":
        lines = [x for x in text.splitlines() if x.strip()]
        try:
            whole = isinstance(json.loads(lines[0]), dict)
        except ValueError:
            whole = False
        return "jsonl" if whole and text[0] == "{" else "json", _keys(text)
    return "csv", head.removeprefix("﻿").split("\n", 1)[0].rstrip("\r")


def _describe(path: str) -> tuple[str | None, ...]:
    """checksum, kind, encoding, quoted_ends, shape, error of one file, read once in chunks."""
    digest, decoder, head, rest = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), b"", 0
    encoding, odd = "UTF-8", False
    with _open(path) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
            head += chunk[: HEAD - len(head)] if len(head) < HEAD else b""
            if encoding == "UTF-8":
                try:
                    decoder.decode(chunk)
                except UnicodeDecodeError:
                    encoding = "ISO-8859-1"
            if not odd and (b'"' in chunk or rest):
                # Quotes of the line that the chunk before left open count on.
                counts = [line.count(b'"') for line in chunk.split(b"\n")]
                counts[0] += rest
                odd, rest = any(n % 2 for n in counts[:-1]), counts[-1]
    odd |= bool(rest % 2)
    try:
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        encoding = "ISO-8859-1"
    try:
        kind, shape = shape_of(head.decode(encoding, "ignore"))
    except ValueError as e:
        return digest.hexdigest(), None, encoding, odd, None, str(e)[:200]
    return digest.hexdigest(), kind, encoding, odd, shape, None


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file below a folder: path, bytes, modified, checksum (SHA-256), kind by content, encoding, quoted_ends (a quoted
    value may hold a line end), shape (header line, or names of the first record), error.

    Executors read each file once as a stream, so it may have any size; a file that can't be read is a row with its error.
    Hidden files (names starting with . or _) and empty ones are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                try:
                    told = _describe(row.path)
                except OSError as e:
                    told = (None, None, None, None, None, str(e).splitlines()[0][:200])
                rows.append((*row, *told))
            yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in MANIFEST.split(", ")]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).mapInPandas(run, MANIFEST)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """path and SHA-256 of each file."""
    return manifest(spark, folder).select("path", "checksum")


def _read(spark: SparkSession, kind: str, encoding: str, quoted: bool, shape: str, paths: list[str]) -> DataFrame:
    if kind == "csv":
        return files.read_csv_files(spark, paths, files.fields(shape), encoding, quoted, hints.NA_STRINGS)
    if kind == "html":
        whole = spark.read.option("wholetext", True).text(paths).select("value", F.col("_metadata.file_path").alias("_path"))
        pages = whole.select(F.xxhash64("_path").alias("page_id"), F.col("value").alias("html"), "_path")
        return files.largest_tables(pages).join(pages.select("page_id", "_path"), "page_id").select("_path", "row_no", "cells")
    made = spark.read.option("multiLine", kind == "json").option("mode", "DROPMALFORMED").option("encoding", encoding).json(paths)
    return made.withColumn(files.SOURCE, F.col("_metadata.file_path"))


def tables(listed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """One table for all files of one shape (named by kind and number, in the order of the shapes), and path and error of the rest.

    listed: a manifest, stored, as it is read twice. Every table has its files' names in _path; the driver holds the names of the
    files, as it does when Spark lists them, and one entry a shape. Columns named _path give way.
    """
    spark = listed.sparkSession
    key = ["kind", "shape", "encoding", "quoted_ends"]
    groups = listed.where("error is null").groupBy(*key).agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(*key).collect()
    parts: dict[tuple[str, str], list[DataFrame]] = {}
    for g in groups:
        parts.setdefault((g.kind, g["shape"]), []).append(_read(spark, g.kind, g.encoding, g.quoted_ends, g["shape"], g.paths))
    out = {f"{kind}_{i}": files.union_tables(made) for i, ((kind, _), made) in enumerate(parts.items())}
    return out, listed.where("error is not null").select("path", "error")


def convert(found: dict[str, DataFrame], out: str) -> dict[str, bool]:
    """Writes every table as CSV with a header into a folder of its name; one that is there stays. Whether each was written."""
    done = {}
    for name, df in found.items():
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        done[name] = not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        if done[name]:
            flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
            df.select(*flat).write.option("header", True).option("escape", '"').mode("error").csv(f"{out}/{name}")
    return done
