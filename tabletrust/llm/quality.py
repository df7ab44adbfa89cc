"""Quality rules on whole texts: word counts, symbols, repeats, and bands of zstandard compression ratios.

A ratio is raw bytes over compressed bytes. Repetitive text has a high ratio, noise a low one, and both depend on length,
so the limits are bands by length. They are learned from the whole input: of each quarter octave of length the median of
the logarithms of the ratios, and SPREADS robust deviations to either side, for texts and for chunks apart. Each distinct
text that passes the base rules counts once, each chunk ratio once a text. Medians and deviations are running medians over
neighbouring lengths, so that one family of near copies doesn't set them. Lengths with fewer than LEAST texts nearby have
only the fixed outer limits, which hold for all. The whole text and each of its fixed chunks must lie within their bands;
a text is rejected for its chunks only if more than a share of its bytes is in chunks outside.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.common import saved

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = re.compile(r"[#*$%&|<>]").findall
LEVEL = 3
CHUNK = 4096
#: Outer limits, whatever the input: bytes from which they hold, least and greatest ratio of texts and chunks.
BANDS = [(0, 0.0, 4.0), (256, 1.05, 2.6), (512, 1.15, 2.8), (1024, 1.25, 3.0), (4096, 1.35, 3.3), (16384, 1.4, 3.6), (65536, 1.4, 4.0)]
#: Learned limits: robust deviations between median and limit, the least deviation, texts needed within REACH lengths, and
#: the width of a cell of logarithms of ratios.
SPREADS, LEAST_SPREAD, LEAST, REACH, STEP = 4.5, 0.012, 50, 2, 0.005
#: Share of a text's bytes that may lie in chunks outside their bands.
BAD_CHUNKS = 0.5
MIN_WORDS = 50
MAX_REPEAT = 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, base_failed boolean, band_failed boolean, kept boolean"
FIGURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, base_failed boolean, size long, chunks array<double>, text_hash long, cells array<long>"
#: Logarithms of the least and greatest ratio by kind (0 text, 1 chunk) and length.
Bands = dict[tuple[int, int], tuple[float, float]]


def repeated(words: list[str]) -> int:
    """Words in three-word windows that are found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    k = len(ids)
    if k < 2_000_000:
        windows = (a[:-2] * k + a[1:-1]) * k + a[2:]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.stack([a[:-2], a[1:-1], a[2:]]), axis=1, return_inverse=True, return_counts=True)
    again = counts[inverse.ravel()] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORDS(x[:1]) or WORDS(x)]
    return len(lines) - len(set(lines))


def band(size: int) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(BANDS) if size >= start)


def length(size: int) -> int:
    """The quarter octave of a number of bytes."""
    return math.floor(4 * math.log2(size))


def outside(kind: int, size: int, ratio: float, bands: Bands) -> bool:
    low, high = band(size)
    if not low <= ratio <= high:
        return True
    low, high = bands.get((kind, length(size)), (-math.inf, math.inf))
    return not low <= math.log(ratio) <= high


def sized(size: int, ratios: list[float]) -> list[tuple[int, float]]:
    """Sizes and ratios of the chunks of a text."""
    return [(min(CHUNK, size - i * CHUNK), r) for i, r in enumerate(ratios)]


def measured(text: str, pack: zstandard.ZstdCompressor) -> tuple:
    """The figures of FIGURES from n_words on."""
    words = WORDS(text)
    again = repeated(words)
    data = text.encode("utf-8", "surrogatepass")
    size, ratio = len(data), len(data) / len(pack.compress(data)) if data else 0.0
    chunks = [len(part) / len(pack.compress(part)) for part in (data[i : i + CHUNK] for i in range(0, size, CHUNK))]
    failed = len(words) < MIN_WORDS or 100 * again > 100 * MAX_REPEAT * len(words)
    cells = [] if failed else sorted({cell(0, size, ratio)} | {cell(1, n, r) for n, r in sized(size, chunks)})
    text_hash = int(np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64))
    return len(words), sum(map(len, words)), len(SYMBOLS(text)), dup_lines(text), again, ratio, failed, size, chunks, text_hash, cells


def cell(kind: int, size: int, ratio: float) -> int:
    """Kind, length and the logarithm of the ratio in steps, as one number."""
    return (kind << 40) + (length(size) << 20) + math.floor(math.log(ratio) / STEP) + (1 << 19)


def verdict(size: int, ratio: float, chunks: list[float], bands: Bands) -> tuple[float, bool]:
    """The share of bytes in chunks outside their bands, and whether the bands reject the text."""
    share = sum(n for n, r in sized(size, chunks) if outside(1, n, r, bands)) / max(1, size)
    return share, share > BAD_CHUNKS or bool(size) and outside(0, size, ratio, bands)


def judged(text: str, pack: zstandard.ZstdCompressor, bands: Bands | None = None) -> tuple:
    """The columns of SCHEMA from n_words on; without bands by the outer limits alone."""
    *counts, ratio, failed, size, chunks, _, _ = measured(text, pack)
    share, banned = verdict(size, ratio, chunks, bands or {})
    return *counts, ratio, share, failed, banned, not (failed or banned)


def figures(docs: DataFrame) -> DataFrame:
    """doc_id and what the bands are learned from and applied to, for each row of docs."""
    names = [c.split()[0] for c in FIGURES.split(", ")]
    types = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                found = [measured(t or "", pack) for t in part.column(1).to_pylist()]
                columns = [pa.array([r[i] for r in found], types[i]) for i in range(len(types))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, FIGURES)


def running(values: np.ndarray) -> np.ndarray:
    """Running medians of five, of fewer values toward the ends."""
    n = len(values)
    return np.array([np.median(values[i - w : i + w + 1]) for i in range(n) for w in [min(i, n - 1 - i, 2)]])


def quantile(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    order = np.argsort(values)
    total = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(total, share * total[-1])])


def learned(made: DataFrame) -> Bands:
    """The bands of the texts behind figures. The driver gets counts of cells, whose number doesn't follow the input."""
    once = made.where("not base_failed").groupBy("text_hash").agg(F.first("cells").alias("cells"))
    seen = once.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()
    code, n = np.array([r.cell for r in seen], np.int64), np.array([r.n for r in seen], np.int64)
    kinds, at, logs = code >> 40, (code >> 20) & 0xFFFFF, ((code & 0xFFFFF) - (1 << 19) + 0.5) * STEP
    bands: Bands = {}
    for kind in (0, 1):
        near = {b: m for b in map(int, np.unique(at[kinds == kind])) for m in [_near(kinds == kind, at, n, b)] if m is not None}
        if not near:
            continue
        known = np.array(list(near))
        middle = running(np.array([quantile(logs[m], n[m], 0.5) for m in near.values()]))
        rest = logs - np.interp(at, known, middle)
        spread = running(np.array([(quantile(rest[m], n[m], 0.75) - quantile(rest[m], n[m], 0.25)) / 1.349 for m in near.values()]))
        wide = SPREADS * np.maximum(spread, LEAST_SPREAD)
        bands |= {(kind, int(b)): (float(x - w), float(x + w)) for b, x, w in zip(known, middle, wide, strict=True)}
    return bands


def _near(kind: np.ndarray, at: np.ndarray, n: np.ndarray, b: int) -> np.ndarray | None:
    """The cells of a length, with those around it as far as LEAST texts need; None where they are too few."""
    for reach in range(REACH + 1):
        m = kind & (abs(at - b) <= reach)
        if n[m].sum() >= LEAST:
            return m
    return None


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the compression figures, base_failed, band_failed and kept, for each row of docs.

    A null or empty text has no words and fails; texts of any length are read whole; repeated rows and rows with equal or
    null ids are judged each; an empty table gives no rows. Other columns of docs aren't read, whatever they are called.
    What the bands alone reject is the rows with band_failed and without base_failed.
    """
    made = saved(figures(docs), "figures")
    bands = learned(made)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [verdict(*row, bands) for row in zip(*(part.column(c).to_pylist() for c in ("size", "ratio", "chunks")), strict=True)]
            failed = part.column("base_failed").to_pylist()
            added = {"bad_chunks": [s for s, _ in found], "band_failed": [b for _, b in found], "kept": [not (f or b) for f, (_, b) in zip(failed, found, strict=True)]}
            types = {"bad_chunks": pa.float64(), "band_failed": pa.bool_(), "kept": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(added[c], types[c]) if c in added else part.column(c) for c in names], names=names)

    return made.mapInArrow(run, SCHEMA)


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever they are called. Nulls, ties, repeated rows
    and empty tables are as in `rules`. Texts are read twice, to learn and to judge, and never shuffled."""
    names = docs.columns
    bands = learned(figures(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                texts = part.column(names.index("text")).to_pylist()
                yield part.filter(pa.array([judged(t or "", pack, bands)[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
