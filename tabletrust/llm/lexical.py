"""Ranked lexical search with hashed max-sketches.

1. Index: the frequencies of a text's terms fold into a sketch: a term's hash names a few coordinates, each of which keeps
   the largest frequency of the terms that fall on it. A term's impact is its weight times a share that only rises with its
   frequency in the text, so a coordinate bounds the impact for any weights, and the least of a term's coordinates is its
   bound. A sketch has DENSITY coordinates a distinct term, so bounds are as tight for long texts as for short ones.
2. Bounds: the items' terms are looked up in all sketches of a batch at once; the impacts found sum to an upper bound of
   each score. The texts with the largest bounds of each item are scored exactly, and the k-th best score is its threshold.
3. Threshold: bounds descend, so every text whose bound reaches the threshold is scored exactly, and no other can be among
   the best k. What is returned comes from these exact scores alone. The index keeps the texts, packed, beside their
   sketches, so a text is scored where its bound is found, and only the best k rows an item of each task are shuffled.

A text is known by two 64-bit hashes, so copies are one candidate, however many there are; tasks keep the best k rows an
item before anything is shuffled. Items are taken in blocks of bounded size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.llm.common import bounded, saved, value_bytes

#: Everything of ASCII but digits and letters ends a term; A-Z are lowered, other characters stay.
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Coordinates of a sketch for each distinct term (up to twice as many, by powers of two), and of the smallest sketch.
DENSITY, LEAST_WIDTH = 16, 64
#: Bits by which a term's hash is shifted for each coordinate that it names.
SHIFTS = (0, 21, 42)
#: The largest frequency of a coordinate; it stands for any larger one too.
FULL = 255
#: What a term's share nears as its frequency grows.
SHARE = 1_000_000
#: Texts scored for an item's first threshold, as a multiple of k.
FIRST = 2
#: Bytes of the items that are taken together, about.
ITEM_BYTES = 1 << 20
#: Documents whose terms are counted before they are handed on, and that meet the items at once.
BLOCK, ROWS = 4096, 256
#: A row's text, as two numbers.
KEY = ["k1", "k2"]


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sketch(counts: dict[bytes, int]) -> np.ndarray:
    width = max(LEAST_WIDTH, 1 << (DENSITY * len(counts) - 1).bit_length())
    out = np.zeros(width, np.uint8)
    hashes, tf = hashed(list(counts)), np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), FULL).astype(np.uint8)
    order = np.argsort(tf, kind="stable")  # the largest of a coordinate is written last
    for s in SHIFTS:
        at = places(hashes[order], s, width)
        out[at] = np.maximum(out[at], tf[order])
    return out


def places(hashes: np.ndarray, shift: int, width: int) -> np.ndarray:
    return ((hashes >> np.uint64(shift)) & np.uint64(width - 1)).astype(np.int64)


def share(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def packed(text: str) -> bytes:
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 1)


def unpacked(data: bytes) -> str:
    return zlib.decompress(data).decode("utf-8", "surrogatepass")


def folded(sketch: np.ndarray) -> bytes:
    """A sketch for the index, about a quarter of its size: its width's power of two, a bit a coordinate, what isn't 0."""
    held = sketch > 0
    return bytes([len(sketch).bit_length() - 1]) + np.packbits(held).tobytes() + sketch[held].tobytes()


def unfolded(data: bytes) -> bytes:
    width = 1 << data[0]
    out, bits = np.zeros(width, np.uint8), np.frombuffer(data, np.uint8, offset=1)
    out[np.unpackbits(bits[: width // 8]).view(bool)] = bits[width // 8 :]
    return out.tobytes()


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))


def indexed(docs: DataFrame, wanted: frozenset[bytes], sketches: bool = True) -> DataFrame:
    """The stored index: doc_id, k1, k2, n (terms), sketch and packed text of every row of docs that has a term; and, in rows with a
    term, how many documents of a block hold it, for the terms in `wanted` (those of a block of items)."""
    names = ["doc_id", *KEY, "n", "sketch", "packed", "term", "seen"]
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # of ITEM_BYTES, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, seen, rows = shared.value, Counter(), 0

        def told() -> pa.RecordBatch:
            m = len(seen)
            nothing = [pa.nulls(m, kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=names)

        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                n, made, kept, known = [], [], [], {}
                for text, key in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if key not in known:
                        words = terms(text)
                        counts = Counter(words)
                        store = sketches and words
                        known[key] = len(words), folded(sketch(counts)) if store else b"", packed(text) if store else b"", counts.keys() & asked
                    length, s, whole, held = known[key]
                    seen.update(held)
                    n.append(length)
                    made.append(s)
                    kept.append(whole)
                if sketches:
                    blank = pa.nulls(part.num_rows)
                    out = pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(n, pa.int64()), pa.array(made, pa.binary()), pa.array(kept, pa.binary()), blank.cast(pa.binary()), blank.cast(pa.int64())], names=names)
                    yield out.filter(pa.array([x > 0 for x in n]))
                rows += part.num_rows
                if rows >= BLOCK:
                    yield told()
                    seen, rows = Counter(), 0
        yield told()

    return saved(with_keys(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, n long, sketch binary, packed binary, term binary, seen long"), "index")


class Asked(NamedTuple):
    """A block of items: their ids, distinct terms with hashes and weights, and each item's terms by place; the corpus's
    documents and terms in all."""

    ids: list
    words: list[bytes]
    hashes: np.ndarray
    weights: np.ndarray
    of: list[list[int]]
    n: int
    length: int

    def long(self, n: int) -> int:
        """m of a document with n terms."""
        return 50 + 50 * n * self.n // self.length


def asked(rows: list, index: DataFrame, totals: tuple[int, int]) -> Asked:
    """rows: (item_id, text), those with terms that a document holds."""
    held = {bytes(r.term): r.df for r in index.where("term is not null").groupBy("term").agg(F.sum("seen").alias("df")).collect()}
    n, length = totals
    words = sorted(held)
    place = {w: i for i, w in enumerate(words)}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held[w] + 1))) for w in words], np.int64)
    found = [(r[0], sorted({place[t] for t in terms(r[1]) if t in place})) for r in rows]
    found = [x for x in found if x[1]]
    return Asked([x[0] for x in found], words, hashed(words), weights, [x[1] for x in found], n, length)


def bounds(items: Asked, n: list[int], sketches: list[bytes]) -> np.ndarray:
    """An upper bound of each document's score (rows) for each item (columns)."""
    out = np.zeros((len(n), len(items.of)), np.int64)
    flat, starts = np.concatenate([np.array(x) for x in items.of]), np.cumsum([0, *(len(x) for x in items.of[:-1])])
    m = np.array([items.long(x) for x in n], np.int64)
    widths = np.array([len(s) for s in sketches])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        for k in range(0, len(at), ROWS):
            rows = at[k : k + ROWS]
            matrix = np.frombuffer(b"".join(sketches[i] for i in rows), np.uint8).reshape(len(rows), width)
            tf = matrix[:, places(items.hashes, SHIFTS[0], width)]
            for s in SHIFTS[1:]:
                tf = np.minimum(tf, matrix[:, places(items.hashes, s, width)])
            impacts = np.zeros(tf.shape, np.int64)
            i, j = np.nonzero(tf)
            f = tf[i, j].astype(np.int64)
            impacts[i, j] = np.where(f == FULL, SHARE, 1_000_000_000 * f // (1000 * f + 20 * m[rows[i]])) * items.weights[j]
            out[rows] = np.add.reduceat(impacts[:, flat], starts, axis=1)
    return out


def candidates(index: DataFrame, items: Asked, most: int) -> DataFrame:
    """q (the item's place), k1, k2 and bound: the `most` documents of each task with the largest bounds of each item."""
    shared = index.sparkSession.sparkContext.broadcast(items)  # a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best, kept = np.zeros((0, len(block.of)), np.int64), np.zeros((0, len(block.of), 2), np.int64)
        for batch in batches:
            for part in (batch.slice(k, 4 * ROWS) for k in range(0, batch.num_rows, 4 * ROWS)):
                keys = np.column_stack([part.column(0).to_numpy(), part.column(1).to_numpy()])
                bound = bounds(block, part.column(2).to_pylist(), [unfolded(x) for x in part.column(3).to_pylist()])
                best, kept = np.vstack([best, bound]), np.vstack([kept, np.repeat(keys[:, None, :], len(block.of), axis=1)])
                if len(best) > most:
                    top = np.argpartition(-best, most - 1, axis=0)[:most]
                    best, kept = np.take_along_axis(best, top, 0), np.take_along_axis(kept, top[:, :, None], 0)
        i, q = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(kept[i, q, 0], pa.int64()), pa.array(kept[i, q, 1], pa.int64()), pa.array(best[i, q], pa.int64())], names=["q", *KEY, "bound"])

    return index.where("term is null").select(*KEY, "n", "sketch").mapInArrow(run, "q int, k1 long, k2 long, bound long")


def scores_of(block: Asked, text: str, qs: list[int]) -> dict[int, int]:
    """The exact score of a text for each of the items."""
    words = terms(text)
    counts, m = Counter(words), block.long(len(words))
    impact = {p: int(block.weights[p]) * share(f, m) for p in {p for q in qs for p in block.of[q]} if (f := counts.get(block.words[p]))}
    return {q: sum(impact.get(p, 0) for p in block.of[q]) for q in qs}


class Best:
    """The best k rows of each item that a task has seen; equal scores by id, without id last."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, doc_id: int | None, scores: dict[int, int]) -> None:
        for q, s in scores.items():
            if s > 0:
                held = self.held.setdefault(q, [])
                held.append((-s, doc_id is None, doc_id or 0))
                if len(held) > 8 * self.k:
                    self.held[q] = nsmallest(self.k, held)

    def rows(self) -> pa.RecordBatch:
        flat = [(q, *x) for q, held in self.held.items() for x in nsmallest(self.k, held)]
        ids = pa.array([None if x[2] else x[3] for x in flat], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), ids, pa.array([-x[1] for x in flat], pa.int64())], names=["q", "doc_id", "score"])


def rescored(docs: DataFrame, chosen: DataFrame, items: Asked, k: int) -> DataFrame:
    """q, doc_id and exact score of the best k rows of docs for each item, among the texts chosen for it (q, k1, k2; FIRST * k
    an item, at most). Each task hands on its best k rows an item; of rows with one text, the text is scored once a batch."""
    wanted = saved(chosen.groupBy(*KEY).agg(F.collect_set("q").alias("qs")), "wanted")  # as many as a block has items, at most
    rows = with_keys(docs).join(bounded(wanted), KEY).select("doc_id", "text", *KEY, "qs")
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = shared.value, Best(k)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                known = {}
                for doc_id, text, k1, k2, qs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (k1, k2) not in known:
                        known[k1, k2] = scores_of(block, text, qs)
                    best.add(doc_id, known[k1, k2])
        yield best.rows()

    return top(rows.mapInArrow(run, "q int, doc_id long, score long"), k)


def reaching(index: DataFrame, items: Asked, thresholds: np.ndarray, k: int) -> DataFrame:
    """q, doc_id and exact score of the best k rows of the index for each item, among those whose bound reaches the item's
    threshold. They are scored where their bounds are found: no text is shuffled, however many reach it."""
    shared = index.sparkSession.sparkContext.broadcast((items, thresholds))  # a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (block, least), best = shared.value, Best(k)
        for batch in batches:
            for part in (batch.slice(k, 4 * ROWS) for k in range(0, batch.num_rows, 4 * ROWS)):
                bound, known = bounds(block, part.column(3).to_pylist(), [unfolded(x) for x in part.column(4).to_pylist()]), {}
                reach = bound >= least
                ids, first, second, texts = (part.column(i) for i in (0, 1, 2, 5))
                for i in np.flatnonzero(reach.any(axis=1)).tolist():
                    key = first[i].as_py(), second[i].as_py()
                    if key not in known:
                        known[key] = scores_of(block, unpacked(texts[i].as_py()), np.flatnonzero(reach[i]).tolist())
                    best.add(ids[i].as_py(), known[key])
        yield best.rows()

    rows = index.where("term is null").select("doc_id", *KEY, "n", "sketch", "packed")
    return top(rows.mapInArrow(run, "q int, doc_id long, score long"), k)


def top(scores: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item with their rank, equal scores by id, without id last."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_blocks(items: DataFrame) -> Iterator[list]:
    """The distinct (item_id, text) with a text, in blocks of about ITEM_BYTES."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(value_bytes(rows, "text")), F.lit(0))).first()[0]
    n = -(-size // ITEM_BYTES)
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best rows of docs with a score above 0 for each item.

    Null texts and texts without terms are no documents and find none; texts of any length are read whole. Rows of docs with
    equal or null ids and repeated rows are ranked each, without id after the others of the same score. Rows of items with
    the same id and another text are items of their own, repeated ones are one. Empty tables give no rows. Other columns
    aren't read, whatever they are called.
    """
    spark, out, index, totals = docs.sparkSession, None, None, None
    kind = dict(items.dtypes)["item_id"]
    for rows in item_blocks(items):
        wanted = frozenset(t for r in rows for t in terms(r[1]))
        counted = indexed(docs, wanted, index is None)
        if index is None:
            index = counted
            totals = index.where("term is null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        block = asked(rows, counted, (totals[0], totals[1]))
        if not block.of:
            continue
        first = candidates(index, block, FIRST * k).withColumnRenamed("bound", "score").withColumn("doc_id", F.col("k1"))
        best = rescored(docs, top(first, FIRST * k), block, k)
        reached = {r.q: r.score for r in best.where(F.col("rank") == k).select("q", "score").collect()}  # a number an item
        thresholds = np.array([max(1, reached.get(q, 1)) for q in range(len(block.of))], np.int64)
        found = reaching(index, block, thresholds, k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), f"q int, item_id {kind}"))  # a block of items
        made = found.join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def oracle(k: int = 50) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS t FROM documents),
    held AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM d WHERE len(t) > 0),
    corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
    tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM held) GROUP BY r, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    item AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark),
    weight AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM item JOIN df USING (term), corpus),
    scored AS (SELECT item_id, held.r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
               FROM weight JOIN tf USING (term) JOIN held ON held.r = tf.r, corpus GROUP BY item_id, held.r),
    ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS place FROM scored WHERE score > 0)
    SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= {k}
    """
