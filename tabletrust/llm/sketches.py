"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's five-word shingles (a shorter
text is one shingle of all its words; a text without words has an empty sketch). Two sketches of parts merge into
the sketch of the whole, and from sketches alone follow resemblance, containment and the number of shingles.
"""

from __future__ import annotations

import json
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.llm.common import SPACE, saved, unused

K = 128
SHINGLE = 5
#: Bytes of texts, about, in a range of documents at most; each range is one window. So many ranges a shuffle partition, so
#: that partitions are alike, unless that makes ranges of less than a 32nd of those bytes.
RANGE_BYTES, RANGES = 64 << 20, 16
#: The width of the hash space, for counting.
SPACE_64 = float(2**64)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The hash of each run of `size` words, in text order; one hash of all words in a shorter text; none without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
    # The words are bound once, as the element of a one-element array, so that they aren't split again in every run.
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<bigint>"))))


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group: at most k smallest distinct hashes of all its rows' sketches.

    A group of any size stays small: hashes are made distinct before they are ranked, in salted parts first.
    """
    rows = df.select(*by, F.explode(column).alias("_h")).groupBy(*by, "_h").agg(F.lit(1).alias("_one"))
    part = Window.partitionBy(*by, F.pmod("_h", F.lit(64))).orderBy("_h")
    few = rows.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    return few.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's bottom k that both have. Exact where both texts have fewer than
    k shingles, as their sketches hold them all; two empty sketches are alike."""
    union = F.when((F.size(a) < k) & (F.size(b) < k), F.array_union(a, b)).otherwise(merged(a, b, k))
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = (F.element_at(a, -1).cast("double") + F.lit(SPACE_64 / 2)) / F.lit(SPACE_64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    j = resemblance(a, b, k)
    inter = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inter / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as 16 hex digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def below(cuts: list[tuple[int, int]], key: Column) -> Column:
    """How many of the ascending cuts are less than the key: first among every so many of them, then between two of those."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts)) + 1
    fixed = lambda part: F.from_json(F.lit(json.dumps([{"i": i, "h": h} for i, h in part])), "array<struct<i:bigint,h:bigint>>")
    count = lambda a: F.size(F.filter(a, lambda c: c < key))
    before = (count(fixed(cuts[::step])) - 1) * step
    return F.when(before < 0, 0).otherwise(before + count(F.slice(fixed(cuts), before + 1, step)))


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Adds next_<c> for each other column c: its value in the row with the next lower doc_id (after the lowest: the highest).

    docs has doc_id, text (no nulls) and what else is to be carried. Equal ids follow each other by text hash, null ids
    come last. Rows drawn by a hash of id and text hash cut the order into ranges of about range_bytes, and one window
    reads each range; the row at a range's upper end is also dealt to the range above, whose last row needs it. Only the
    cuts, one for so many bytes of text, are collected. Texts are shuffled once.
    """
    carried = [c for c in docs.columns if c != "doc_id"]
    key, to = unused(docs, "_key"), unused(docs, "_to")
    keyed = docs.withColumn(key, F.struct(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("i"), F.xxhash64("text").alias("h")))
    order = saved(keyed.select(key, F.octet_length("text").cast("long").alias("size")), "order")
    whole = order.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max(key).alias("top")).first()
    size, partitions = whole.bytes or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, ceil(size / range_bytes), min(RANGES * partitions, ceil(32 * size / range_bytes)))
    drawn = order.where(F.pmod(F.xxhash64(key), F.lit(max(1, whole.n // ranges))) == 0).select(f"{key}.*").distinct().orderBy("i", "h")
    cuts = [(r.i, r.h) for r in drawn.collect()]  # about one for every range_bytes
    top = F.struct(F.lit(whole.top.i if whole.n else 0).cast("long").alias("i"), F.lit(whole.top.h if whole.n else 0).cast("long").alias("h"))
    ranged = keyed.withColumn(to, below(cuts, F.col(key)))
    deal = lambda r, copy: F.struct(r.cast("int").alias("r"), F.lit(copy).alias("copy"))
    # A range ends, upwards, with a cut: that row is needed after the last one of the range above, the top row after the lowest.
    is_cut = F.pmod(F.xxhash64(key), F.lit(max(1, whole.n // ranges))) == 0
    places = F.array_compact(F.array(deal(F.col(to), 0), F.when(is_cut, deal(F.col(to) + 1, 1)), F.when(F.col(key) == top, deal(F.lit(0), 2))))
    dealt = ranged.withColumn(to, F.explode(places))
    by = Window.partitionBy(f"{to}.r").orderBy(f"{to}.copy", F.col(key).desc())
    ahead = dealt.select("doc_id", *carried, to, *(F.lead(c).over(by).alias(f"next_{c}") for c in carried))
    return ahead.where(f"{to}.copy = 0").drop(to)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited and near_next of every row: the sketch of each
    whole text, of its edited text (its last half replaced by the first half as many code points of the next document) and
    their likeness, and its likeness to the next document's sketch.

    Null texts are empty; texts without words have empty sketches, which are like each other; texts of any length are read
    whole. Rows with equal ids follow each other by a hash of the text, null ids come last; repeated rows have a row each;
    one row alone is its own next. An empty table gives no rows. Other columns of docs aren't read.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text"), k))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = with_next(own).withColumn("edited", edited)
    made = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited"), k).alias("edited_sketch"))
    near = {"near_edited": "edited_sketch", "near_next": "next_sketch"}
    return made.withColumns({c: resemblance(F.col("sketch"), F.col(other), k) for c, other in near.items()}).drop("next_sketch")
